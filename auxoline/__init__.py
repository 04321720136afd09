"""Longitudinal cohort analytics with multiple imputation, as Spark jobs."""
