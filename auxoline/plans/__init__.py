"""Registered queries, by family."""


def all_queries():
    from auxoline.plans import cohort_queries, growth_queries, model_queries, process_queries, puberty_queries, registry, spec_queries  # noqa: F401

    return registry
