"""URL filter by a tree of path templates per host, in built-in functions only.

Paths are cut into segments; numbers, dates and hex strings become typed wildcards at once. URLs are then reduced to (host, typed
path) shapes that count distinct URLs (host and path), so neither repeated rows nor queries count. The tree is built level by level over
the shapes: below a branch of many segments, most of which have few distinct shapes, those that have few become ``*``; other branches whose labelled block rates are on one side of
one half and do not differ significantly from the others of that side are merged (``*+`` blocked, ``*-`` allowed). Branches without
labels are not merged. A template is rejected if its smoothed labelled purity, (blocked + PRIOR / 2) / (labelled + PRIOR), reaches REJECT; below
a ``*`` each value of the first ``*`` counts once, by its share of blocked URLs, so one frequent value does not judge the others.

Shapes return to the pages by a join in which every shape is repeated for SALTS salts, so a frequent one is spread.

Rules: host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path what follows up to ``?``, ``#`` or the
end; both empty for null and without ``://``. A rule fits its host and all subdomains if the path starts with the rule's; the longest
wins. Rule verdicts are the labels. Below DEPTH segments a branch is one ``**``. Repeated rows are judged each, null ids stay. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auxoline.llm.frames import stored
from auxoline.llm.registry import query, table

#: (verdict, rule); a rule is host and path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DEPTH = 12
#: A branch is variable from so many different segments, if at least half of them have fewer distinct shapes each than the second number.
VALUES, EACH = 20, 5
#: Standard score below which two block rates do not differ.
SIMILAR = 1.96
PRIOR, REJECT = 4.0, 0.8
SALTS = 32


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    fits = []
    for verdict, rule in rules:
        rule_host, _, rule_path = rule.partition("/")
        fit = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(f"/{rule_path}"))
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def typed_segments(path: Column) -> Column:
    """The path's segments with typed wildcards for numbers, dates and hex strings; an extension stays."""

    def typed(segment: Column) -> Column:
        stem, tail = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2)
        kind = F.when(stem.rlike(r"^\d{4}-\d\d-\d\d$"), "<date>").when(stem.rlike(r"^\d+$"), "<num>").when(stem.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), "<hex>")
        return F.coalesce(F.concat(kind, tail), segment)

    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), typed)
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), F.array(F.lit("**")))).otherwise(parts)


def level(shapes: DataFrame) -> DataFrame:
    """``shapes`` (host, segments, done, labelled, blocked) with one more segment generalised in ``done``."""
    at = F.size("done")
    branch = F.to_json(F.struct(F.col("done")))
    rows = shapes.withColumn("branch", branch).withColumn("child", F.when(at < F.size("segments"), F.element_at("segments", F.least(at + 1, F.size("segments")))))
    children = rows.filter("child is not null").groupBy("host", "branch", "child").agg(F.count("*").alias("shapes"), *[F.sum(c).alias(c) for c in ("labelled", "blocked")])
    side = F.when(F.col("labelled") > 0, F.col("blocked") * 2 >= F.col("labelled"))
    children = stored(children.withColumn("side", side))
    parents = children.groupBy("host", "branch").agg(F.count("*").alias("values"), F.sum((F.col("shapes") < EACH).cast("bigint")).alias("few"), *[F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0)).alias(f"{c}_{int(s)}") for s in (True, False) for c in ("labelled", "blocked")], F.sum(F.when(F.col("side"), 1).otherwise(0)).alias("many_1"), F.sum(F.when(~F.col("side"), 1).otherwise(0)).alias("many_0"))
    both = children.join(parents, ["host", "branch"])
    # The block rate of the other branches on the same side.
    own = F.col("side")
    rest_labelled = F.when(own, F.col("labelled_1")).otherwise(F.col("labelled_0")) - F.col("labelled")
    rest_blocked = F.when(own, F.col("blocked_1")).otherwise(F.col("blocked_0")) - F.col("blocked")
    pooled = (F.col("blocked") + rest_blocked + 1) / (F.col("labelled") + rest_labelled + 2)
    score = F.abs(F.col("blocked") / F.col("labelled") - rest_blocked / rest_labelled) / F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / rest_labelled))
    merged = F.when((F.col("labelled") > 0) & (F.when(own, F.col("many_1")).otherwise(F.col("many_0")) > 1) & (rest_labelled > 0), F.when(score < SIMILAR, F.when(own, "*+").otherwise("*-")))
    variable = F.when((F.col("values") >= VALUES) & (F.col("few") * 2 >= F.col("values")) & (F.col("shapes") < EACH), F.lit("*"))
    chosen = both.select("host", "branch", "child", F.coalesce(variable, merged, F.col("child")).alias("general"))
    joined = rows.join(chosen, ["host", "branch", "child"], "left")
    return stored(joined.select("host", "segments", F.when(F.col("general").isNotNull(), F.concat("done", F.array("general"))).otherwise(F.col("done")).alias("done"), "labelled", "blocked"))


def template_verdicts(urls: DataFrame) -> DataFrame:
    """host, segments, template, purity, judged of every shape among ``urls`` (host, segments, blocked: null if unlabelled), a row each."""
    is_labelled = F.col("blocked").isNotNull()
    shapes = urls.groupBy("host", "segments").agg(F.sum(is_labelled.cast("bigint")).alias("labelled"), F.sum(F.coalesce(F.col("blocked").cast("bigint"), F.lit(0))).alias("blocked"))
    shapes = stored(shapes.withColumn("done", F.array().cast("array<string>")))
    deepest = shapes.agg(F.coalesce(F.max(F.size("segments")), F.lit(0)).alias("d")).first().d
    for _ in range(deepest):
        shapes = level(shapes)
    named = shapes.withColumn("template", F.concat(F.lit("/"), F.concat_ws("/", "done")))
    first = F.array_position("done", "*")
    values = named.withColumn("value", F.when(first > 0, F.element_at("segments", F.greatest(first, F.lit(1)).cast("int")))).groupBy("host", "template", "value").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    one = F.col("value").isNotNull() & (F.col("l") > 0)
    sums = values.groupBy("host", "template").agg(F.sum(F.when(one, 1.0).otherwise(F.col("l"))).alias("l"), F.sum(F.when(one, F.col("b") / F.col("l")).otherwise(F.col("b"))).alias("b"))
    purity = (F.col("b") + PRIOR / 2) / (F.col("l") + PRIOR)
    judged = sums.select("host", "template", purity.alias("purity"), F.when(purity >= REJECT, "block").otherwise("allow").alias("judged"))
    return stored(named.join(judged, ["host", "template"]).select("host", "segments", "template", "purity", "judged"))


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template."""
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("fit"), typed_segments(F.col("path")).alias("segments"))
    urls = rows.select("host", "path").distinct()
    urls = urls.select("host", typed_segments(F.col("path")).alias("segments"), (rule_of(F.col("host"), F.col("path"), rules)["verdict"] == "block").alias("blocked"))
    shapes = template_verdicts(urls)
    shape = F.xxhash64(F.col("host"), F.col("segments")).alias("shape")
    known = shapes.select(shape, F.col("host").alias("its_host"), F.col("segments").alias("its_segments"), "template", "judged", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.select("*", shape, F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int").alias("salt"))
    same = (salted["shape"] == known["shape"]) & (salted["salt"] == known["salt"]) & (F.col("host") == F.col("its_host")) & (F.col("segments") == F.col("its_segments"))
    return salted.join(known, same).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "judged").alias("verdict"), "template")


@query("op4_url_filter")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
