"""URL filter by host path templates (operator 1).

Per host, urls form a tree of path segments. Segments that vary are generalised into
wildcards (by form: digits and long opaque values; by count: children that hold too
small a share of their node). Sibling branches that continue alike and whose labelled
block rates do not differ significantly are merged. A template is rejected if it holds
labelled urls and its labelled purity, smoothed towards the rate of all labels, reaches
a threshold, so a host without labels of its own is never rejected on the evidence of
other hosts.
Explicit rules (longest first) come before templates.

All of it is DataFrame work: urls are first counted into (host, generalised path)
shapes, the tree is built on the shapes, level by level down to the longest path, and
the urls are joined back once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerocast.llm.common import written

#: Levels of the tree after which it is written down, to keep plans short.
LEVELS = 3
#: A child is a branch of its own from so many urls and this share of its node.
MIN_SUPPORT, MIN_SHARE = 5, 0.01
#: Longer segments are opaque values.
MAX_SEGMENT = 32
#: Branches merge if each has so many labels and differs from their pooled rate by less than so many standard errors.
MERGE_LABELS, MERGE_Z = 5, 1.96
#: Pseudo-labels of the smoothing, and the smoothed block rate from which a template is rejected.
SMOOTHING, REJECT_AT = 10.0, 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    found = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.when(found, F.translate(host, upper, upper.lower())).otherwise(F.lit("")),
            F.when(found, path).otherwise(F.lit("")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; a rule ``host/path`` fits the host and its subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _generalise(shapes: DataFrame, depth: int) -> DataFrame:
    """Children of each node at ``depth`` that are too rare become a wildcard in ``base``."""
    node = [F.col("host"), F.slice("base", 1, depth).alias("prefix")]
    kids = (shapes.filter(F.size("base") > depth)
            .groupBy(*node, F.col("base")[depth].alias("segment")).agg(F.sum("n").alias("n")))
    nodes = kids.groupBy("host", "prefix").agg(F.sum("n").alias("total"))
    rare = (kids.join(nodes, ["host", "prefix"])
            .filter(F.col("n") < F.greatest(F.lit(MIN_SUPPORT), F.col("total") * MIN_SHARE))
            .select("host", "prefix", "segment", F.lit(True).alias("rare")))
    keyed = shapes.select("*", node[1], F.get("base", F.lit(depth)).alias("segment"))
    base = F.when(F.col("rare"), F.transform("base", lambda s, i: F.when(i == depth, F.lit("*")).otherwise(s))).otherwise(F.col("base"))
    return keyed.join(rare, ["host", "prefix", "segment"], "left").withColumn("base", base).drop("prefix", "segment", "rare")


def _merge(shapes: DataFrame, depth: int) -> DataFrame:
    """Siblings at ``depth`` that continue alike and have similar block rates become one branch of ``merged``."""
    prefix, tail = F.slice("merged", 1, depth).alias("prefix"), F.expr(f"slice(merged, {depth + 2}, size(merged))")
    deep = shapes.filter(F.size("merged") > depth)
    branches = (deep.groupBy("host", prefix, F.col("merged")[depth].alias("segment"), tail.alias("tail"))
                .agg(F.sum("n_labelled").alias("n"), F.sum("n_block").alias("b"))
                .groupBy("host", "prefix", "segment")
                .agg(F.bit_xor(F.xxhash64("tail")).alias("follows"), F.sum("n").alias("n"), F.sum("b").alias("b"))
                .filter(F.col("n") >= MERGE_LABELS))
    pooled = (branches.groupBy("host", "prefix", "follows")
              .agg((F.sum("b") / F.sum("n")).alias("rate"), F.count(F.lit(1)).alias("branches")).filter("branches > 1"))
    off = F.abs(F.col("b") / F.col("n") - F.col("rate"))
    alike = (branches.join(pooled, ["host", "prefix", "follows"])
             .filter(off <= MERGE_Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n")))
             .select("host", "prefix", "segment", F.concat(F.lit("~"), F.hex("follows")).alias("branch")))
    keyed = shapes.select("*", prefix, F.get("merged", F.lit(depth)).alias("segment"))
    merged = F.when(F.col("branch").isNotNull(),
                    F.transform("merged", lambda s, i: F.when(i == depth, F.col("branch")).otherwise(s))).otherwise(F.col("merged"))
    return keyed.join(alike, ["host", "prefix", "segment"], "left").withColumn("merged", merged).drop("prefix", "segment", "branch")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", id_col: str = "page_id",
                label_col: str | None = None) -> DataFrame:
    """Judges every url.

    ``rules`` are (``host/path`` prefix, ``allow`` or ``block``), a short list that becomes one
    expression. The labels of the template tree are the verdicts of the rules and, where no
    rule fits, ``label_col`` (1: block, 0: allow, null: none) if it is given.

    Result, a row per input row: ``id_col``, ``host``, ``path``, ``rule`` (null if none fits),
    ``verdict`` (the rule's, else block if the url's template is rejected, else allow),
    ``template`` (string), ``purity`` (smoothed block rate of the template, double). A null
    url or one without ``://`` has empty host and path and is judged as such; null ids and
    repeated rows stay; without any label nothing is rejected; other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    label = F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")
    urls = pages.select(F.col(id_col), label.alias("_given"), host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "_says": says})
    segments = F.split(F.expr("substring(path, 2)"), "/", -1)
    opaque = F.transform(segments, lambda s: F.when(F.length(s) > MAX_SEGMENT, F.lit("*")).otherwise(F.regexp_replace(s, "[0-9]+", "*")))
    shape = (F.when(F.col("path") == "", F.array().cast("array<string>"))
             .otherwise(opaque))
    urls = urls.withColumns({"shape": shape, "_label": F.when(F.col("_says").isNotNull(), (F.col("_says") == "block").cast("int"))
                             .otherwise(F.col("_given"))})
    shapes = (urls.groupBy("host", "shape")
              .agg(F.count(F.lit(1)).alias("n"), F.count("_label").alias("n_labelled"), F.coalesce(F.sum("_label"), F.lit(0)).alias("n_block")))
    shapes = written(shapes.withColumn("base", F.col("shape")), "shapes")
    depths = int(shapes.agg(F.max(F.size("shape"))).first()[0] or 0)

    def levels(table: DataFrame, step, name: str) -> DataFrame:
        for depth in range(depths):
            table = step(table, depth)
            if (depth + 1) % LEVELS == 0 and depth + 1 < depths:
                table = written(table, name)
        return written(table, name)

    shapes = levels(shapes, _generalise, "templates").withColumn("merged", F.col("base"))
    shapes = levels(shapes, _merge, "merged")

    def counts(*by):
        return shapes.groupBy(*by).agg(F.sum("n_labelled").alias("n"), F.sum("n_block").alias("b"))

    total = counts().select(F.when(F.col("n") > 0, F.col("b") / F.col("n")).otherwise(F.lit(0.0)).alias("rate")).first()
    prior = float(total["rate"] or 0.0) if total else 0.0
    here = counts("host", "merged").select(
        "host", "merged", (F.col("n") > 0).alias("_known"), ((F.col("b") + SMOOTHING * prior) / (F.col("n") + SMOOTHING)).alias("purity"))
    judged = (shapes.join(here, ["host", "merged"])
              .select("host", "shape", F.concat(F.lit("/"), F.array_join("base", "/")).alias("template"), "_known", "purity"))
    verdict = F.coalesce(F.col("_says"), F.when(F.col("_known") & (F.col("purity") >= REJECT_AT), F.lit("block")).otherwise(F.lit("allow")))
    return (urls.join(judged, ["host", "shape"], "left")
            .select(id_col, "host", "path", "rule", verdict.alias("verdict"), "template", "purity"))
