"""URL filters (operator 5): host and path rules, then a path-template tree judged by smoothed purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import table, union_all, written

#: (verdict, host, path) in order; the longest that fits decides.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Different literal segments from which a position is variable, if a segment has under PER_SEGMENT pages on average.
VARIABLE, PER_SEGMENT = 8, 20.0
#: Kinds of segments that are wildcards from the outset.
WILD = ("{n}", "{x}", "{s}")
#: |z| up to which neighbouring branches are alike, weight of a parent's purity in pages, a host's before any label, and
#: the purity from which a template goes.
LIKE, PRIOR, MEAN, PURITY = 1.96, 4.0, 0.2, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the columns host and path; nulls where none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """A path's segments by kind: numbers, hexadecimal and mixed segments become wildcards, literals stay."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    kind = lambda s: (
        F.when(s.rlike(r"^[0-9]+$"), "{n}").when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("{n}"), F.regexp_extract(s, r"\.[A-Za-z0-9]+$", 0)))
        .when(s.rlike(r"^[0-9a-f]{8,}$"), "{x}").when(s.rlike(r"[0-9]") & (F.length(s) >= 6), "{s}").otherwise(s)
    )
    return F.transform(parts, kind)


def children(step: DataFrame) -> DataFrame:
    """(host, branch, segment, name, into, purity, labelled): the branch that each child segment of a node goes into.

    Where a node's literal segments are many and each is rare, they share the name "*". Named children are put in
    order of their bad share; a new branch begins where two neighbours differ by a two-proportion z-test.
    Children without labels form a branch of their own. A branch's purity is its bad share, smoothed by PRIOR pages of
    the parent's purity; a branch that holds all of the parent's labels or none has the parent's.
    """
    literal = ~F.col("segment").isin(*WILD, "")
    found = step.groupBy("host", "branch", "segment").agg(*(F.sum(c).alias(c) for c in ("pages", "labelled", "bad")), *(F.first(c).alias(c) for c in ("above", "all_labelled")))
    nodes = found.groupBy("host", "branch").agg(F.count_if(literal).alias("different"), F.sum(F.when(literal, F.col("pages")).otherwise(0)).alias("rare"))
    open_ = (F.col("different") >= VARIABLE) & (F.col("rare") < PER_SEGMENT * F.col("different"))
    named = written(found.join(nodes, ["host", "branch"]).withColumn("name", F.when(open_ & literal, "*").otherwise(F.col("segment"))), "segments")
    of = named.groupBy("host", "branch", "name").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("k"), *(F.first(c).alias(c) for c in ("above", "all_labelled")))
    of = of.withColumn("share", F.when(F.col("n") > 0, F.col("k") / F.col("n")))
    order = Window.partitionBy("host", "branch").orderBy(F.col("share").isNull(), "share", "name")
    n, k = F.col("n") + F.lag("n").over(order), F.col("k") + F.lag("k").over(order)
    spread = k / n * (1 - k / n) * (1 / F.col("n") + 1 / F.lag("n").over(order))
    apart = F.col("share") - F.lag("share").over(order)
    of = of.withColumn("starts", F.when(F.col("share").isNotNull() & (apart * apart > LIKE * LIKE * spread), 1).otherwise(0))
    of = of.withColumn("into", F.when(F.col("share").isNull(), -1).otherwise(F.sum("starts").over(order)))
    merged = of.groupBy("host", "branch", "into").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    own = of.select("host", "branch", "name", "into", "above", "all_labelled").join(merged, ["host", "branch", "into"])
    smooth = (F.col("k") + PRIOR * F.col("above")) / (F.col("n") + PRIOR)
    own = own.withColumn("purity", F.when((F.col("n") == 0) | (F.col("n") == F.col("all_labelled")), F.col("above")).otherwise(smooth))
    own = own.select("host", "branch", "name", F.concat_ws("/", "branch", F.when(F.col("into") < 0, "-").otherwise(F.col("into").cast("string"))).alias("into"), "purity", F.col("n").alias("branch_labelled"))
    return named.select("host", "branch", "segment", "name").join(own, ["host", "branch", "name"])


def template_tree(pages: DataFrame) -> DataFrame:
    """(host, shape, template, branch, purity) of each host's path shapes.

    ``pages`` has host, path and bad (1, 0, or null where unlabelled). The tree grows from the host downwards. At
    a node the shapes' common beginning is passed over, then the segments in which they differ are generalised and merged
    (see ``children``); merged siblings go on as one node, so that branches merge at every depth. A node whose
    shapes are all the same is a leaf. A host starts from its bad share, smoothed by PRIOR pages of MEAN.
    """
    shapes = pages.groupBy("host", shape(F.col("path")).alias("shape")).agg(F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    shapes = written(shapes, "shapes")
    hosts = shapes.groupBy("host").agg(F.sum("labelled").alias("all_labelled"), ((F.sum("bad") + PRIOR * MEAN) / (F.sum("labelled") + PRIOR)).alias("above"))
    alive = shapes.join(hosts, "host").withColumns({"branch": F.lit("0"), "template": F.array().cast("array<string>"), "rest": F.col("shape")})
    leaves = []
    while True:
        span = alive.groupBy("host", "branch").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
        common = F.array_position(F.transform(F.arrays_zip("low", "high"), lambda x: x["low"].eqNullSafe(x["high"])), F.lit(False)).cast("int") - 1
        alive = written(alive.join(span.select("host", "branch", (F.col("low") == F.col("high")).alias("leaf"), common.alias("common")), ["host", "branch"]), "nodes")
        leaves.append(alive.where("leaf").select("host", "shape", F.array_join(F.concat("template", "rest"), "/").alias("template"), "branch", F.col("above").alias("purity")))
        step = alive.where("NOT leaf").select(
            "host", "shape", "pages", "labelled", "bad", "branch", "above", "all_labelled", F.concat("template", F.slice("rest", F.lit(1), F.col("common"))).alias("template"),
            F.coalesce(F.get("rest", F.col("common")), F.lit("")).alias("segment"), F.slice("rest", F.col("common") + 2, F.size("rest")).alias("rest"),
        )
        if step.isEmpty():
            return union_all(leaves)
        moved = step.join(children(step), ["host", "branch", "segment"])
        named = F.when(F.col("segment") == "", F.col("template")).otherwise(F.concat("template", F.array("name")))
        alive = moved.select("host", "shape", "pages", "labelled", "bad", F.col("into").alias("branch"), F.col("purity").alias("above"), F.col("branch_labelled").alias("all_labelled"), named.alias("template"), "rest")


def judged(pages: DataFrame, rules=RULES, purity: float = PURITY) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of each row of ``pages`` (page_id, url).

    A rule's pages get its verdict and label the tree: block is bad, allow is good. Every other page is blocked
    if its template's branch has a smoothed share of bad labelled pages of at least ``purity``. A branch without labels
    has the purity of the branch above it, at last of its host; a host without labels has MEAN. A null url and one
    without "://" have an empty host and path and are judged like any other; urls and paths of any length and
    depth are kept whole; repeated rows are judged alike and each weighs in the tree; equal shares are put in order of
    their segments; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    rule, verdict = rule_of(rules)
    thin = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    thin = thin.select("*", rule.alias("rule"), verdict.alias("verdict"))
    labelled = thin.withColumn("bad", F.when(F.col("verdict") == "block", 1).when(F.col("verdict") == "allow", 0))
    tree = template_tree(labelled)
    found = thin.withColumn("shape", shape(F.col("path"))).join(tree, ["host", "shape"], "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("purity") >= purity, "block").otherwise("allow")).alias("verdict"), "template", "purity")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, then template and purity, of every page."""
    return judged(table(spark, sf_dir, "pages"))
