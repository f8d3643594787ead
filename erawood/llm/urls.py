"""URL filter: rules first, then path templates learned for each host.

A host's paths form a tree of any depth. A segment of a path becomes a wildcard if it looks variable (digits,
hex strings, long mixed strings) or if it has few labelled pages and its parent many children; siblings
whose labelled rates don't differ statistically (two-proportion test, one-sided smoothed counts)
share a branch. Below a node with fewer labelled pages than a rejection needs, branches stay as
they are, as none of them can be rejected. A template, host plus generalised segments, is rejected if its smoothed purity,
(bad + PRIOR * rate) / (labelled + PRIOR) with the rate of all labelled pages, reaches the
threshold and the smallest count of labelled pages. Pages without a template verdict pass.

Counts go up the tree by partial aggregation, so a host with a third of all pages is a few rows
for each task; the tables of templates are joined, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erawood.llm.common import cut, table

#: (verdict, host, path prefix) of the base rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Children of one node from which on those with few labelled pages are one variable segment.
MANY = 20
PRIOR = 4.0
PURITY = 0.9
LEAST_LABELLED = 10
#: Standard errors by which sibling branches must differ to stay apart.
Z = 1.64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as the contract cuts them; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does.

    Length is that of host plus path prefix; of equally long rules the first listed wins.
    """
    text = verdict = None
    for kind, of, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        text = F.when(fits, of + start) if text is None else text.when(fits, of + start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def segments(path: Column) -> Column:
    """All segments, clearly variable ones as wildcards that keep their ending."""

    def general(s: Column) -> Column:
        s = F.regexp_replace(s, r"^[0-9]+", "*")
        return F.when(s.rlike(r"^[0-9a-fA-F-]{8,}$") | (F.length(s) > 32), F.lit("*")).otherwise(s)

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), general)


def _rate(bad: Column, n: Column, prior: Column) -> Column:
    return (bad + PRIOR * prior) / (n + PRIOR)


def learned(pages: DataFrame) -> DataFrame:
    """``(host, segs, template, purity, labelled)`` for each distinct generalised path of each host.

    Level by level, down to where no node has labelled pages enough for a rejection.
    """
    paths = pages.groupBy("host", "segs").agg(F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    current = cut(paths.withColumn("template", F.col("segs")))
    bad, n = current.agg(F.sum("bad"), F.sum("n")).first()
    prior = F.lit(float(bad or 0) / max(n or 0, 1))
    level = 0
    while True:
        at, parent = F.lit(level), F.slice("template", 1, level)
        here = current.where(F.size("template") > at).select("host", parent.alias("parent"), F.get("template", at).alias("child"), "n", "bad")
        child = here.groupBy("host", "parent", "child").agg(F.sum("n").alias("cn"), F.sum("bad").alias("cbad"))
        group = child.groupBy("host", "parent").agg(F.count("*").alias("many"), F.sum("cn").alias("pn"), F.sum("cbad").alias("pbad")).where(F.col("pn") >= LEAST_LABELLED)
        group = cut(group)
        if group.isEmpty():
            break
        both = child.join(group, ["host", "parent"])
        rest_n, rest_bad = F.col("pn") - F.col("cn"), F.col("pbad") - F.col("cbad")
        p1, p2 = _rate(F.col("cbad"), F.col("cn"), prior), _rate(rest_bad, rest_n, prior)
        error = F.sqrt(p1 * (1 - p1) / (F.col("cn") + PRIOR) + p2 * (1 - p2) / (rest_n + PRIOR))
        alike = F.abs(p1 - p2) <= Z * error
        merge = both.where((F.col("many") > 1) & (alike | ((F.col("many") > MANY) & (F.col("cn") < LEAST_LABELLED)))).select("host", "parent", "child", F.lit(True).alias("merge"))
        joined = current.withColumn("parent", parent).withColumn("child", F.get("template", at)).join(merge, ["host", "parent", "child"], "left")
        renamed = F.transform("template", lambda s, i: F.when((i == at) & F.coalesce(F.col("merge"), F.lit(False)), F.lit("*")).otherwise(s))
        current = cut(joined.select("host", "segs", "n", "bad", renamed.alias("template")))
        level += 1
    sums = current.groupBy("host", "template").agg(F.sum("n").alias("labelled"), F.sum("bad").alias("tbad"))
    purity = sums.select("host", "template", "labelled", _rate(F.col("tbad"), F.col("labelled"), prior).alias("purity"))
    return current.select("host", "segs", "template").join(purity, ["host", "template"])


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """Host, path, rule, verdict, template and purity of each row of ``pages`` ``(page_id, url)``.

    ``labels`` ``(page_id, bad)`` are the labelled pages; without it the pages that a rule decides
    are (block: bad). Null urls and urls without ``://`` have an empty host and path, no rule and
    pass; urls are read whole, of any length; repeated rows are judged each, and count each; of
    equally long rules the first listed wins; other columns are not read; an empty table gives an
    empty result.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    split = split.withColumn("rule", rule).withColumn("decided", decided).withColumn("segs", segments(F.col("path")))
    if labels is None:
        marked = split.withColumn("bad", F.when(F.col("decided") == "block", 1).when(F.col("decided") == "allow", 0))
    else:
        marked = split.join(labels.select("page_id", F.col("bad").cast("int").alias("bad")).groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id", "left")
    known = learned(marked.where("host != ''").select("host", "segs", "bad"))
    reject = (F.col("purity") >= PURITY) & (F.col("labelled") >= LEAST_LABELLED)
    return split.join(known, ["host", "segs"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("decided", F.when(reject, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity",
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
