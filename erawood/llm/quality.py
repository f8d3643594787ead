"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a predicate over statistics of a text. On a sample, each rule is timed, which gives its
cost, and the patterns of rejections are counted, which gives its selectivity; from these the rules
are ordered greedily by rejections per cost among what the rules before them let through. The
ordered rules become one CASE expression inside a higher-order function, which Spark evaluates up
to the first rule that rejects; a statistic is an expression in its rule's branch, so it is only
computed for rows that get there. Words alone are split for all rows, once. The order affects cost
and the name of the first failing rule, never which documents are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erawood.llm.common import free_names, quoted, table

#: Rows, about, on which the order of the rules is estimated.
SAMPLE_ROWS = 2000
#: Runs of each rule on the sample; the shortest counts.
RUNS = 2
#: Up to so many distinct repeated windows are looked up one by one; more are found by sorting.
FEW_REPEATED = 32
_WHITE = r"[\x20\x09-\x0D]+"


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` computed once, and only if the whole is needed."""
    return F.element_at(F.transform(F.array(x), use), 1)


def clean(text: Column) -> Column:
    """The text as a string; empty for null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text."""
    return F.array_remove(F.split(text, _WHITE), "")


def _long(x: Column) -> Column:
    return x.cast("long")


def _lines(t: Column) -> Column:
    return F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _covered(starts: Column) -> Column:
    """How many words lie in the three-word windows that begin at these sorted places."""
    first = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(starts, first, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])


def _repeated_words(w: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more in the text.

    Windows are told apart by 64-bit hashes. Most texts have no repeated one, which a hash set
    shows; of the others, the repeated hashes are looked up if they are few, else all windows are
    sorted with their places.
    """
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def by_lookup(h: Column, again: Column) -> Column:
        return _covered(F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i)), lambda i: i.isNotNull()))

    def by_sorting(h: Column) -> Column:
        def same(p: Column, k: Column, e: Column) -> Column:
            return F.coalesce(F.get(p, k)["h"] == e["h"], F.lit(False))

        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(placed, lambda p: _covered(F.sort_array(F.transform(F.filter(p, lambda e, k: same(p, k - 1, e) | same(p, k + 1, e)), lambda e: e["i"]))))

    def some(h: Column) -> Column:
        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
        return let(again, lambda a: F.when(F.size(a) <= FEW_REPEATED, by_lookup(h, a)).otherwise(by_sorting(h)))

    none = F.lit(0).cast("long")
    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), some(h)).otherwise(none))
    return F.when(F.size(w) >= 3, counted).otherwise(none)


#: Each statistic as an expression of a text and its words.
STATISTICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: _long(F.size(w)),
    "word_chars": lambda t, w: _long(F.length(F.array_join(w, ""))),
    "n_symbols": lambda t, w: _long(F.regexp_count(t, F.lit(r"[#*$%&|<>]"))),
    "n_lines": lambda t, w: _long(F.size(_lines(t))),
    "n_dup_lines": lambda t, w: let(_lines(t), lambda x: _long(F.size(x) - F.size(F.array_distinct(x)))),
    "n_repeat_words": lambda t, w: _repeated_words(w),
}


class Statistics:
    """Statistics by name: ``ready`` ones from a struct, the others as expressions of text and words."""

    def __init__(self, text: Column, words: Column, ready: Column | None = None, names: Sequence[str] = ()):
        self._text, self._words, self._ready, self._names = text, words, ready, names

    def __getattr__(self, name: str) -> Column:
        if name in self._names:
            return self._ready[name]
        if name not in STATISTICS:
            raise AttributeError(name)
        return STATISTICS[name](self._text, self._words)


@dataclass(frozen=True)
class Rule:
    """A document goes if ``rejects`` of its statistics is true; null lets it pass."""

    name: str
    rejects: Callable[[Statistics], Column]


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda s: s.n_words < 50),
        Rule("repeated_words", lambda s: s.n_repeat_words * 100 > s.n_words * 50),
    ]


def default_rules() -> list[Rule]:
    """Rules beside the base ones."""

    def odd_length(s: Statistics) -> Column:
        n = F.greatest(s.n_words, F.lit(1))
        return let(s.word_chars, lambda c: (c < 2 * n) | (c > 20 * n))

    return [
        Rule("symbols", lambda s: s.n_symbols * 10 > s.n_words),
        Rule("repeated_lines", lambda s: s.n_dup_lines * 2 > s.n_lines),
        Rule("word_length", odd_length),
    ]


def measured(docs: DataFrame, rules: Sequence[Rule], text: str, sample_rows: int, seed: int) -> tuple[list[tuple[str, int]], list[float]]:
    """On a sample: each pattern of rejections ("1" where the rule rejects) with its count, and each rule's seconds a row."""
    total = docs.count()
    sample = docs.select(clean(quoted(text)).alias("t"))
    sample = sample if total <= sample_rows else sample.sample(fraction=sample_rows / total, seed=seed)
    held = sample.select("t", words(F.col("t")).alias("w")).repartition(2).persist()
    try:
        found = [r.rejects(Statistics(F.col("t"), F.col("w"))) for r in rules]
        pattern = F.concat(F.lit(""), *[F.when(x, "1").otherwise("0") for x in found])
        patterns = sorted((r["p"], r["n"]) for r in held.groupBy(pattern.alias("p")).agg(F.count("*").alias("n")).collect())
        rows = sum(n for _, n in patterns)

        def seconds(x: Column) -> float:
            took = []
            for _ in range(RUNS):
                began = time.perf_counter()
                held.agg(F.count_if(x)).collect()
                took.append(time.perf_counter() - began)
            return min(took)

        idle = seconds(F.size("w") < 0) if rows else 0.0
        return patterns, [max(seconds(x) - idle, 1e-6) / rows if rows else 0.0 for x in found]
    finally:
        held.unpersist()


def ordered_by_gain(patterns: list[tuple[str, int]], costs: Sequence[float]) -> list[int]:
    """Places of the rules by rejections per cost, each among what those before it let through."""
    left, alive, out = list(range(len(costs))), patterns, []
    while left:
        n = sum(c for _, c in alive)

        def gain(i: int) -> tuple[float, float, int]:
            rejected = sum(c for p, c in alive if p[i] == "1")
            cost = costs[i] * n
            return (rejected / cost if cost > 0 else float(rejected > 0), -costs[i], -i)

        best = max(left, key=gain)
        out.append(best)
        left.remove(best)
        alive = [x for x in alive if x[0][best] == "0"]
    return out


def order_rules(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> list[Rule]:
    """The rules by conditional rejections per measured cost on about ``sample_rows`` rows.

    With an empty table the order stays. Timings differ from run to run, so the order may, but
    verdicts don't follow it.
    """
    if len(rules) > 20:
        raise ValueError("at most 20 rules")
    return [rules[i] for i in ordered_by_gain(*measured(docs, rules, text, sample_rows, seed))]


def first_failure(rules: Sequence[Rule], s: Statistics) -> Column:
    """Name of the first rule that rejects, or null; later rules aren't evaluated."""
    out = None
    for r in rules:
        rejects = r.rejects(s)
        out = F.when(rejects, F.lit(r.name)) if out is None else out.when(rejects, F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out.otherwise(F.lit(None).cast("string"))


def failed_rule(ordered: Sequence[Rule], text: str = "text") -> Column:
    """The cascade over a text column."""
    return let(clean(quoted(text)), lambda t: let(words(t), lambda w: first_failure(ordered, Statistics(t, w))))


def cascade(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``failed_rule`` (null if none) and ``kept``; columns of these names are replaced.

    Null and blank texts have no word; repeated rows are judged one by one; texts are read whole;
    an empty table gives an empty result. All other columns go through, whatever their names.
    """
    ordered = order_rules(docs, rules, text, sample_rows)
    own = [quoted(c) for c in docs.columns if c.lower() not in ("failed_rule", "kept")]
    return docs.select(*own, failed_rule(ordered, text).alias("failed_rule")).withColumn("kept", F.col("failed_rule").isNull())


def quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics and verdict of every row of ``docs``; other columns go through.

    Null and blank texts have no word and fail the base rule; repeated rows and null ids are
    judged one by one; texts are read whole, of any length; an empty table gives an empty result.
    Columns of ``docs`` that clash with the computed ones are replaced, all others go through,
    whatever their names. What is returned for every row is computed for every row; ``n_lines``
    only where the cascade gets to its rule.
    """
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    made = (*shown, "base_failed", "failed_rule", "kept")
    ordered = order_rules(docs, [*base_rules(), *default_rules()], sample_rows=sample_rows)

    def judged(t: Column, w: Column) -> Column:
        numbers = F.struct(*[STATISTICS[c](t, w).alias(c) for c in shown])

        def verdict(s: Column) -> Column:
            known = Statistics(t, w, s, shown)
            base = base_rules()
            failed = base[0].rejects(known) | base[1].rejects(known)
            return F.struct(*[s[c].alias(c) for c in shown], failed.alias("base_failed"), first_failure(ordered, known).alias("failed_rule"))

        return let(numbers, verdict)

    own = [c for c in docs.columns if c.lower() not in made]
    (at,) = free_names(own, "judged")
    found = docs.select(*map(quoted, own), let(clean(F.col("text")), lambda t: let(words(t), lambda w: judged(t, w))).alias(at))
    # A filter on a statistic must not be pushed below this projection, where each mention of it
    # would be computed again: it isn't pushed through one that mentions the partition number.
    zero = F.least(F.spark_partition_id(), F.lit(0)).cast("long")
    numbers = [(F.col(at)[c] + zero).alias(c) for c in shown]
    rule = F.col(at)["failed_rule"]
    return found.select(*map(quoted, own), *numbers, F.col(at)["base_failed"].alias("base_failed"), rule.alias("failed_rule"), rule.isNull().alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that a rule rejects; nothing is computed after the first that does.

    Null and blank texts go; repeated rows, null ids, long texts and empty tables: as in
    ``quality``. All columns go through, whatever their names.
    """
    return docs.where(failed_rule(order_rules(docs, [*base_rules(), *default_rules()])).isNull())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP9_SQL = r"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from d),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from w)),
c as (select doc_id, i, count(*) over (partition by doc_id, g) n from g),
r as (select doc_id, count(distinct j) n from (select doc_id, unnest([i, i + 1, i + 2]) j from c where n > 1) group by 1),
s as (select w.doc_id, len(w)::bigint n_words, length(list_aggregate(w, 'string_agg', ''))::bigint word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols, len(l)::bigint n_lines,
             (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words
      from w left join r using (doc_id)),
b as (select *, coalesce(word_chars, 0) wc, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from s)
select doc_id, n_words, wc word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or n_symbols * 10 > n_words or n_dup_lines * 2 > n_lines
            or wc < 2 * greatest(n_words, 1) or wc > 20 * greatest(n_words, 1)) kept
from b
"""
