"""License scans by diagonal voting.

The rolling three-word hashes of every text are joined with the places where they stand in the
license templates, which are whole texts and notices of licenses, parts of them and short
statements. A match votes for the diagonal "place in the text minus place in the template"; votes
are counted by text, template and diagonal, and neighbouring diagonals (small insertions or
deletions) are merged. A merged span is verified by its longest chain of matches in the same order
in both: so much of the template's words must the chain cover.

One pass reads the texts; it drops the hashes that no template has, a constant set, before the join.
The templates are a constant of the subpackage, so the broadcast of their places is bounded.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from erawood.llm.common import CHUNK_BYTES, slices, stored, table, text_bytes
from erawood.llm.license_texts import TEMPLATES
from erawood.llm.words import MULTIPLIERS, hash_spans, rolling, spans

K = 3
#: Diagonals this far apart at most are one span.
NEIGHBOUR = 3
#: Part of a template's words that a span must cover.
COVERAGE = 0.75
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, each word's document, and each document's first word."""
    data, offsets = text_bytes(column)
    low = _LOWER[data]
    starts, ends, doc = spans(low, offsets, _WORD)
    return hash_spans(low, starts, ends), doc, np.searchsorted(doc, np.arange(len(column) + 1))


def template_grams(templates=TEMPLATES) -> tuple[list[tuple[int, int, int]], list[int]]:
    """(hash, template, place) of each rolling k-gram of the templates, and their lengths in words."""
    out, lengths = [], []
    for i, (_, text) in enumerate(templates):
        h, _, _ = _hashed(pa.array([text]))
        if len(h) < K:
            raise ValueError(f"a template needs {K} words: {text}")
        lengths.append(len(h))
        out += [(int(x), i, place) for place, x in enumerate(rolling(h, K, MULTIPLIERS[0]).view(np.int64))]
    return out, lengths


_SCAN = "doc_id long, key long, n_words long, n_base long, first_word long, last_word long, base_labels string, at array<int>, grams array<long>"


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """A row for each of ``docs``: word count, places of the base phrases, and the places and hashes of
    the k-grams that a template has."""
    phrases = [(label, _hashed(pa.array([text]))[0]) for text, label in PHRASES.items()]
    wanted = np.unique(np.array([g for g, _, _ in template_grams(templates)[0]], np.int64).view(np.uint64))

    def run(batches):
        low_bits = np.zeros(1 << 16, bool)
        low_bits[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
        for part in slices(batches, "text", CHUNK_BYTES):
            h, doc, first = _hashed(part.column("text"))
            n = part.num_rows
            count, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: list[list[str]] = [[] for _ in range(n)]
            for label, p in phrases:
                m = len(h) - len(p) + 1
                if m <= 0:
                    continue
                at = np.flatnonzero(h[:m] == p[0])
                for j in range(1, len(p)):
                    at = at[h[at + j] == p[j]]
                at = at[doc[at] == doc[at + len(p) - 1]]
                place = at - first[doc[at]]
                np.add.at(count, doc[at], 1)
                np.minimum.at(low, doc[at], place)
                np.maximum.at(high, doc[at], place)
                for d in np.unique(doc[at]).tolist():
                    labels[d].append(label)
            r = rolling(h, K, MULTIPLIERS[0])
            at = np.flatnonzero(low_bits[(r & np.uint64(0xFFFF)).astype(np.int64)])
            at = at[doc[at] == doc[at + K - 1]] if len(at) else at
            at = at[np.isin(r[at], wanted)]
            bounds = pa.array(np.searchsorted(doc[at], np.arange(n + 1)).astype(np.int32))
            none = count == 0
            columns = [
                part.column("doc_id"), part.column("key"), pa.array(np.diff(first)), pa.array(count), pa.array(low, mask=none), pa.array(high, mask=none), pa.array([",".join(sorted(set(x))) for x in labels]),
                pa.ListArray.from_arrays(bounds, pa.array((at - first[doc[at]]).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(r[at].view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SCAN.split(", ")])

    return docs.mapInArrow(run, _SCAN)


def chain(at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which matches form the longest chain that ascends in the text and in the template."""
    order = np.lexsort((-place, at))
    ends: list[int] = []
    last: list[int] = []
    before = np.full(len(order), -1)
    for i in order.tolist():
        k = bisect_left(ends, place[i])
        before[i] = last[k - 1] if k else -1
        ends[k : k + 1] = [place[i]]
        last[k : k + 1] = [i]
    out = []
    i = last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1], np.int64)


_SPAN = "doc_id long, key long, template int, start long, end long, votes long, coverage double"


def template_spans(scanned: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Verified spans: rows ``(doc_id, key, template, start, end, votes, coverage)``, places in words."""
    spark = scanned.sparkSession
    grams, lengths = template_grams(templates)
    of_gram = spark.createDataFrame(grams, "gram long, template int, place int")
    found = scanned.where(F.size("at") > 0).select("doc_id", "key", F.explode(F.arrays_zip("at", "grams")).alias("x")).select("doc_id", "key", F.col("x.at").alias("at"), F.col("x.grams").alias("gram"))
    votes = (
        found.join(F.broadcast(of_gram), "gram")
        .groupBy("doc_id", "key", "template", (F.col("at") - F.col("place")).alias("diagonal"))
        .agg(F.count("*").alias("votes"), F.collect_set("place").alias("places"))
    )
    order = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOUR, F.lit(True))
    merged = (
        votes.withColumn("fresh", fresh.cast("int"))
        .withColumn("island", F.sum("fresh").over(order))
        .groupBy("doc_id", "key", "template", "island")
        .agg(F.sum("votes").alias("votes"), F.flatten(F.collect_list(F.transform("places", lambda p: F.struct((p + F.col("diagonal")).alias("at"), p.alias("place"))))).alias("hits"))
    )

    def verify(batches):
        for batch in batches:
            rows = []
            for doc_id, key, template, votes, hits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "template", "votes")), batch.column("hits")):
                at, place = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in hits.values.flatten())
                some = chain(at, place)
                covered = np.unique(place[some][:, None] + np.arange(K)).size / lengths[template]
                if covered >= COVERAGE:
                    rows.append((doc_id, key, template, int(at[some].min()), int(at[some].max()) + K, votes, covered))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _SPAN.split(", ")])

    # a chain has no more grams than the span has places
    length = F.element_at(F.array(*[F.lit(n) for n in lengths]), F.col("template") + 1)
    enough = K * F.size("hits") >= COVERAGE * length
    return merged.where(enough).select("doc_id", "key", "template", "votes", "hits").mapInArrow(verify, _SPAN)


def licenses(docs: DataFrame) -> DataFrame:
    """Word count, base places, labels and score of each row of ``docs``.

    ``labels`` has the base labels and those of verified template spans; ``score`` is 1 if there
    is a base label, else the best coverage of a verified span, else 0. Null and blank texts have
    no word and no label; texts are scanned whole, of any length; rows that repeat get a row each,
    also with a null doc_id; other columns are not read; an empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    scanned = stored(scan(docs), "licenses")
    label = F.element_at(F.array(*[F.lit(x) for x, _ in TEMPLATES]), F.col("template") + 1)
    found = template_spans(scanned).groupBy(F.col("doc_id").alias("id"), F.col("key").alias("of")).agg(F.collect_set(label).alias("found"), F.max("coverage").alias("best"))
    both = F.array_union(F.filter(F.split("base_labels", ","), lambda x: x != ""), F.coalesce("found", F.array().cast("array<string>")))
    return scanned.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("of")), "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(F.array_sort(both), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
