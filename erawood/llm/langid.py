"""Languages of documents as mixtures.

Each language has a distribution over hashed byte n-grams (three bytes, with word edges), fitted
on a bounded sample of labelled rows, drawn for each label apart so that rare labels are in it. A
distribution is mixed with that of all labels and the uniform one in the same parts for each
language, so n-grams that no label has seen speak for none, however little a label was fitted on.
A document's n-grams are taken as drawn from a mixture of the languages; expectation-maximisation
estimates the proportions, and the set of languages is selected by penalised likelihood: languages
go, weakest first, while that lowers the log-likelihood by less than the penalty of half the log
of the evidence for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erawood.llm.common import mapped, quoted, slices, table, text_bytes

#: Hashed n-grams; with more languages than so many, each has fewer, which bounds the model.
BUCKETS = 1 << 16
WIDE_LANGUAGES = 512
LEAST_BUCKETS = 1 << 12
#: Labelled rows, about, that the model is fitted on; and of each label, if it has as many.
TRAIN_ROWS = 20_000
LABEL_ROWS = 200
#: Parts of the pooled and of the uniform distribution in each language's.
POOLED, UNIFORM = 0.02, 0.001
#: Proportions that move less in a step have converged.
CONVERGED = 1e-3
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Bytes that aren't part of a letter of any script count as edges.
_EDGE = np.ones(256, bool)
_EDGE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def bucket_count(languages: int) -> int:
    n = BUCKETS
    while n > LEAST_BUCKETS and n * languages > BUCKETS * WIDE_LANGUAGES:
        n //= 2
    return n


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each trigram of letter bytes; runs of other bytes are one edge."""
    size = np.diff(offsets)
    doc = np.repeat(np.arange(len(size)), size)
    edge = _EDGE[data]
    low = _LOWER[data].astype(np.uint32)
    low[edge] = 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(edge[1:] & edge[:-1] & (doc[1:] == doc[:-1]))
    low, doc = low[keep], doc[keep]
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]
    same = doc[2:] == doc[:-2]
    key = (key * np.uint32(0x9E3779B1)) >> np.uint32(33 - buckets.bit_length())
    return key[same].astype(np.int64), doc[2:][same]


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([t is not None and (any(map(str.isalpha, t[:256])) or any(map(str.isalpha, t))) for t in texts], bool)


class LanguageModel:
    """Distributions of the languages that were learned; a label whose rows have no n-gram is not."""

    def __init__(self, names: list[str], counts: np.ndarray):
        seen = counts.sum(1) > 0
        self.names = [n for n, x in zip(names, seen) if x]
        self.buckets = counts.shape[1]
        p = counts[seen].astype(np.float64)
        p /= p.sum(1, keepdims=True)
        pooled = p.mean(0, keepdims=True) if len(p) else p
        p = (1 - POOLED - UNIFORM) * p + POOLED * pooled + UNIFORM / self.buckets
        self.p = np.ascontiguousarray(p.T).astype(np.float32)

    def mixture(self, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Proportions of the selected languages (zero for the others)."""
        k = len(self.names)
        p = self.p[bucket].astype(np.float64)
        chosen = np.arange(k)
        pi, fit = self._em(p, count)
        penalty = 0.5 * np.log(max(count.sum(), 2.0))
        while len(chosen) > 1:
            weak = len(pi) - 1 - int(np.argmin(pi[::-1]))  # of equals the last goes
            rest = np.delete(np.arange(len(chosen)), weak)
            pi_less, fit_less = self._em(p[:, rest], count, np.delete(pi, weak))
            if fit - fit_less > penalty:
                break
            chosen, p, pi, fit = chosen[rest], p[:, rest], pi_less, fit_less
        out = np.zeros(k)
        out[chosen] = pi
        return out

    @staticmethod
    def _em(p: np.ndarray, count: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        k = p.shape[1]
        if k == 1:
            return np.ones(1), float(count @ np.log(p[:, 0]))
        pi = np.full(k, 1.0 / k) if start is None or start.sum() <= 0 else 0.9 * start / start.sum() + 0.1 / k
        total = count.sum()
        moved = 1.0
        while moved >= CONVERGED:
            mixed = p @ pi
            new = pi * ((count / mixed) @ p) / total
            moved = np.abs(new - pi).max()
            pi = new
        return pi, float(count @ np.log(p @ pi))


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, label_rows: int = LABEL_ROWS) -> LanguageModel | None:
    """The model of labelled rows ``(text, lang)``; None if no label can be learned.

    About ``train_rows`` rows are used, as many of each label, but ``label_rows`` of each at least
    or all that it has, drawn by a hash of the text. Rows with a null text or label are left out,
    and labels without an n-gram are not learned. Rows that repeat are drawn together.
    """
    labelled = labelled.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not names:
        return None
    buckets = bucket_count(len(names))
    wanted = max(label_rows, train_rows // len(names))
    rates = [(x, i, int((1 << 30) * min(1.0, wanted / sizes[x]))) for i, x in enumerate(names)]
    rated = labelled.join(F.broadcast(labelled.sparkSession.createDataFrame(rates, "lang string, place int, rate int")), "lang")
    drawn = rated.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30)) < F.col("rate")).select("text", "place")

    def count(batches):
        total = np.zeros((len(names), buckets), np.int32)
        for part in slices(batches):
            bucket, doc = grams(*text_bytes(part.column("text")), buckets)
            lang = part.column("place").to_numpy().astype(np.int64)
            np.add.at(total.ravel(), lang[doc] * buckets + bucket, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at].astype(np.int64))], ["at", "n"])

    rows = drawn.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(names) * buckets)
    counts[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    model = LanguageModel(names, counts.reshape(len(names), buckets))
    return model if model.names else None


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``languages``, the proportions of the selected set.

    Only ``text`` is read, whole, of any length. A null text, one without a letter, or a missing
    model gives ``und`` with score 0 and no proportions. Of languages in equal proportions the first of
    the model is predicted, that is the label with the most rows, then the first by name. Repeated rows are judged one by one; an empty table gives an empty
    result. Columns of ``docs`` that clash with the three are replaced, all others go through.
    """
    from pyspark.sql.types import StructType

    made = "lang_pred string, score double, languages map<string,double>"
    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in ("lang_pred", "score", "languages")])
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(made).fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        buckets = model.buckets if model else BUCKETS
        for part in slices(batches):
            texts = part.column(part.schema.get_field_index("text")).cast(pa.string())
            lettered = has_letter(texts.to_pylist())
            bucket, doc = grams(*text_bytes(texts), buckets)
            keys = doc * buckets + bucket
            distinct, count = np.unique(keys.astype(np.int32) if part.num_rows * buckets < 1 << 31 else keys, return_counts=True)
            first = np.searchsorted(distinct, np.arange(part.num_rows + 1) * buckets)
            pred, score, mixes = [], [], []
            for d in range(part.num_rows):
                if model is None or not lettered[d]:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    mixes.append([])
                    continue
                at = slice(first[d], first[d + 1])
                if first[d] == first[d + 1]:  # too short for an n-gram: no evidence
                    pi = np.full(len(model.names), 1.0 / len(model.names))
                else:
                    pi = model.mixture(distinct[at] % buckets, count[at].astype(np.float64))
                best = int(np.argmax(pi))
                pred.append(model.names[best])
                score.append(float(min(max(pi[best], 0.0), 1.0)))
                mixes.append([(model.names[i], float(pi[i])) for i in np.flatnonzero(pi)])
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(mixes, pa.map_(pa.string(), pa.float64()))],
                [*part.schema.names, "lang_pred", "score", "languages"],
            )

    return mapped(docs, run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = fit(docs.where(third != 1).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
