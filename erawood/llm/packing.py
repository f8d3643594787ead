"""Sequence packing by lexical retrieval.

Documents are dealt into shards by content: a document's two keys are weighted minima of hashes
over its token ids, rarer ids (those with greater numbers in the vocabulary) counting more, so that
documents with much text in common have the same key often, and lie side by side. Each shard, a run
of documents in the order of their keys, has its own BM25 inverted index over token ids. A seed
document opens a window; all its terms rank the shard's unused documents, and the best of them
fill the window one after the other. What doesn't fit is cut and opens the next window, whose seed
it then is. Windows go on from shard to shard; only the last of a part, some thousand of them, is
cut at powers of two, and needs no padding either.

Parts are streamed, so a task holds one shard: ``SHARD_DOCS`` documents and ``SHARD_TOKENS`` ids at
most, or one document. Keys that many documents have are split by the second key, and pairs of keys
that fill parts, as groups of copies do, by a hash; how much text each key has is counted over all
documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erawood.llm.bpe import PieceMemory, encoded, laid_out, load, tokenizer_path
from erawood.llm.common import CHUNK_BYTES, slices, stored, table

SEQUENCE = 2048
END_ID = 1
#: What a shard holds at most: the cost of filling windows grows with the square of the first.
SHARD_DOCS = 512
SHARD_TOKENS = 1 << 20
#: Bytes of ids of a part, about; parts grow up to 64 times where there would be more of them.
PART_BYTES = 16 << 20
PARTS = 1 << 14
#: Pairs of keys that are split by a hash, the largest first.
HEAVY_PAIRS = 1 << 16
K1, B = 1.2, 0.75
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _kind(path: str) -> str:
    return "<u2" if load(path).library.get_vocab_size() <= 1 << 16 else "<u4"


def key_ranks(size: int, seed: int) -> np.ndarray:
    """A rank for each id of a vocabulary; the least rank of a text's ids is its key.

    Ranks follow exponential races whose rates grow with the id, so that rare ids win more often.
    """
    rng = np.random.default_rng(seed)
    order = np.argsort(rng.exponential(size=size) / (np.arange(size) + 1.0), kind="stable")
    out = np.empty(size, np.int32)
    out[order] = np.arange(size)
    return out


def _least(ranks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The least rank of each document; -1 for one without ids."""
    out = np.full(len(bounds) - 1, -1, np.int32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.minimum.reduceat(ranks, bounds[:-1][full])
    return out


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """Rows ``(doc_id, key1, key2, ids)`` with each text's ids as packed little-endian integers."""

    def run(batches):
        bpe, kind = load(path), _kind(path)
        size = int(kind[2])
        ranks = [key_ranks(bpe.library.get_vocab_size(), seed) for seed in (1, 2)]
        memory = PieceMemory(lambda piece: np.array(bpe.encode_piece(piece), kind).tobytes())
        for part in slices(batches, "text", CHUNK_BYTES):
            _, known, which, _, first, unsure, _ = encoded(part, bpe, memory)
            ids, upto = laid_out(known, kind, which)
            bounds = upto[first]
            if unsure.any():
                blobs = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                for d in np.flatnonzero(unsure):
                    blobs[d] = np.array(bpe.encode(part.column("text")[d].as_py()), kind).tobytes()
                ids = np.frombuffer(b"".join(blobs), kind)
                bounds = np.concatenate([[0], np.cumsum(list(map(len, blobs)))]) // size
            made = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((bounds * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
            keys = [pa.array(_least(r[ids], bounds)) for r in ranks]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *keys, made], ["doc_id", "key1", "key2", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, key1 int, key2 int, ids binary")


def parts_of(sizes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """Of each key its first part and the number of its parts; small keys share one."""
    out, part, filled = [], 0, 0
    for key in sorted(sizes):
        n = -(-sizes[key] // most)
        if filled and (n > 1 or filled + sizes[key] > most):
            part, filled = part + 1, 0
        out.append((key, part, max(n, 1)))
        if n > 1:
            part += n
        else:
            filled += sizes[key]
    return out


def slots(spark: SparkSession, count: int) -> DataFrame:
    """``(part, slot)``: for each of ``count`` parts a number that Spark's hash deals to a partition of its own."""
    tries = count * (2 * count.bit_length() + 8)
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(count)).alias("part")
    return spark.range(tries).select(F.col("id").cast("int").alias("id"), place).groupBy("part").agg(F.min("id").alias("slot"))


def dealt(tokens: DataFrame) -> tuple[DataFrame, int]:
    """``tokens`` with ``part`` and ``slot``, and the number of parts."""
    spark = tokens.sparkSession
    weight = F.octet_length("ids") + 2
    # one row for each id of the vocabulary at most
    sizes = {r["key1"]: r["n"] for r in tokens.groupBy("key1").agg(F.sum(weight).alias("n")).collect()}
    most = min(max(sum(sizes.values()) // PARTS, PART_BYTES), 64 * PART_BYTES)
    places = parts_of(sizes, most)
    count = max((first + n for _, first, n in places), default=1)
    of_key = spark.createDataFrame(places, "key1 int, first int, n int")
    split = [k for k, _, n in places if n > 1]
    part = F.col("first")
    out = tokens.join(F.broadcast(of_key), "key1")
    if split:
        wide = spark.createDataFrame([(k,) for k in split], "key1 int")
        pairs = tokens.select("key1", "key2", weight.alias("w")).join(F.broadcast(wide), "key1").groupBy("key1", "key2").agg(F.sum("w").alias("w"))
        heavy = pairs.where(F.col("w") > most).orderBy(F.desc("w"), "key1", "key2").limit(HEAVY_PAIRS).select("key1", "key2", F.lit(True).alias("heavy"))
        by = F.when(F.col("heavy"), F.xxhash64("doc_id", F.crc32("ids"))).otherwise(F.xxhash64("key2"))
        out = out.join(F.broadcast(heavy), ["key1", "key2"], "left")
        part = part + F.pmod(by, F.col("n")).cast("int")
    out = out.select("doc_id", "key1", "key2", "ids", part.alias("part"))
    return out.join(F.broadcast(slots(spark, count)), "part", "left"), count


class Index:
    """BM25 over the token ids of a shard's documents; terms that one document has alone are left out."""

    def __init__(self, docs: list[np.ndarray]):
        n = self.n = len(docs)
        size = np.array(list(map(len, docs)), np.int64)
        ids = np.concatenate([*docs, np.zeros(0, np.uint16)])
        shift = max(int(ids.max(initial=0)).bit_length(), 1)
        kind = np.uint32 if n << shift < 1 << 32 else np.uint64
        keys, tf = np.unique(np.repeat(np.arange(n, dtype=kind), size) << kind(shift) | ids.astype(kind), return_counts=True)
        doc, term = (keys >> kind(shift)).astype(np.int64), (keys & kind((1 << shift) - 1)).astype(np.int64)
        df = np.bincount(term, minlength=1)
        shared = df[term] > 1
        doc, term, tf = doc[shared], term[shared], tf[shared]
        used, row = np.unique(term, return_inverse=True)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / max(size.mean(), 1e-9) if n else 1))
        self.weights = np.zeros((len(used), n), np.float32)
        self.weights[row, doc] = weight
        self.rows, self.first = row, np.searchsorted(doc, np.arange(n + 1))

    def scores(self, d: int) -> np.ndarray:
        """Of all documents for the distinct terms of document ``d``."""
        return self.weights[self.rows[self.first[d] : self.first[d + 1]]].sum(0)


def retrieval_order(docs: list[np.ndarray], window: int, extra: int = 1, filled: int = 0) -> list[int]:
    """The order in which documents (of their length plus ``extra``) fill windows, the first of which has ``filled`` ids.

    Of documents with equal scores the first comes first.
    """
    index, unused, order = Index(docs), np.ones(len(docs), bool), []
    at, nxt, seed, scores = filled, 0, -1, None
    for _ in range(len(docs)):
        best = -1
        if seed >= 0:
            if scores is None:
                scores = index.scores(seed)
                scores[~unused] = -1
            best = int(np.argmax(scores))
            if scores[best] <= 0:
                best = -1
        if best < 0:
            while not unused[nxt]:
                nxt += 1
            best = nxt
            if seed < 0:
                seed, scores = best, None
        unused[best] = False
        if scores is not None:
            scores[best] = -1
        before = at
        at += len(docs[best]) + extra
        order.append(best)
        if before // window != at // window:  # a document that was cut opens the next window
            seed, scores = best if at % window else -1, None
    return order


class Windows:
    """Fills the windows of a part; rows are ready when their window is full or the part ends."""

    def __init__(self, part: int, window: int, end_id: int):
        self.base, self.window, self.end_id = part << 32, window, end_id
        self.k = self.filled = 0
        self.open: list[tuple] = []
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = np.append(ids.astype("<u4"), np.uint32(self.end_id)).astype("<u4")
        done = 0
        while done < len(whole):
            n = min(len(whole) - done, self.window - self.filled)
            self.open.append((doc_id, done, whole[done : done + n], len(whole)))
            self.filled += n
            done += n
            if self.filled == self.window:
                self._close([self.window])

    def end(self) -> None:
        """Cuts what is left at powers of two, the largest first."""
        sizes, left = [], self.filled
        while left:
            sizes.append(1 << (left.bit_length() - 1))
            left -= sizes[-1]
        self._close(sizes)

    def _close(self, sizes: list[int]) -> None:
        pieces = iter(self.open)
        doc_id, start, ids, total = next(pieces, (None, 0, np.zeros(0, "<u4"), 0))
        for size in sizes:
            at = 0
            while at < size:
                if not len(ids):
                    doc_id, start, ids, total = next(pieces)
                n = min(len(ids), size - at)
                self.rows.append((doc_id, start, n, zlib.crc32(ids[:n].tobytes()), total, self.base + self.k, at))
                start, ids, at = start + n, ids[n:], at + n
            self.k += 1
        self.open, self.filled = [], 0

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(_NAMES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)


def pack_stream(batches, kind: str, window: int, end_id: int, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS):
    """Rows of pieces from documents in the order of their parts and keys, a shard in memory at a time."""
    windows, held, names, tokens = None, [], [], 0

    def fill() -> None:
        for d in retrieval_order(held, window, 1, windows.filled):
            windows.add(names[d], held[d])
        held.clear()
        names.clear()

    for batch in batches:
        parts, ids = batch.column("part").to_numpy(), batch.column("doc_id").to_pylist()
        for i, cell in enumerate(batch.column("ids")):
            if windows is None or windows.base >> 32 != parts[i]:
                if windows is not None:
                    fill()
                    windows.end()
                    yield windows.taken()
                windows, tokens = Windows(int(parts[i]), window, end_id), 0
            doc = np.frombuffer(cell.as_buffer(), kind)
            if held and (len(held) == shard_docs or tokens + len(doc) > shard_tokens):
                fill()
                tokens = 0
                yield windows.taken()
            held.append(doc)
            names.append(ids[i])
            tokens += len(doc)
    if windows is not None:
        fill()
        windows.end()
        yield windows.taken()


def packed(docs: DataFrame, path: str | None = None, window: int = SEQUENCE, end_id: int = END_ID, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row for each piece of each document: where it lies in its document and in its sequence.

    Null and empty texts consist of ``end_id`` alone. Rows that repeat are packed each for
    itself, with a null doc_id too. Texts are tokenized whole; one longer than a shard is a shard
    by itself. Ties go by the order of keys, doc_id and ids, so that results are the same in each
    run. Other columns are not read. An empty table gives no piece.
    """
    if window < 1:
        raise ValueError("window must be positive")
    path = path or tokenizer_path()
    tokens, count = dealt(stored(token_ids(docs, path), "tokens"))

    def run(batches):
        yield from pack_stream(batches, _kind(path), window, end_id, shard_docs)

    rows = tokens.repartition(count, "slot").sortWithinPartitions("part", "key1", "key2", "doc_id", "ids")
    return rows.select("part", "doc_id", "ids").mapInArrow(run, _SCHEMA)


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
