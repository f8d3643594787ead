"""Exact-substring removal by fixed-block anchors.

Every window of 50 words holds a whole reference block: 25 words that start at a multiple of 25
in their document. The index has the non-overlapping reference blocks, and every rolling
25-word window of every document probes it. Probes that meet a block of another document are
anchors; an anchor is extended by up to 25 words on either side, that is to each 50-word window
around it, and runs of windows that prove equal across anchors are the maximal repeats.

1. *Frequent windows.* A sample of bounded size names windows that many documents share. Their
   least and greatest documents are taken over all documents, with partial aggregation, and every
   task then decides them itself. So a passage in a third of all documents fills no bucket.
2. *Probe.* Word hashes are rolled into 25-word hashes, dealt into buckets, four bytes of hash
   and the place each, packed by document. A bucket looks its probes up among its reference
   blocks. Four bytes inside a bucket only thin the candidates; nothing is decided here.
3. *Extend.* Documents with anchors hash their 50-word windows around these (64 bits and the
   bucket's, from independent multipliers). Equal windows meet; all but those of the smallest
   document are repeats.
4. *Remove.* The words that repeats cover go.

No pair of documents is ever made. Texts are shuffled only where a filter of fixed size says that
their document may have an anchor (3) or a repeat (4). Which windows the sample names changes where
they are decided, never what is decided.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from erawood.llm.common import CHUNK_BYTES, Members, discard, free_names, mapped, quoted, scratch_path, shuffle_width, slices, stored_at, table, text_bytes
from erawood.llm.words import MULTIPLIERS, NOT_SPACE, byte_planes, from_planes, hash_spans, rolling, spans

WINDOW = 50
#: Bytes of text whose windows meet in one bucket, about; buckets grow to four times that in tables
#: of more than so many of them.
BUCKET_BYTES = 16 << 20
BUCKETS = 1 << 14
#: Bytes of text in which frequent windows are sought, how many documents of it must share one, and
#: how many are decided apart, the most frequent first; the others go through the buckets.
SAMPLE_BYTES = 8 << 20
LEAST_SHARED = 4
MOST_FREQUENT = 1 << 16
_LOW_BITS = 22
_NONE, _NEVER = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def layout(docs: DataFrame) -> tuple[int, int, int]:
    """Bytes of all texts, the number of buckets, and the bytes of text that a task packs at a time."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = min(max(total // BUCKETS, BUCKET_BYTES), 4 * BUCKET_BYTES)
    buckets = max(shuffle_width(docs.sparkSession), -(-total // size))
    return total, buckets, min(max(48 * buckets, CHUNK_BYTES), 4 * CHUNK_BYTES)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _packed(buckets: np.ndarray, doc: np.ndarray, place: np.ndarray, value: np.ndarray | None, ids: list[np.ndarray]):
    """A blob for each bucket: for each of its documents the ids and the count, then places and values."""
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    buckets, doc, place = buckets[order], doc[order], place[order]
    value = None if value is None else value[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)]])
    numbers, blobs = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        d = doc[a:b]
        heads = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
        counts = np.diff(np.append(heads, b - a)).astype(np.uint32)
        blobs.append(
            np.array([len(heads), b - a], np.uint32).tobytes()
            + b"".join(byte_planes(x[d[heads]]) for x in ids)
            + byte_planes(counts)
            + byte_planes(place[a:b].astype(np.uint32))
            + (b"" if value is None else value[a:b].tobytes())
        )
        numbers.append(int(buckets[a]))
    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _unpacked(column: pa.ChunkedArray, n_ids: int, kind: type | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Ids, place and value of every entry of a bucket's blobs."""
    ids, places, values = [[] for _ in range(n_ids)], [], []
    for cell in column:
        blob = memoryview(cell.as_buffer())
        docs, n = np.frombuffer(blob[:8], np.uint32).tolist()
        at = 8
        found = []
        for _ in range(n_ids):
            found.append(from_planes(blob[at:], np.int64, docs))
            at += 8 * docs
        counts = from_planes(blob[at:], np.uint32, docs)
        at += 4 * docs
        for out, x in zip(ids, found):
            out.append(np.repeat(x, counts))
        places.append(from_planes(blob[at:], np.uint32, n))
        at += 4 * n
        if kind is not None:
            values.append(np.frombuffer(blob[at:], kind, n))
    return [np.concatenate(x) for x in ids], np.concatenate(places), np.concatenate(values) if values else None


_BLOBS = "bucket int, blob binary"


def _sent_home(ids: list[np.ndarray], place: np.ndarray, buckets: int) -> pa.Table:
    """Places dealt anew by document, a blob for each bucket that gets some."""
    order = np.lexsort((place, *ids[::-1]))
    ids, place = [x[order] for x in ids], place[order]
    home = ((ids[0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
    turn = np.zeros(len(place), np.int64)
    for x in ids:
        turn[1:] |= x[1:] != x[:-1]
    number = np.cumsum(turn)
    heads = np.concatenate([[0], np.flatnonzero(turn)])
    batches = list(_packed(home, number, place, None, [x[heads] for x in ids])) if len(place) else []
    return pa.Table.from_batches(batches, pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]))


def _at_home(packed: DataFrame, names: list[str]) -> DataFrame:
    """From the blobs that were sent home, one row for each document with all its places."""

    def unpack(t: pa.Table) -> pa.Table:
        ids, place, _ = _unpacked(t.column("blob"), len(names), None)
        return _by_doc(ids, place, names)

    return packed.groupBy("bucket").applyInArrow(unpack, ", ".join(f"{x} long" for x in names) + ", places binary")


def _by_doc(ids: list[np.ndarray], place: np.ndarray, names: list[str]) -> pa.Table:
    """A row for each document with its places, packed."""
    order = np.lexsort((place, *ids[::-1]))
    ids, place = [x[order] for x in ids], place[order]
    turn = np.zeros(max(len(place) - 1, 0), bool)
    for x in ids:
        turn |= x[1:] != x[:-1]
    heads = np.concatenate([[0], np.flatnonzero(turn) + 1]) if len(place) else np.zeros(0, np.int64)
    blobs = [b.tobytes() for b in np.split(place.astype(np.uint32), heads[1:])] if len(place) else []
    return pa.table([*(pa.array(x[heads]) for x in ids), pa.array(blobs, pa.binary())], [*names, "places"])


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    heads = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    return heads, np.diff(np.append(heads, len(values)))


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
    starts, ends, doc = spans(data, offsets, NOT_SPACE)
    first = np.searchsorted(doc, np.arange(part.num_rows + 1))
    return hash_spans(data, starts, ends), doc, first, np.arange(len(doc)) - first[doc]


@dataclass
class Frequent:
    """Hashes of frequent windows, sorted, and what all documents say of each.

    ``owner`` is the least document that has it as a reference block, ``least`` and ``last`` are
    the least and the greatest that have it at all.
    """

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    owner: np.ndarray | None = None
    least: np.ndarray | None = None
    last: np.ndarray | None = None

    def __post_init__(self):
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are frequent, and their places in ``hashes``."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.low[(h >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[place] == h[at]
        return at[same], place[same]


def _windows(h: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the window at each word, and the words where a whole one begins."""
    r = rolling(h, width, MULTIPLIERS[0])
    return r, np.flatnonzero(doc[: len(r)] == doc[width - 1 :]) if len(r) else np.zeros(0, np.int64)


def _mixed(r: np.ndarray) -> np.ndarray:
    return r * np.uint64(0x9E3779B97F4A7C15)


def frequent_windows(docs: DataFrame, widths: tuple[int, int], total: int) -> list[Frequent]:
    """For each width, what all documents say of the windows that many sampled documents share."""
    share = 1.0 if total <= SAMPLE_BYTES else SAMPLE_BYTES / total

    def seek(batches):
        hashes, docs_of, base = [], [], 0
        for part in slices(batches, "text", CHUNK_BYTES):
            h, doc, _, _ = _words(part)
            hashes.append(h)
            docs_of.append((doc + base).astype(np.int32))
            base += part.num_rows
        if not hashes:
            return
        h, of = np.concatenate(hashes), np.concatenate(docs_of)
        hashes.clear()
        docs_of.clear()
        for kind, width in enumerate(widths):
            r, at = _windows(h, of, width)
            if not len(at):
                continue
            r, doc = _mixed(r[at]), of[at]
            order = np.argsort(r, kind="stable")  # documents ascend among equal hashes
            r, doc = r[order], doc[order]
            del order, at
            heads, _ = _groups(r)
            first = np.ones(len(r), bool)
            first[1:] = (doc[1:] != doc[:-1]) | (r[1:] != r[:-1])
            n = np.add.reduceat(first, heads, dtype=np.int64)
            top = np.flatnonzero(n >= LEAST_SHARED)
            top = top[np.argsort(-n[top], kind="stable")[:MOST_FREQUENT]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), kind), pa.int32()), pa.array(r[heads[top]].view(np.int64))], ["kind", "hash"])

    # the sample has a bounded size, so one task may sort its windows
    sample = docs.select("text") if share == 1.0 else docs.select("text").sample(fraction=share, seed=1)
    rows = sample.repartition(1).mapInArrow(seek, "kind int, hash long").toArrow()
    kinds, hashes = rows.column("kind").to_numpy(), rows.column("hash").to_numpy().view(np.uint64)
    found = [Frequent(np.sort(hashes[kinds == k])) for k in range(len(widths))]
    if not len(hashes):
        return found

    def gather(batches):
        held = [[np.full(len(f.hashes), x) for x in (_NONE, _NONE, _NEVER)] for f in found]
        for part in slices(batches, "text", CHUNK_BYTES):
            h, doc, _, place = _words(part)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            for f, width, (owner, least, last) in zip(found, widths, held):
                r, at = _windows(h, doc, width)
                hit, which = f.find(_mixed(r[at]))
                own = ids[doc[at[hit]]]
                block = place[at[hit]] % width == 0
                np.minimum.at(owner, which[block], own[block])
                np.minimum.at(least, which, own)
                np.maximum.at(last, which, own)
        for kind, (owner, least, last) in enumerate(held):
            at = np.flatnonzero(least != _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int32()), *(pa.array(x[at]) for x in (owner, least, last))], ["kind", "i", "owner", "least", "last"])

    said = docs.select("doc_id", "text").mapInArrow(gather, "kind int, i int, owner long, least long, last long")
    all_of = said.groupBy("kind", "i").agg(F.min("owner").alias("owner"), F.min("least").alias("least"), F.max("last").alias("last")).toArrow()
    kinds, at = all_of.column("kind").to_numpy(), all_of.column("i").to_numpy()
    for k, f in enumerate(found):
        for name, empty in (("owner", _NONE), ("least", _NONE), ("last", _NEVER)):
            values = np.full(len(f.hashes), empty)
            values[at[kinds == k]] = all_of.column(name).to_numpy()[kinds == k]
            setattr(f, name, values)
    return found


def _hits(doc: np.ndarray, block: np.ndarray, owner: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which windows meet a reference block of a smaller document, or are one that a greater one meets."""
    return (doc > owner) | (block & (doc < last))


def anchors(docs: DataFrame, window: int, buckets: int, chunk: int, blocks) -> DataFrame:
    """Rows ``(doc_id, places)``: the starts of probes and blocks that met, packed; frequent ``blocks`` are left out."""
    half = window // 2

    def probes(batches):
        for part in slices(batches, "text", chunk):
            h, doc, _, place = _words(part)
            r, at = _windows(h, doc, half)
            r = _mixed(r[at])
            cold = np.ones(len(r), bool)
            cold[blocks.value.find(r)[0]] = False
            r, at = r[cold], at[cold]
            yield from _packed(_bucket(r, buckets), doc[at], place[at], (r >> np.uint64(8)).astype(np.uint32), [part.column("doc_id").to_numpy(zero_copy_only=False)])

    def meet(t: pa.Table) -> pa.Table:
        (doc,), place, value = _unpacked(t.column("blob"), 1, np.uint32)
        block = place % half == 0
        seen = np.zeros(1 << _LOW_BITS, bool)
        low = value & np.uint32((1 << _LOW_BITS) - 1)
        seen[low[block]] = True
        at = np.flatnonzero(seen[low])
        at = at[np.argsort(value[at], kind="stable")]
        doc, place, value, block = doc[at], place[at], value[at], block[at]
        if not len(at):
            return _sent_home([doc], place, buckets)
        heads, size = _groups(value)
        owner = np.repeat(np.minimum.reduceat(np.where(block, doc, _NONE), heads), size)
        last = np.repeat(np.maximum.reduceat(doc, heads), size)
        hit = _hits(doc, block, owner, last)
        return _sent_home([doc[hit]], place[hit], buckets)

    packed = docs.select("doc_id", "text").mapInArrow(probes, _BLOBS)
    return _at_home(packed.groupBy("bucket").applyInArrow(meet, _BLOBS), ["doc_id"])


class _Once:
    """Drops the copies of joined documents among the others, in tasks."""

    def __init__(self, members: Members, key: str, joined: str):
        self.members, self.key, self.joined = members, key, joined

    def __call__(self, batches):
        for batch in batches:
            key, joined = (batch.column(batch.schema.get_field_index(c)) for c in (self.key, self.joined))
            twice = ~joined.to_numpy(zero_copy_only=False) & self.members.test(key)
            yield batch.filter(pa.array(~twice)) if twice.any() else batch


class Placed:
    """Documents met with places of theirs, null for none: all in ``rows``, or in two parts.

    Documents that ``found`` may have are joined with it, and shuffled for that; the others come as
    they are. ``rows`` has the former in both ways, until ``once`` has dropped the second, which
    spares a task a second Python worker for the filter. ``keys`` are what ``docs`` has for the
    columns of ``found`` before its places.
    """

    def __init__(self, docs: DataFrame, found: DataFrame, keys: list, columns: list[str]):
        members = Members(found, found.columns[0])
        key, self.places, joined = free_names(columns, "id", "places", "joined")
        self.once = _Once(members, key, joined)
        own = [*map(quoted, columns), keys[0].alias(key)]
        renamed = free_names(docs.columns, *found.columns)
        match = keys[0] == F.col(renamed[0])
        for key, name in zip(keys[1:], renamed[1:-1]):
            match = match & (key == F.col(name))
        maybe = members.maybe(keys[0])
        home = found.toDF(*renamed).hint("merge")
        self.touched = docs.where(maybe).join(home, match, "left").select(*own, F.col(renamed[-1]).alias(self.places), F.lit(True).alias(joined))
        self.rest = docs.where(~maybe).select(*map(quoted, columns))
        every = docs.select(*own, F.lit(None).cast("binary").alias(self.places), F.lit(False).alias(joined))
        self.rows = self.touched.unionByName(every)


def repeats(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Rows ``(doc_id, text_hash, places)``, stored at ``path``: starts of the windows that a smaller document has too.

    ``text_hash`` tells apart rows that repeat a doc_id with another text; such rows never remove
    each other's words. Rows with a null doc_id take no part.
    """
    half = window // 2
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total, buckets, chunk = layout(docs)
    spark = docs.sparkSession
    blocks, windows = (spark.sparkContext.broadcast(f) for f in frequent_windows(docs, (half, window), total))
    found_path = scratch_path(spark, "anchors")
    found = stored_at(anchors(docs, window, buckets, chunk, blocks), found_path)
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    placed = Placed(docs, found, [F.col("doc_id")], ["doc_id", "text_hash", "text"])
    once, held = placed.once, placed.places

    def extend(batches):
        for part in slices(once(batches), "text", chunk):
            h, doc, first, place = _words(part)
            r, at = _windows(h, doc, window)
            if not len(at):
                continue
            ids = [part.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "text_hash")]
            near = np.zeros(len(h) + 1, np.int64)
            anchored = np.zeros(len(h), bool)
            places = part.column(held)
            for d in np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False)):
                a = np.frombuffer(places[int(d)].as_buffer(), np.uint32).astype(np.int64)
                anchored[first[d] + a[a < first[d + 1] - first[d]]] = True
            if len(blocks.value.hashes):
                s, begin = _windows(h, doc, half)
                hit, which = blocks.value.find(_mixed(s[begin]))
                hit = begin[hit]
                anchored[hit[_hits(ids[0][doc[hit]], place[hit] % half == 0, blocks.value.owner[which], blocks.value.last[which])]] = True
            a = np.flatnonzero(anchored)
            np.add.at(near, np.maximum(a - half, first[doc[a]]), 1)
            np.add.at(near, a + 1, -1)
            at = at[np.cumsum(near)[at] > 0]
            hit, which = windows.value.find(_mixed(r[at]))
            again = at[hit[ids[0][doc[at[hit]]] > windows.value.least[which]]] if len(hit) else hit
            yield from _kept_home([x[doc[again]] for x in ids], place[again], buckets)
            cold = np.ones(len(at), bool)
            cold[hit] = False
            at = at[cold]
            other = rolling(h, window, MULTIPLIERS[1])[at] * np.uint64(0xC2B2AE3D27D4EB4F)
            yield from _packed(_bucket(other, buckets), doc[at], place[at], r[at], ids)

    def compare(t: pa.Table) -> pa.Table:
        if t.column("bucket")[0].as_py() < 0:  # decided already
            return t.set_column(0, "bucket", pc.subtract(-1, t.column("bucket")).cast(pa.int32()))
        (doc, text), place, value = _unpacked(t.column("blob"), 2, np.uint64)
        at = np.argsort(value, kind="stable")
        heads, size = _groups(value[at])
        least = np.repeat(np.minimum.reduceat(doc[at], heads), size)
        at = at[doc[at] > least]
        return _sent_home([doc[at], text[at]], place[at], buckets)

    searched = placed.rows if len(blocks.value.hashes) else placed.touched
    packed = searched.mapInArrow(extend, _BLOBS).groupBy("bucket").applyInArrow(compare, _BLOBS)
    out = stored_at(_at_home(packed, ["doc_id", "text_hash"]), path)
    discard(spark, found_path)
    return out


def _kept_home(ids: list[np.ndarray], place: np.ndarray, buckets: int):
    """Places that are decided, for their documents' buckets; these have negative numbers on the way."""
    for batch in _sent_home(ids, place, buckets).to_batches():
        yield batch.set_column(0, "bucket", pc.subtract(-1, batch.column("bucket")).cast(pa.int32()))


def _covered(places: pa.Scalar, n: int, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``places``."""
    edge = np.zeros(n + 1, np.int64)
    a = np.frombuffer(places.as_buffer(), np.uint32).astype(np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, a + window, -1)
    return np.cumsum(edge)[:n] > 0


def _with_places(docs: DataFrame, window: int) -> Placed:
    """``docs`` with the starts of the windows that a smaller document has."""
    found = repeats(docs, scratch_path(docs.sparkSession, "repeats"), window)
    return Placed(docs, found, [F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))], docs.columns)


def _texts(part: pa.RecordBatch, places: str, window: int):
    """Words of each text, and which of them go; None if none does."""
    texts = part.column(part.schema.get_field_index("text")).cast(pa.string()).fill_null("").cast(pa.binary())
    held = part.column(part.schema.get_field_index(places))
    for d in range(part.num_rows):
        w = texts[d].as_py().split()
        gone = _covered(held[d], len(w), window) if held[d].is_valid else None
        yield w, gone if gone is not None and gone.any() else None


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_removed, spans (array of {start, end} in words, end exclusive) and kept_text.

    ``kept_text`` is the kept words joined by one space. Null and blank texts have no word and an
    empty kept_text; rows with a null doc_id keep all their words; rows that repeat a doc_id and
    text are each judged, and never by each other; texts are read whole, of any length; an empty
    table gives an empty result. Columns of ``docs`` that clash with these four are replaced, all
    others go through, whatever their names.
    """
    made = StructType.fromDDL("n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string")
    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in made.fieldNames()])
    placed = _with_places(docs, window)
    once, places, docs_columns = placed.once, placed.places, docs.columns
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches):
        for part in slices(once(batches), "text", CHUNK_BYTES):
            n_words, n_removed, runs, kept = [], [], [], []
            for w, gone in _texts(part, places, window):
                n_words.append(len(w))
                n_removed.append(0 if gone is None else int(gone.sum()))
                edge = [] if gone is None else np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
                runs.append([{"start": int(a), "end": int(b)} for a, b in edge])
                kept.append(b" ".join(w if gone is None else [w[i] for i in np.flatnonzero(~gone)]))
            own = [part.column(i) for i in range(len(docs_columns))]
            columns = [*own, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*docs_columns, *made.fieldNames()])

    return mapped(placed.rows, remove, StructType([*docs.schema.fields, *made.fields]))


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """As ``without_repeats``, but with the SHA-256 of the kept text in place of texts and spans."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = _with_places(keyed, window)
    once, places = placed.once, placed.places

    def remove(batches):
        for part in slices(once(batches), "text", CHUNK_BYTES):
            n_words, n_removed, digest = [], [], []
            for w, gone in _texts(part, places, window):
                n_words.append(len(w))
                n_removed.append(0 if gone is None else int(gone.sum()))
                digest.append(hashlib.sha256(b" ".join(w if gone is None else [w[i] for i in np.flatnonzero(~gone)])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    return placed.rows.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def keep_unrepeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; texts without one stay as they are.

    ``n_chars`` follows, if there is one. Documents that consist of repeated passages alone go.
    Null and blank texts, null ids, repeated rows, long texts, empty tables and other columns: as
    in ``without_repeats``, but that nothing is added.
    """
    placed = _with_places(docs, window)
    places = placed.places
    cut, gone_name = free_names(placed.touched.columns, "cut_text", "gone")

    def remove(batches):
        for part in slices(batches, "text", CHUNK_BYTES):
            kept, none_left = [], []
            for w, gone in _texts(part, places, window):
                kept.append(None if gone is None else b" ".join([w[i] for i in np.flatnonzero(~gone)]))
                none_left.append(gone is not None and bool(gone.all()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(none_left)], [*part.schema.names, cut, gone_name])

    schema = StructType([*placed.touched.schema.fields, *StructType.fromDDL(f"`{cut}` string, `{gone_name}` boolean").fields])
    out = mapped(placed.touched, remove, schema).where(~F.col(gone_name))
    new = F.col(cut)
    columns = []
    for c in docs.columns:
        kind = docs.schema[c].dataType
        if c == "text":
            columns.append(F.coalesce(new.cast(kind), quoted(c)).alias(c))
        elif c == "n_chars":
            columns.append(F.coalesce(F.length(new).cast(kind), quoted(c)).alias(c))
        else:
            columns.append(quoted(c))
    return out.select(*columns).unionByName(placed.rest)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) h from (select doc_id, w, unnest(range(1, len(w) - 48)) i from w)),
m as (select h, min(doc_id) m from s group by h),
v as (select distinct doc_id, i + j p from s join m using (h), range(50) x(j) where m < doc_id),
g as (select doc_id, list(p) gone from v group by 1)
select doc_id, len(w)::bigint n_words, coalesce(len(gone), 0)::bigint n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: gone is null or not list_contains(gone, i)), ' ')) kept_sha256
from w left join g using (doc_id)
"""
