"""Near-duplicate documents by SimHash with a byte-position inverted index.

A fingerprint is eight bytes. Two fingerprints that differ in at most three bits agree in at
least five of the eight byte positions, so five shared positional bytes are the guaranteed
minimum. A posting list of one positional byte would hold 1/256 of the corpus; the index
therefore posts three positional bytes at a time: of five shared positions three lie in one half
of the fingerprint, and the four triples of each half make eight lists per fingerprint that miss
nothing. Inside a list the shared positional bytes of a pair are tallied, pairs below five go, and
the rest are verified bit by bit.

A list is searched breadth first and gives the edges of a spanning forest, never all its pairs.
Lists of more than ``BLOCK`` fingerprints are posted again with one more byte position, of which
the pairs that are sought share two more, and once again if that is not enough; what then still is
longer is dealt into blocks and searched block against block, so no task holds a whole hot list.
Equal fingerprints are one node from the start.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erawood.llm.common import CHUNK_BYTES, Members, cut, free_names, quoted, slices, table
from erawood.llm.components import connected_components

MAX_BITS = 3
#: Byte positions that two linked fingerprints share at least.
LEAST_SHARED = 8 - MAX_BITS
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Rows of a posting list that are searched together; longer lists are dealt into blocks.
BLOCK = 4096
_PIECE = 1 << 20
_WHITE = b" \t\n\x0b\x0c\r"


def _word_blocks(text: bytes):
    """The words of a text, about a megabyte at a time."""
    at, n = 0, len(text)
    while at < n:
        end = min(at + _PIECE, n)
        while end < n and text[end] not in _WHITE:
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of the ``width``-word shingles of a text; zero if it has no word."""
    ones, total, kept = np.zeros(64, np.int64), 0, []
    for words in _word_blocks(text.lower()):
        words = kept + words
        if len(words) >= width:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
            h = np.array(list(map(xxhash.xxh64_intdigest, shingles, repeat(seed))), np.uint64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
            total += len(h)
            kept = words[1 - width :]
        else:
            kept = words
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(kept), seed) if kept else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, text_hash, fp)``: the fingerprint as a signed long."""

    def run(batches):
        for part in slices(batches, "text", CHUNK_BYTES):
            texts = part.column("text").fill_null("").cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(fp: np.ndarray, node: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the fingerprints of a list."""
    edges, rest = [], np.arange(len(fp))
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            rest = rest[1:]
            continue
        at = queue.pop()
        differ = fp[rest] ^ fp[at]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        near = (shared >= LEAST_SHARED) & (np.bitwise_count(differ) <= MAX_BITS)
        found = rest[near]
        if len(found):
            edges.extend((int(node[at]), int(node[i])) for i in found)
            queue.extend(found.tolist())
            rest = rest[~near]
    return edges


def _search(batches):
    """Rows sorted by list: the forest edges of each list, whose rows may run on into the next batch."""
    held = None
    for batch in _then_none(batches):
        now = None if batch is None else np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
        if now is not None and held is not None:
            now = np.concatenate([held, now], axis=1)
        rows = held if now is None else now
        if rows is None or not rows.shape[1]:
            continue
        key = rows[:3]
        turn = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        bounds = np.concatenate([[0], turn, [rows.shape[1]]])
        if now is not None:  # the last list may go on
            held = rows[:, bounds[-2] :].copy()
            bounds = bounds[:-1]
        size = np.diff(bounds)
        fp, node = rows[3].view(np.uint64), rows[4]
        at = bounds[:-1][size == 2]
        differ = fp[at] ^ fp[at + 1]
        linked = at[((differ.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= LEAST_SHARED) & (np.bitwise_count(differ) <= MAX_BITS)]
        a, b = [node[linked]], [node[linked + 1]]
        for i in np.flatnonzero(size > 2):
            if found := _forest(fp[bounds[i] : bounds[i + 1]], node[bounds[i] : bounds[i + 1]]):
                x = np.array(found, np.int64)
                a.append(x[:, 0])
                b.append(x[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _then_none(batches):
    yield from batches
    yield None


def _byte_mask(positions: int) -> int:
    """The bits of the byte positions that ``positions`` has as a set."""
    return sum(0xFF << (8 * p) for p in range(8) if positions >> p & 1)


def _finer(sets: list[int], wanted: int) -> dict[int, list[int]]:
    """For each position set, ``wanted`` sets with one position more."""
    return {x: [x | 1 << p for p in range(8) if not x >> p & 1][:wanted] for x in sets}


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges ``(a, b)`` over nodes ``(node, fp)`` with distinct fingerprints that join all that are linked.

    A pair shares five positions. Of those in a list of three it so shares two of the other five,
    one at least of any four of these; in a list of four it shares one of the other four.
    """
    sets = [sum(1 << p for p in t) for t in TRIPLES]
    posted = _post(nodes, sets)
    rows = None
    for wanted in (LEAST_SHARED - 1, LEAST_SHARED - 1, 0):
        sizes = cut(posted.groupBy("list", "bytes").agg(F.count("*").alias("n")).where("n > 1"))
        dealt = posted.join(sizes, ["list", "bytes"])
        small = dealt.where(F.col("n") <= block).select("list", "bytes", F.lit(0).cast("long").alias("pair"), "fp", "node")
        rows = small if rows is None else rows.unionByName(small)
        hot = sizes.where(F.col("n") > block)
        if hot.isEmpty():
            break
        dealt = posted.join(hot, ["list", "bytes"])
        if not wanted:
            rows = rows.unionByName(_block_pairs(dealt, block))
            break
        finer = _finer(sets, wanted)
        sets = sorted({y for x in finer.values() for y in x})
        posted = _post_finer(dealt, finer)
    return rows.repartition("list", "bytes", "pair").sortWithinPartitions("list", "bytes", "pair", "node").mapInArrow(_search, "a long, b long")


def _posting(x: int):
    return F.struct(F.lit(x).cast("long").alias("list"), F.col("fp").bitwiseAND(F.lit(_signed(_byte_mask(x)))).alias("bytes"))


def _post(nodes: DataFrame, sets: list[int]) -> DataFrame:
    """A row ``(list, bytes, fp, node)`` for each node and position set; the set is the list's number."""
    return nodes.select(F.explode(F.array(*map(_posting, sets))).alias("p"), "fp", "node").select("p.list", "p.bytes", "fp", "node")


def _post_finer(hot: DataFrame, finer: dict[int, list[int]]) -> DataFrame:
    """The rows of hot lists in the finer lists of these, once each."""
    chosen = None
    for x, ys in finer.items():
        made = F.array(*map(_posting, ys))
        chosen = F.when(F.col("list") == x, made) if chosen is None else chosen.when(F.col("list") == x, made)
    return hot.select(F.explode(chosen).alias("p"), "fp", "node").select("p.list", "p.bytes", "fp", "node").distinct()


def _block_pairs(hot: DataFrame, block: int) -> DataFrame:
    """The rows of each list dealt into blocks, in a copy for each pair of blocks that theirs is in."""
    rows = hot.withColumn("blocks", F.ceil(F.col("n") / block).cast("long")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    pairs = F.expr("transform(filter(sequence(0L, blocks - 1), j -> j != own), j -> shiftleft(least(j, own), 31) + greatest(j, own))")
    return rows.select("list", "bytes", F.explode(pairs).alias("pair"), "fp", "node")


def _grouped(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, text_hash, fp, component_id)``, one for each row of ``docs``."""
    of = cut(fingerprints(docs))
    same = of.groupBy("fp").agg(F.min("doc_id").alias("node"))
    nodes = cut(same.where("node is not null"))
    root = connected_components(links(nodes))
    of_fp = nodes.join(root, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return of.join(of_fp, "fp", "left").select("doc_id", "text_hash", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, fingerprint, component_id)``, one for each row of ``docs``.

    Null and blank texts have fingerprint zero and are linked like others. Texts are read whole, a
    megabyte at a time. Rows that repeat a doc_id each get their own row; the smallest doc_id of
    what they reach is the component. Rows with a null doc_id are fingerprinted and take the
    component of documents with an equal fingerprint (null if there is none) but link nothing. An
    empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    return _grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without all but the smallest doc_id of each component; rows without doc_id stay.

    A row goes by its doc_id and text, so that another text of the same doc_id stays if it is of
    another component; rows that repeat both share their fate. Nulls, blanks, long texts and empty
    tables: as in ``near_duplicates``. Columns go through, whatever their names. Texts are shuffled
    only where a filter of fixed size says that their document may go.
    """
    gone = cut(_grouped(docs).where("doc_id != component_id").select("doc_id", "text_hash").distinct())
    maybe = Members(gone, "doc_id").maybe(F.col("doc_id"))
    a, b = free_names(docs.columns, "doc_id", "text_hash")
    match = (F.col("doc_id").cast("long") == F.col(a)) & (F.xxhash64(F.col("text").cast("string")) == F.col(b))
    left = docs.where(maybe).join(gone.toDF(a, b).hint("merge"), match, "left_anti")
    return docs.where(~maybe).unionByName(left).select(*map(quoted, docs.columns))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
