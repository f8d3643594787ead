"""Byte-level BPE over whole tables: vectorised pre-tokenization, and exact counts at every prefix.

The pieces that the pre-tokenizer cuts are found for a whole slice of texts with numpy; each
distinct piece is encoded once and remembered by a 64-bit hash. Texts with a character whose
class differs between Unicode versions, or with a special string, go to the tokenizer library
itself.

Prefix dynamic programming: the last token of a piece's prefix is the only token ``t`` that ends
it and is compatible with the last token ``s`` of what stands before, that is the two tokens'
bytes together encode to ``s t``. One pass over a piece so gives the exact count at each of its
prefixes. Counts of a text's prefixes are those of its pieces, laid end to end over the counts of
what stands before; they are corrected where a cut changes the pieces, that is at the end of white
space and inside contractions. All that is asked of a text, its count, whether it is over a budget
and where it must be cut for one, is read from these, and no prefix is encoded again.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erawood.llm.common import CHUNK_BYTES, mapped, quoted, slices, table, text_bytes
from erawood.llm.words import hash_spans, spans

LIMIT = 1024
#: Distinct pieces that a worker remembers; the memory is emptied when full.
REMEMBERED = 1 << 18
_LETTER, _NUMBER, _OTHER, _WHITE, _UNSURE = 1, 2, 3, 4, 5
_SPACES = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


#: Characters from here on are left to the tokenizer library.
_LAST = 0x20000


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point below ``_LAST``; unsure where it depends on the version of Unicode.

    A character without a letter's or a number's category is of the same class whether it is
    assigned or not. Others are sure if Unicode 3.2 has them in the class that they have now.
    """
    old = unicodedata.ucd_3_2_0.category
    out = np.full(_LAST, _UNSURE, np.uint8)
    for c in range(_LAST):
        now = unicodedata.category(chr(c))
        kind = {"L": _LETTER, "N": _NUMBER}.get(now[0], _OTHER)
        if c in _SPACES:
            out[c] = _WHITE
        elif now != "Cn" and (kind == _OTHER and old(chr(c))[0] not in "LN" or kind == {"L": _LETTER, "N": _NUMBER}.get(old(chr(c))[0])):
            out[c] = kind
    return out


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pre-tokenizer's pieces, and which documents hold an unsure character."""
    n = len(data)
    unsure = np.zeros(len(offsets) - 1, bool)
    if not n:
        return np.zeros(0, np.int64), unsure
    classes = _classes()
    kind = classes[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data[lead].astype(np.int64)
        size = 2 + (b >= 0xE0) + (b >= 0xF0)
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        low = [(padded[lead + k] & 0x3F).astype(np.int64) for k in (1, 2, 3)]
        code = np.where(size == 2, (b & 0x1F) << 6 | low[0], (b & 0x0F) << 12 | low[0] << 6 | low[1])
        code = np.where(size == 4, (b & 0x07) << 18 | low[0] << 12 | low[1] << 6 | low[2], code)
        of = np.where(code < _LAST, classes[np.minimum(code, _LAST - 1)], _UNSURE).astype(np.uint8)
        for k in range(4):
            at = size > k
            kind[lead[at] + k] = of[at]
    doc_heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    doc_ends = offsets[1:][offsets[:-1] < offsets[1:]]
    run = np.empty(n, bool)
    run[0] = True
    run[1:] = kind[1:] != kind[:-1]
    run[doc_heads] = True
    start = run.copy()
    heads = np.flatnonzero(run)
    tails = np.append(heads[1:], n)
    white = kind[heads] == _WHITE
    ends_doc = np.zeros(n + 1, bool)
    ends_doc[doc_ends] = True
    a, b = heads[white], tails[white]
    inner = ~ends_doc[b]
    b = b[inner]
    last = b - 1
    for _ in range(2):  # white space has three bytes at most
        last -= (data[last] & 0xC0) == 0x80
    start[last] = True
    start[b[data[last] == 0x20]] = False
    quote = np.flatnonzero((data == 0x27) & start)
    if len(quote):
        room = offsets[np.searchsorted(offsets, quote, "right")] - quote
        after = np.concatenate([data, np.zeros(4, np.uint8)])
        one, two = after[quote + 1], after[quote + 2]
        single = (room > 1) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = (room > 2) & (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C))
        for q, size in ((quote[single], 2), (quote[double], 3)):
            start[q + 1] = False
            nxt = q + size
            at = (nxt < offsets[np.searchsorted(offsets, q, "right")])
            nxt = nxt[at]
            start[nxt[kind[nxt] == _LETTER]] = True
    bad = np.flatnonzero(kind == _UNSURE)
    if len(bad):
        unsure[np.unique(np.searchsorted(offsets, bad, "right") - 1)] = True
    return np.flatnonzero(start), unsure


@functools.cache
def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE tokenizer file, with piece encoding and prefix counts."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        as_bytes = _byte_of()
        special = set(self.special)
        self.ids = {bytes(as_bytes[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.bytes_of = {v: k for k, v in self.ids.items()}
        core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=self.ids, special_tokens={})
        self._encode = core._core_bpe.encode_single_piece
        self._fits: dict[int, bool] = {}

    @functools.cached_property
    def _tree(self) -> dict:
        """The vocabulary as a tree of bytes; -1 leads to the id of the token that ends there."""
        tree: dict = {}
        for token, number in self.ids.items():
            node = tree
            for c in token:
                node = node.setdefault(c, {})
            node[-1] = number
        return tree

    def encode_piece(self, piece: bytes) -> list[int]:
        return self._encode(piece)

    def piece_counts(self, piece: bytes) -> list[int]:
        """Token counts of the piece's prefixes of 0, 1, ... bytes.

        Starts go up, so the first token that fits at an end is the longest, which is the last of
        that prefix. Whether token b can follow token a is remembered by both numbers.
        """
        n, tree, known, name, encode = len(piece), self._tree, self._fits, self.bytes_of, self._encode
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for at in range(n):
            before, node = last[at], tree
            for k in range(at, n):
                node = node.get(piece[k])
                if node is None:
                    break
                if last[k + 1] >= 0 or (t := node.get(-1)) is None:
                    continue
                if at:
                    key = before << 32 | t
                    if (fits := known.get(key)) is None:
                        fits = known[key] = encode(name[before] + name[t]) == [before, t]
                    if not fits:
                        continue
                last[k + 1], count[k + 1] = t, count[at] + 1
        if len(known) > REMEMBERED:
            known.clear()
        return count

    def has_special(self, text: bytes) -> bool:
        return any(s.encode() in text for s in self.special)

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def prefix_counts(self, text: str) -> np.ndarray:
        """The exact token count of each prefix of 0, 1, ... characters of ``text``."""
        out = np.zeros(len(text) + 1, np.int32)
        at, base = 0, 0
        while at < len(text):
            found = min(((i, s) for s in self.special if (i := text.find(s, at)) >= 0), default=None)
            end = found[0] if found else len(text)
            stop = end + len(found[1]) if found else end
            # a part of a special string is text like any other
            self._segment(text[at : max(end, stop - 1)], base, out[at : max(end, stop - 1) + 1])
            base = int(out[end])
            if found:
                base += 1
                out[stop] = base
            at = stop
        return out

    def _segment(self, text: str, base: int, out: np.ndarray) -> int:
        out[0] = base
        if not text:
            return base
        cut = [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(text)]
        white = _white_runs(text)
        before: dict[int, int] = {}
        for a, b in cut:
            before[a] = base
            piece = text[a:b]
            counts = self.piece_counts(piece.encode())
            ends = np.cumsum([len(c.encode()) for c in piece])
            out[a + 1 : b + 1] = base + np.array(counts, np.int32)[ends]
            if piece in ("'ll", "'re", "'ve"):  # a part of them is two pieces
                out[a + 2] = base + 2
            base += counts[-1]
        for a, b in white:  # a text that ends in white space has all of it in one piece
            run = text[a:b]
            counts = self.piece_counts(run.encode())
            ends = np.cumsum([len(c.encode()) for c in run])
            start = before.get(a)
            if start is None:
                start = int(out[a])
            total = base if b == len(text) else None
            out[a + 1 : b + 1] = start + np.array(counts, np.int32)[ends]
            if total is not None:
                out[b] = total
        return base


def _white_runs(text: str) -> list[tuple[int, int]]:
    runs, at = [], None
    for i, c in enumerate(text):
        if ord(c) in _SPACES:
            at = i if at is None else at
        elif at is not None:
            runs.append((at, i))
            at = None
    if at is not None:
        runs.append((at, len(text)))
    return runs


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens, from its prefix counts."""
    return int(np.flatnonzero(counts <= budget)[-1])


@functools.cache
def load(path: str) -> Bpe:
    return Bpe(path)


class PieceMemory:
    """What is known of pieces by hash; ``make`` computes it from a piece's bytes."""

    def __init__(self, make):
        self.make, self.known = make, {}

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list, np.ndarray]:
        """What is known of each distinct piece, and which of them each piece is."""
        which, distinct = pd.factorize(hash_spans(data, starts, ends))
        at = np.empty(len(distinct), np.int64)
        at[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        if len(self.known) > REMEMBERED:
            self.known = {}
        keys = distinct.tolist()
        out = list(map(self.known.get, keys))
        for i in [i for i, x in enumerate(out) if x is None]:
            out[i] = self.known[keys[i]] = self.make(data[starts[at[i]] : ends[at[i]]].tobytes())
        return out, which


def encoded(part: pa.RecordBatch, bpe: Bpe, memory: PieceMemory):
    """Of a slice: its bytes, what memory says of its distinct pieces, which of them each piece is, the
    pieces' starts, the first piece of each document, documents for the library, and the documents' offsets."""
    data, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
    starts, unsure = pieces(data, offsets)
    ends = np.append(starts[1:], len(data))
    raw = data.tobytes() if any(s.encode()[:2] in data.tobytes() for s in bpe.special) else b""
    if raw:
        for d in range(len(offsets) - 1):
            if bpe.has_special(raw[offsets[d] : offsets[d + 1]]):
                unsure[d] = True
    first = np.searchsorted(starts, offsets)
    return data, *memory.of(data, starts, ends), starts, first, unsure, offsets


def laid_out(known: list[bytes], kind: str, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed values of pieces one after the other, and the place of each piece's first."""
    lengths = np.array(list(map(len, known)), np.int64) // np.dtype(kind).itemsize
    places = np.cumsum(lengths) - lengths
    n = lengths[which]
    upto = np.concatenate([[0], np.cumsum(n)])
    take = np.arange(upto[-1])
    take += np.repeat(places[which] - upto[:-1], n)
    return np.frombuffer(b"".join(known), kind)[take], upto


_CONTRACTED = [b"'ll", b"'re", b"'ve"]


class PrefixCounts:
    """Token counts at every prefix of the texts of slices; keeps what it learns of pieces."""

    def __init__(self, path: str):
        self.bpe = load(path)
        self.memory = PieceMemory(lambda piece: np.array(self.bpe.piece_counts(piece)[1:], "<i4").tobytes())

    def of(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Bytes and offsets of a slice, the count of the prefix that each byte ends, and texts to be asked one by one.

        Counts at bytes that end no character mean nothing.
        """
        data, known, which, starts, first, unsure, offsets = encoded(part, self.bpe, self.memory)
        counts, _ = laid_out(known, "<i4", which)
        counts = counts.astype(np.int64)
        ends = np.append(starts[1:], len(data))
        last = counts[ends - 1] if len(starts) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(last)])
        before = total[:-1] - np.repeat(total[first[:-1]], np.diff(first))
        counts += np.repeat(before, ends - starts)
        self._at_white_space(data, offsets, counts)
        for text in _CONTRACTED:
            at = starts[ends - starts == 3]
            for k in range(3):
                at = at[data[at + k] == text[k]]
            counts[at + 1] = counts[at] + 1  # a part of them is two pieces
        return data, offsets, counts, np.flatnonzero(unsure).tolist()

    def _at_white_space(self, data: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> None:
        """A text that ends in white space has all of it in one piece: the count at the end of each run."""
        a, b = _runs(data, offsets)
        known, which = self.memory.of(data, a, b)
        whole = np.array([np.frombuffer(x[-4:], "<i4")[0] for x in known], np.int64)
        heads = np.isin(a, offsets[:-1])
        counts[b - 1] = whole[which] + np.where(heads, 0, counts[np.maximum(a - 1, 0)])


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of white space of two bytes and more."""
    white = _classes()[:256][data] == _WHITE
    white[data >= 0x80] = False
    for c in _SPACES:
        if c >= 0x80:
            raw = chr(c).encode()
            at = np.flatnonzero(data == raw[0])
            at = at[at + len(raw) <= len(data)]
            for k in range(1, len(raw)):
                at = at[data[at + k] == raw[k]]
            for k in range(len(raw)):
                white[at + k] = True
    a, b, _ = spans(np.where(white, 1, 0).astype(np.uint8), offsets, _MARKED)
    more = b - a > 1
    return a[more], b[more]


_MARKED = np.zeros(256, bool)
_MARKED[1] = True


def _char_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes end a character."""
    out = np.ones(len(data), bool)
    out[:-1] = (data[1:] & 0xC0) != 0x80
    return out


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Rows ``(doc_id, n_bytes, n_tokens, over_limit, cut_bytes)`` for each row of ``docs``.

    All is read from the counts of the text's prefixes: ``n_tokens`` is the last one, and
    ``cut_bytes`` is the length of the longest prefix of whole characters that has ``limit`` tokens at
    most. Null texts are empty and have no token; texts are counted whole, of any length; rows
    that repeat, or have a null doc_id, get a row each; other columns are not read; an empty table
    gives an empty result.
    """

    def run(batches):
        prefixes = PrefixCounts(path)
        for part in slices(batches, "text", CHUNK_BYTES):
            data, offsets, counts, one_by_one = prefixes.of(part)
            size = np.diff(offsets)
            full = np.flatnonzero(size)
            n, cut = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            if len(full):
                n[full] = counts[offsets[1:][full] - 1]
                within = np.where(_char_ends(data, offsets) & (counts <= limit), np.arange(1, len(data) + 1), 0)
                cut[full] = np.maximum(np.maximum.reduceat(within, offsets[:-1][full]) - offsets[:-1][full], 0)
            for d in one_by_one:
                text = part.column("text")[d].as_py()
                asked = prefixes.bpe.prefix_counts(text)
                n[d] = asked[-1]
                cut[d] = len(text[: longest_within(asked, limit)].encode())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit), pa.array(cut)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long"
    )


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``prefix_tokens``: the token count of each prefix of 0, 1, ... characters.

    ``element_at(prefix_tokens, k + 1)`` is what a cut after k characters costs; the last element
    is the whole text's count. Null texts have the array [0]. Repeated rows, null ids, long texts
    and empty tables: as in ``token_counts``. A column of that name is replaced, others go through.
    """
    from pyspark.sql.types import StructType

    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() != "prefix_tokens"])
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("prefix_tokens array<int>").fields])

    def run(batches):
        prefixes = PrefixCounts(path)
        for part in slices(batches, "text", CHUNK_BYTES // 4):
            data, offsets, counts, one_by_one = prefixes.of(part)
            held = np.flatnonzero(_char_ends(data, offsets)) if len(data) else np.zeros(0, np.int64)
            cut = np.searchsorted(held, offsets)
            zero = np.zeros(1, np.int32)
            rows = [np.concatenate([zero, counts[held[a:b]].astype(np.int32)]) for a, b in zip(cut[:-1], cut[1:])]
            for d in one_by_one:
                rows[d] = prefixes.bpe.prefix_counts(part.column(part.schema.get_field_index("text"))[d].as_py())
            made = pa.array(rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, "prefix_tokens"])

    return mapped(docs, run, schema)


def truncated(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """``docs`` with ``cut_chars``: characters of the longest prefix of at most ``budget`` tokens.

    Null texts are cut at 0; all else is as in ``prefix_table``.
    """
    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in ("cut_chars", "prefix_tokens")])
    at = F.expr(f"array_max(transform(prefix_tokens, (x, i) -> if(x <= {int(budget)}, i, 0)))")
    return prefix_table(docs, path).withColumn("cut_chars", at.cast("long")).drop("prefix_tokens")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())
