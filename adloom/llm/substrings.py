"""Substring dedup: word windows that also start in an earlier document are removed.

Every window of a fixed number of words gets a Rabin-Karp hash: words are hashed by their
bytes modulo a prime with two bases, windows by their words modulo 2^64. Prefix sums give
all of them at once: a hash is a difference of two sums, times a power of the inverse base.

Spark counts in how many rows each window occurs, by 48 bits of its hash; most windows
occur once and are done with. Those that do not go on with the whole hash and 32 bits of a
second one, which together name a window; Spark finds the least id of each name, and every
later occurrence marks its place. Places that touch merge into maximal removal intervals.

Whole copies of a text would send all their windows to the same keys. Texts that are more
frequent than one in ``HEAVY`` rows (so at most ``HEAVY`` texts) are found first, by a hash
of the text; of those only the rows with the least id are cut into windows, and the others
lose every word if there is a window in them.

Between the two counts a Bloom filter of the repeated hashes spares the windows that occur
once the second shuffle. It only ever lets too many through, which the second count sorts
out, and above ``FILTER_BYTES`` it is left out; results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import finished
from adloom.workspace import materialize, release

WINDOW = 13
#: Most texts whose whole copies are set aside before windows are counted.
HEAVY = 200_000
#: Largest Bloom filter, and its bits for each hash: as many as fit, between these.
FILTER_BYTES = 32 << 20
MOST_BITS, LEAST_BITS = 12, 4
#: Largest table that is broadcast to a join, measured.
BROADCAST_BYTES = 24 << 20
#: A window is hot above one part in this many of all repeated ones.
HOT = 1024
#: Texts are taken in slices of about this many bytes, words in pieces of about this many.
SLICE, PIECE = 4 << 20, 1 << 18

_PRIME = (1 << 31) - 1
_BASES = (1_405_695_061, 834_667_249)  # below the prime
_ODD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_SHORT = 16  # bits that the first count leaves out
LAST = (1 << 63) - 1  # a null id comes after all others

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray, factor: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo the prime."""
    out, have = np.ones(n, np.uint64), 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, _PRIME)) % np.uint64(_PRIME)
        have += more
    return out


_piece_powers = lru_cache(4)(_powers)


def _residues(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hashes of the words of a piece."""
    n = len(data)
    powers = _powers if n > 2 * PIECE else lambda b, _: _piece_powers(b, 2 * PIECE)[:n]
    terms = data.astype(np.uint64) * powers(base, n)  # below 2^39
    if n > 1 << 24:
        terms %= np.uint64(_PRIME)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    inverse = powers(pow(base, -1, _PRIME), n)
    return (sums[ends] - sums[starts]) % np.uint64(_PRIME) * inverse[starts] % np.uint64(_PRIME)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number per word, made of two residues and the length."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(starts, starts[first] + PIECE)), first + 1)
        own = slice(first, last)
        begin, end = starts[first], ends[last - 1]
        piece, s, e = data[begin:end], starts[own] - begin, ends[own] - begin
        a, b = (_residues(piece, s, e, base) for base in _BASES)
        out[own] = _mix((a | b << np.uint64(32)) ^ (e - s).astype(np.uint64) * np.uint64(_ODD[0]))
        first = last
    return out


def _rolled(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes modulo 2^64 of all runs of ``width`` numbers."""
    n = len(words)

    def powers(b: int) -> np.ndarray:
        p = np.full(n, b, np.uint64)
        p[0] = 1
        return np.cumprod(p)

    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(base), out=sums[1:])
    return _mix((sums[width:] - sums[: n - width + 1]) * powers(pow(base, -1, 1 << 64))[: n - width + 1])


def windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the texts between ``offsets``: hash, second hash, text, first word."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(data):
        return none
    space = _SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[0] = after[-1] = before[inner] = after[inner - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    if len(starts) < width:
        return none
    text = np.searchsorted(offsets, starts, "right") - 1
    whole = np.flatnonzero(text[: len(text) - width + 1] == text[width - 1 :])
    words = word_hashes(data, starts, ends)
    first_word = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(offsets) - 1))])
    h = _rolled(words, width, _ODD[0])[whole]
    check = (_rolled(_mix(words, _ODD[1]), width, _ODD[1])[whole] >> np.uint64(32)).astype(np.uint32)
    return h, check, text[whole], whole - first_word[text[whole]]


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with the bytes of one text column and where its texts begin."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary()).cast(pa.large_binary())
        _, edges, data = texts.buffers()
        edges = np.frombuffer(edges, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = min(max(int(np.searchsorted(edges, edges[at] + SLICE)), at + 1), len(texts))
            yield batch.slice(at, to - at), data[edges[at] : edges[to]], edges[at : to + 1] - edges[at]
            at = to


def _short(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(_SHORT)).astype(np.int64)


def _counted(texts: DataFrame, width: int) -> DataFrame:
    """``h``: short hashes of windows that occur in more than one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in _slices(batches, 0):
            h, _, text, _ = windows(data, offsets, width)
            if len(h):
                h = _short(h)
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                new = np.r_[True, h[1:] != h[:-1]]
                row = new | np.r_[True, text[1:] != text[:-1]]  # a row counts once
                firsts = np.flatnonzero(new)
                rows = np.add.reduceat(row, firsts, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[firsts]), pa.array(rows)], ["h", "n"])

    # Slices have added up their own rows, so a hot window is a row for each slice.
    seen = texts.select("text").mapInArrow(run, "h long, n long").repartition("h")
    return seen.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


class Filter:
    """A Bloom filter in blocks. A block is made in one task from its own hashes alone."""

    def __init__(self, hashes: int, most: int = FILTER_BYTES):
        self.bits = min(MOST_BITS, 8 * most // max(hashes, 1))
        self.blocks = max(1, min(256, hashes // 2000))
        self.size = max(64, -(-hashes * self.bits // (self.blocks * 64)) * 64)  # bits of a block
        self.probes = max(1, round(self.bits * 0.69))

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        mixed = _mix(h.astype(np.uint64) * np.uint64(_ODD[1]))
        step = (mixed >> np.uint64(32)) | np.uint64(1)
        for i in range(self.probes):
            yield ((mixed + np.uint64(i) * step) % np.uint64(self.size)).astype(np.int64)

    def block(self, h: np.ndarray) -> bytes:
        on = np.zeros(self.size, bool)
        for place in self.places(h):
            on[place] = True
        return np.packbits(on, bitorder="little").tobytes()

    def holds(self, table: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may be in the filter."""
        left = np.arange(len(h))
        block = h % self.blocks * self.size
        for place in self.places(h):
            bit = block[left] + place[left]
            left = left[(table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0]
        return left


def _filter(repeated: DataFrame, n: int) -> tuple[Filter, bytes] | None:
    """The filter of all repeated hashes; the driver holds its bytes, which are bounded."""
    made = Filter(n)
    if made.bits < LEAST_BITS:
        return None
    blocks = made.blocks

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "bits": [made.block(frame["h"].to_numpy(np.int64))]})

    built = repeated.groupBy((F.col("h") % blocks).alias("block")).applyInPandas(build, "block long, bits binary")
    found = {r["block"]: bytes(r["bits"]) for r in built.collect()}
    return made, b"".join(found.get(i, bytes(made.size // 8)) for i in range(blocks))


def _candidates(texts: DataFrame, kept: tuple[Filter, bytes] | None, width: int) -> DataFrame:
    """``h``, ``check``, ``d``, ``a``, ``pos`` of the windows that may be repeated."""
    shared = texts.sparkSession.sparkContext.broadcast(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value
        table = np.frombuffer(kept[1], np.uint8) if kept else None
        for rows, data, offsets in _slices(batches, 2):
            h, check, text, pos = windows(data, offsets, width)
            if kept:
                left = kept[0].holds(table, _short(h))
                h, check, text, pos = h[left], check[left], text[left], pos[left]
            d, a = (rows.column(i).to_numpy()[text] for i in (0, 1))
            columns = [h.view(np.int64), check.view(np.int32), d, a, pos.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "check", "d", "a", "pos"])

    return texts.select("d", "a", "text").mapInArrow(run, "h long, check int, d long, a long, pos int")


def _later(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``d``, ``a``, ``pos`` of the windows that start in a row with a smaller id, too; and the table of firsts."""
    firsts = candidates.groupBy("h", "check").agg(
        F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("n")
    )
    firsts = firsts.where("first < last").select("h", F.col("check").alias("same"), "first", "n")
    firsts = materialize(firsts, "firsts")
    finished(firsts)
    sizes = firsts.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("places")).first()
    right = firsts.drop("n")
    if sizes["rows"] * 48 <= BROADCAST_BYTES:
        joined = candidates.join(F.broadcast(right), "h")
    else:  # hot windows, fewer than HOT, are answered where they lie
        hot = F.broadcast(firsts.where(F.col("n") * HOT > sizes["places"]).select("h").distinct())
        joined = candidates.join(hot, "h", "left_anti").join(right, "h").unionByName(
            candidates.join(F.broadcast(right.join(hot, "h", "left_semi")), "h")
        )
    return joined.where("check = same AND d > first").select("d", "a", "pos"), firsts


def intervals(documents: DataFrame, width: int = WINDOW) -> DataFrame:
    """``d``, ``a``, ``spans``: the maximal removal intervals (first and last word) of rows that have any.

    ``documents`` has ``d``, ``a`` (a hash of the text) and ``text``, none of them null.
    """
    repeated = materialize(_counted(documents, width), "repeated")
    finished(repeated)
    kept = _filter(repeated, repeated.count())
    release(repeated)
    candidates = materialize(_candidates(documents, kept, width), "candidates")
    later, firsts = _later(candidates)
    places = later.groupBy("d", "a").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    n = F.size("p")
    begins = F.filter("p", lambda x, i: (i == 0) | (x - F.get("p", i - 1) > width))
    lasts = F.filter("p", lambda x, i: (i == n - 1) | (F.get("p", i + 1) - x > width))
    lasts = F.transform(lasts, lambda x: x + (width - 1))
    spans = F.arrays_zip(begins.alias("first"), lasts.alias("last"))
    spans = materialize(places.select("d", "a", spans.alias("spans")), "spans")
    release(candidates)
    release(firsts)
    return spans



def dedup_windows(documents: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``spans``, ``text`` of every row.

    Words are runs without ASCII white space. A word goes if a window of ``width`` words
    covers it whose words also start in a row with a smaller doc_id; windows are judged on
    the input. ``spans`` are the removed intervals of words, first and last, ``text`` what
    is kept, joined by single spaces. Rows with one doc_id never remove from each other; a
    null id comes after all others. Null texts count as empty, texts with fewer words than
    a window are kept. Repeated rows stay rows; very long texts are taken in pieces; no
    rows give no rows; extra columns are ignored.
    """
    rows = documents.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit(width), F.col("text"))})
    least = max(2, -(-documents.count() // HEAVY))
    heavy = rows.groupBy("a", "b").agg(F.min("d").alias("origin"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    heavy = materialize(heavy.drop("n"), "heavy")  # at most HEAVY rows, since each stands for 1 / HEAVY of all
    marked = rows.join(F.broadcast(heavy), ["a", "b"], "left").withColumn("copy", F.coalesce(F.col("d") > F.col("origin"), F.lit(False)))
    spans = intervals(marked.where(~F.col("copy")).select("d", "a", "text"), width)
    size = spans.agg(F.sum(F.size("spans") * 16 + 64)).first()[0] or 0
    right = spans if size > BROADCAST_BYTES else F.broadcast(spans)  # measured
    found = marked.join(right, ["d", "a"], "left")
    columns = ["doc_id", "text", "copy", F.col("spans.first").alias("first"), F.col("spans.last").alias("last")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in _slices([batch], 1):
                ids, texts, *rest = (rows.column(i) for i in range(5))
                made = [_cut(*x) for x in zip(texts.cast(pa.binary()).to_pylist(), *(c.to_pylist() for c in rest))]
                kinds = (pa.int64(), pa.int64(), span_type, pa.binary())
                columns = [pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)]
                columns[3] = columns[3].cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_words", "n_removed", "spans", "text"])

    def _cut(text: bytes, copy: bool, first: list | None, last: list | None) -> tuple:
        words = text.split()
        if copy and len(words) >= width:
            first, last = [0], [len(words) - 1]
        kept, at, gone = [], 0, 0
        for i, j in zip(first or (), last or ()):
            kept += words[at:i]
            at, gone = j + 1, gone + j + 1 - i
        own = [{"first": i, "last": j} for i, j in zip(first or (), last or ())]
        return len(words), gone, own, b" ".join(kept + words[at:])

    span_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_removed long, spans array<struct<first: int, last: int>>, text string"
    return found.select(*columns).mapInArrow(run, schema)


def digest(documents: DataFrame, width: int = WINDOW) -> DataFrame:
    """``dedup_windows`` with the SHA-256 of the kept words in place of text and spans."""
    kept = F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    return dedup_windows(documents, width).select("doc_id", "n_words", "n_removed", kept)
