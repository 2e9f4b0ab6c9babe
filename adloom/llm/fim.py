"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and the parts change places.

Cuts fall on units: a word with the white space before it, or the white space at the end.
A text's UTF-8 bytes lie in blocks of fixed size. A Fenwick tree over the blocks holds how
many units end in each and how many code points start in each. To find the end of unit k,
binary lifting goes down the tree to the last block that still has fewer than k unit ends
up to and including it, adding up the code points passed; the boundary itself is then
sought inside one block. A tree takes one number in ``BLOCK`` bytes, whatever the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Parts in 100 of the texts that change, and of those the ones that put the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42
#: Bytes of a block.
BLOCK = 512
_SLICE = 128  # rows that are changed before they are passed on

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Fenwick:
    """Sums over blocks of two counts, with descent by the first of them."""

    def __init__(self, units: np.ndarray, points: np.ndarray):
        n = len(units)
        # The node at i sums the blocks from i minus its lowest set bit up to i.
        at = np.arange(1, n + 1)
        low = at - (at & -at)
        sums = [np.concatenate([[0], np.cumsum(c)]) for c in (units, points)]
        self.units, self.points = ([0, *(s[at] - s[low]).tolist()] for s in sums)
        self.n, self.total = n, int(sums[0][-1])
        self.highest = 1 << max(n.bit_length() - 1, 0)

    def descend(self, k: int) -> tuple[int, int, int]:
        """The block in which unit ``k`` (from 1) ends, and the units and code points before it."""
        at, units, points, step = 0, 0, 0, self.highest
        while step:
            on = at + step
            if on <= self.n and units + self.units[on] < k:
                at, units, points = on, units + self.units[on], points + self.points[on]
            step >>= 1
        return at, units, points


class Blocks:
    """A text's bytes in blocks, and the tree over their units and code points."""

    def __init__(self, raw: bytes, block: int = BLOCK):
        self.block = block
        data = np.frombuffer(raw, np.uint8)
        space = _SPACE[data]
        #: Whether a unit ends with this byte: the last one of a word, and the text's last one.
        self.ends = ~space
        self.ends[:-1] &= space[1:]
        if len(raw):
            self.ends[-1] = True
        self.starts = (data & 0xC0) != 0x80
        edges = np.arange(0, len(raw), block)
        if len(raw):
            units = np.add.reduceat(self.ends, edges, dtype=np.int64)
            points = np.add.reduceat(self.starts, edges, dtype=np.int64)
        else:
            units = points = np.zeros(0, np.int64)
        self.tree = Fenwick(units, points)

    @property
    def units(self) -> int:
        return self.tree.total

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` units."""
        if not k:
            return 0, 0
        block, units, points = self.tree.descend(k)
        begin = block * self.block
        inside = slice(begin, begin + self.block)
        last = int(np.flatnonzero(self.ends[inside])[k - units - 1]) + 1
        return begin + last, points + int(np.count_nonzero(self.starts[begin : begin + last]))


def change(raw: bytes, draw_1: int, draw_2: int, form: str, block: int = BLOCK) -> tuple[bytes, int, int, int]:
    """The changed text, its number of units, and the code points of prefix and middle."""
    blocks = Blocks(raw, block)
    n = blocks.units
    if form == "plain":
        return raw, n, 0, 0
    first, second = sorted((draw_1 % (n + 1), draw_2 % (n + 1)))
    (a, a_points), (b, b_points) = blocks.cut(first), blocks.cut(second)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if form == "psm":
        parts = [marks[0], prefix, marks[1], suffix, marks[2], middle]
    else:
        parts = [marks[1], suffix, marks[0], prefix, marks[2], middle]
    return b"".join(parts), n, a_points, b_points - a_points


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 that depend on the seed and the id alone; a null id is an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(documents: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output`` of every row.

    ``n`` counts units; ``form`` is ``plain`` for empty texts, for texts that hold a mark,
    and for those not drawn, ``psm`` or ``spm`` otherwise. The draws follow from the seed
    and doc_id (a null one counts as an empty string), so equal rows change alike. A null
    text counts as empty. Very long texts cost one pass and a tree entry in ``BLOCK`` bytes.
    No rows give no rows; extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    one, two, three, four = draws(F.col("doc_id"), seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = (
        F.when((text == "") | marked | (three % 100 >= rate), "plain")
        .when(four % 100 < suffix_first, "spm")
        .otherwise("psm")
    )
    rows = documents.select("doc_id", text.alias("text"), one.alias("one"), two.alias("two"), form.alias("form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):  # results are as large as the texts
                part = batch.slice(at, _SLICE)
                forms = part.column(4).to_pylist()
                texts = part.column(1).cast(pa.binary()).to_pylist()
                made = [change(*x) for x in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist(), forms)]
                whole = [f == "plain" for f in forms]
                columns = [
                    part.column(0),
                    pa.array([m[1] for m in made], pa.int64()),
                    part.column(4),
                    pa.array([None if w else m[2] for w, m in zip(whole, made)], pa.int64()),
                    pa.array([None if w else m[3] for w, m in zip(whole, made)], pa.int64()),
                    pa.array([m[0] for m in made], pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` changed into ``output``.

    No text that changed holds a mark, and none can arise where a part meets one, so the
    first mark of each kind is the one that was put in.
    """

    def at(mark: str) -> Column:
        return F.instr(output, mark)

    def between(begin: Column, end: Column) -> Column:  # what lies behind the mark at begin
        return F.substring(output, begin + 3, end - begin - 3)

    behind = F.substring(output, at(MIDDLE) + 3, F.length(output))
    psm = F.concat(between(at(PREFIX), at(SUFFIX)), behind, between(at(SUFFIX), at(MIDDLE)))
    spm = F.concat(between(at(PREFIX), at(MIDDLE)), behind, between(at(SUFFIX), at(PREFIX)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(documents: DataFrame) -> DataFrame:
    """``transform`` with the SHA-256 of the output and of the text rebuilt from it."""
    rows = transform(documents)
    back = restored(F.col("output"), F.col("form"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )
