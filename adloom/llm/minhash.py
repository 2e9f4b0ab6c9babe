"""MinHash fingerprints, and near-duplicate pairs by signature bands.

A text's shingles are runs of five words. Each shingle is one 64-bit number; each of 128
universal hash functions (odd multiplier and offset: ``a * x + b`` modulo 2^64)
gives the signature its minimum. The share of equal places in two signatures estimates the
Jaccard likeness of the two sets of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm import simhash
from adloom.llm.common import partitions, rows_of
from adloom.llm.components import components
from adloom.llm.shards import OVERFULL, find_ranges, split
from adloom.workspace import materialize, release

SHINGLE = 5
PERMUTATIONS = 128
#: Bands of four rows: two texts of likeness 0.8 miss all of them once in 10^7 times.
BAND_ROWS = 4
SIMILARITY = 0.8
#: Texts, and their shingles, of one block that is compared pair by pair.
BLOCK = 128
BLOCK_RUNS = 1 << 18
#: Results of equal rows that one row of a task makes.
COPIES = 4096
_BLOCK = 256  # shingles that are permuted at once, so that they stay in the cache

_STEP = np.uint64(0x9E3779B97F4A7C15)


class MinHash:
    def __init__(self, shingle: int = SHINGLE, permutations: int = PERMUTATIONS, seed: int = 1):
        random = np.random.default_rng(seed)
        self.shingle = shingle
        self.a = random.integers(0, 1 << 63, permutations, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = random.integers(0, 1 << 63, permutations, np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        """Numbers of the distinct word runs; a shorter text is one run, an empty one has none."""
        words = text.encode().split()
        if not words:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        k = min(self.shingle, len(words))
        n = len(words) - k + 1
        run = hashes[:n].copy()
        with np.errstate(over="ignore"):
            for i in range(1, k):  # the order of the words counts
                run = (run ^ (run >> np.uint64(29))) * _STEP + hashes[i : i + n]
            run ^= run >> np.uint64(32)
        return np.unique(run)

    def signature(self, text: str) -> np.ndarray:
        """One 16-bit minimum per permutation; an empty text has all ones."""
        return self.signed(self.shingles(text))

    def signed(self, runs: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(runs), _BLOCK):
            block = runs[at : at + _BLOCK]
            table = np.multiply.outer(block, self.a)  # unsigned numbers wrap at 2^64
            table += self.b
            np.minimum(least, table.min(axis=0), out=least)
        # Bits 16 to 31: the highest ones are zero in most minima.
        return (least >> np.uint64(16)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def _hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def _neighbours(documents: DataFrame, n_ranges: int) -> tuple[DataFrame, DataFrame | None]:
    """Documents in ``range``s of descending doc_id, each range ended by its successor's first.

    Within an id the hash of the text decides, so rows that share an id spread as well. A row
    that is ``head`` is there only to be seen by the row before it. A group of equal rows
    larger than a range is one row here; its other copies, each followed by an equal row,
    come apart as (doc_id, text, copies). The driver holds one key per range.
    """
    # ~ turns the order of ids around; nulls come last.
    h = F.bitwise_not(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    keyed = documents.select("doc_id", "text", h.alias("h"), F.xxhash64("text").alias("d"), F.lit(0).cast("long").alias("c"))
    keys = materialize(keyed.select("h", "d", "c", (F.octet_length("text") + 1).cast("long").alias("size")), "keys")
    ranged, sizes, bounds = split(keys, n_ranges)
    spark, share = documents.sparkSession, sum(sizes.values()) / n_ranges
    full = [r for r, s in sizes.items() if s > OVERFULL * share]
    equal = ranged.where(F.col("range").isin(full)).groupBy("h", "d").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    # Fewer groups than ranges are larger than one.
    large = equal.where((F.col("s") > share) & (F.col("n") > 1)).select("h", "d", "n").collect() if full else []
    firsts = ranged.groupBy("range").agg(F.min(F.struct("h", "d")).alias("k")).collect()
    release(keys)
    firsts = sorted((r["range"], r["k"]["h"], r["k"]["d"]) for r in firsts)
    goals = [r for r, *_ in firsts[-1:] + firsts[:-1]]

    def picked(table: DataFrame, *more: str) -> DataFrame:  # the one text that belongs to a key
        found = keyed.join(F.broadcast(table), ["h", "d"])
        return found.groupBy("h", "d", *more).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))

    goal = spark.createDataFrame([(a, b, r) for (_, a, b), r in zip(firsts, goals)], "h long, d long, goal int")
    heads = picked(goal, "goal").select("doc_id", "text", "h", "d", F.col("goal").alias("range"), F.lit(True).alias("head"))
    copies = None
    if large:
        groups = spark.createDataFrame([tuple(r) for r in large], "h long, d long, n long")
        single = picked(groups, "n")
        copies = single.select("doc_id", "text", (F.col("n") - 1).alias("copies"))
        keyed = keyed.join(F.broadcast(groups), ["h", "d"], "left_anti").unionByName(
            single.select("doc_id", "text", "h", "d", F.lit(0).cast("long").alias("c"))
        )
    rows = find_ranges(keyed, bounds).select("doc_id", "text", "h", "d", "range", F.lit(False).alias("head"))
    return rows.unionByName(heads), copies


def edited_fingerprints(documents: DataFrame, shingle: int = SHINGLE, permutations: int = PERMUTATIONS) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text loses its last floor(n/2) code points to the first as many, or all, of
    the next document in descending order of doc_id; the first document follows the last.
    Null texts count as empty. Among equal ids the hash of the text decides the order; null
    ids come last; a single document follows itself. Empty texts have likeness 1 to each
    other. Repeated rows give repeated results; no rows give none. A very long text is hashed
    whole, in one task. Extra columns are ignored.
    """
    spark = documents.sparkSession
    n = partitions(spark)
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows, copies = _neighbours(own, n)
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )

    def result(doc_id, text: str, signature: np.ndarray, next_: str, next_signature: np.ndarray, hasher: MinHash) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + next_[:half]
        other = signature if edited == text else hasher.signature(edited)
        return (
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), _hex(signature), _hex(other),
            likeness(signature, other), likeness(signature, next_signature),
        )

    def table(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = MinHash(shingle, permutations)
        last = None  # range, doc_id, text, signature of the row before
        for batch in batches:
            out = []
            for range_, doc_id, text, head in zip(batch["range"], batch["doc_id"], batch["text"], batch["head"]):
                signature = last[3] if last and last[2] == text else hasher.signature(text)
                if last and last[0] == range_:
                    out.append(result(*last[1:], text, signature, hasher))
                last = None if head else (range_, None if pd.isna(doc_id) else int(doc_id), text, signature)
            yield table(out)

    def repeat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = MinHash(shingle, permutations)
        for batch in batches:
            for doc_id, text, times in zip(batch["doc_id"], batch["text"], batch["times"]):
                signature = hasher.signature(text)
                row = result(None if pd.isna(doc_id) else int(doc_id), text, signature, text, signature, hasher)
                yield table([row] * times)

    order = ["range", "head", "h", "d"]
    found = rows.repartitionById(n, F.col("range") % n).sortWithinPartitions(*order).mapInPandas(run, schema)
    if copies is None:
        return found
    slices = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))
    sliced = copies.withColumn("slice", slices).select(
        "doc_id", "text", F.least(F.lit(COPIES), F.col("copies") - F.col("slice") * COPIES).cast("int").alias("times")
    )
    return found.unionByName(sliced.repartition(n).mapInPandas(repeat, schema))


def _jaccard(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the exact likeness of their shingle sets."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("runs").alias("y")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("runs").alias("x")), "a"
    )
    common = F.size(F.array_intersect("x", "y")).cast("double")
    return both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("j"))


def _linked(nodes: list, roots: list, places: list, runs: list, similarity: float) -> list[tuple[int, int]]:
    """Links that connect what is alike and not connected yet.

    Texts of two places are compared across, texts of one place with each other. A link
    joins its ends' components, so a block gives fewer links than it has texts.
    """
    _, ids = np.unique(np.concatenate(runs), return_inverse=True)
    sizes = np.array([len(r) for r in runs])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at, root = np.array(places), np.array(roots)
    across, seen, out = at.min() != at.max(), np.zeros(ids.max() + 1, bool), []
    for x in range(len(nodes) - 1):
        rest = slice(x + 1, None)
        like = np.minimum(sizes[rest], sizes[x]) >= similarity * np.maximum(sizes[rest], sizes[x])
        like &= root[rest] != root[x]
        if across:
            like &= at[rest] != at[x]
        if not like.any():
            continue
        own = ids[starts[x] : starts[x] + sizes[x]]
        seen[own] = True
        common = np.add.reduceat(seen[ids], starts, dtype=np.int64)[rest]
        seen[own] = False
        for y in np.flatnonzero(like & (common / (sizes[rest] + sizes[x] - common) >= similarity)) + x + 1:
            if root[y] != root[x]:
                out.append((nodes[x], nodes[y]))
                root[root == root[y]] = root[x]
    return out


def _across(judged: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among members of a band that its smallest member does not connect.

    Jaccard distance is a metric: a text can only link to another component of the band if
    their distances from the smallest member differ by no more than a link's distance. What
    is left of a band is cut into blocks of bounded numbers of texts and shingles, and each
    pair of blocks is one group of rows, compared where it lies.
    """
    far = judged.where("root <> home").groupBy("band").agg(F.max("j").alias("far"))
    near = (F.col("root") != F.col("home")) | (F.col("j") <= F.col("far") + (1 - similarity) + 1e-9)
    left = materialize(judged.join(far, "band").where(near).select("band", "node", "root", "size"), "open")
    cuts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_RUNS)).cast("int").alias("cuts")
    open_ = left.groupBy("band").agg(cuts, F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2")
    at = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    placed = left.join(open_.select("band", "cuts"), "band").withColumn("at", at).withColumn("other", other)
    placed = placed.select("band", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("k"), "at", "node", "root")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group = None, ([], [], [], [])
        for batch in batches:
            out = []
            for band, i, k, *row in zip(*(batch[c] for c in ("band", "i", "k", "node", "root", "at", "runs"))):
                if (band, i, k) != key:
                    out += _linked(*group, similarity) if len(group[0]) > 1 else []
                    key, group = (band, i, k), ([], [], [], [])
                for column, value in zip(group, row):
                    column.append(value)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if len(group[0]) > 1:
            yield pd.DataFrame(_linked(*group, similarity), columns=["a", "b"], dtype="int64")

    rows = placed.join(sets.select("node", "runs"), "node").repartition(partitions(judged.sparkSession), "band", "i", "k")
    return rows.sortWithinPartitions("band", "i", "k").mapInPandas(compare, "a long, b long").distinct()


def named(documents: DataFrame, *more: str) -> DataFrame:
    """``id``, ``h``, ``text`` and ``more`` of every row; all texts without a word have one ``h``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = F.when(text.rlike("[^\\x20\\x09-\\x0D]"), text).otherwise(F.lit(""))
    h = F.unhex(F.substring(F.sha2(worded.cast("binary"), 256), 1, 32))
    return documents.select(F.col("doc_id").cast("long").alias("id"), h.alias("h"), text.alias("text"), *more)


def classes(
    rows: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, permutations: int = PERMUTATIONS
) -> DataFrame:
    """``h``, ``class`` (a number) of every distinct ``h`` of ``rows``, which :func:`named` gives.

    Classes are connected over links of at least ``similarity``. Candidates are texts whose
    SimHash fingerprints are connected by links within 2 bits (``op6``'s ball hashing), as one
    group each, and, for those that differ in more bits, texts that share a band of their
    signatures; links are decided on whole shingle sets. First all
    members of a band are compared with its smallest one. Members that are in its component
    are then done, but for those near enough to a member that is not; the rest of each band
    is compared pair by pair in bounded blocks. So no link that would join two classes is
    lost, and the number of Spark jobs does not depend on the texts but for the depth of
    the components. Texts without words share one ``h``.
    """
    n_bands = permutations // BAND_ROWS

    @F.pandas_udf("bands array<long>, size int, fp long")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hasher = MinHash(shingle, permutations)
        for batch in batches:
            out = []
            for text in batch:
                runs = hasher.shingles(text)
                table = hasher.signed(runs).reshape(n_bands, -1)
                bands = [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(table)]
                out.append((bands if len(runs) else [], len(runs), simhash.fingerprint(text)))
            yield pd.DataFrame(out, columns=["bands", "size", "fp"])

    @F.pandas_udf("array<long>")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = MinHash(shingle, permutations)
        for batch in batches:
            yield pd.Series([hasher.shingles(t).view(np.int64) for t in batch])

    single = rows.select("id", "h", sign("text").alias("s")).groupBy("h").agg(F.min("id").alias("id"), F.first("s").alias("s"))
    signed = materialize(single.select("h", "id", "s.*", F.monotonically_increasing_id().alias("node")), "signed")
    prints = signed.where("size > 0").select("node", "size", "fp")
    near = components(simhash.links(prints)).withColumnRenamed("node", "fp")
    group = F.xxhash64(F.coalesce("root", "fp"), F.lit("simhash")).alias("band")
    bands = signed.select("node", "size", F.explode("bands").alias("band")).unionByName(
        prints.join(near, "fp", "left").select("node", "size", group)
    )
    first = bands.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = materialize(bands.join(first, "band"), "met")
    wanted = signed.join(met.select("node").distinct(), "node").select("node", F.col("h").alias("wh"), F.col("id").alias("wid"))
    # By id too: copies of one text, however many, do not meet in one task.
    found = rows.join(wanted, (F.col("h") == F.col("wh")) & F.col("id").eqNullSafe(F.col("wid")))
    sets = materialize(found.dropDuplicates(["node"]).select("node", whole("text").alias("runs")), "runs")
    pairs = met.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    likely = materialize(_jaccard(pairs, sets), "likeness")
    links = likely.where(F.col("j") >= similarity).select("a", "b")
    roots = materialize(components(links), "roots")
    judged = met.join(likely.select(F.col("a").alias("first"), F.col("b").alias("node"), "j"), ["first", "node"], "left")
    judged = judged.join(roots, "node", "left").join(roots.select(F.col("node").alias("first"), F.col("root").alias("home")), "first", "left")
    judged = judged.select(
        "band", "node", "size", F.coalesce("j", F.lit(1.0)).alias("j"),
        F.coalesce("root", "node").alias("root"), F.coalesce("home", "first").alias("home"),
    )
    more = materialize(_across(materialize(judged, "judged"), sets, similarity), "across")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    return signed.join(roots, "node", "left").select("h", F.coalesce("root", "node").alias("class"))


def near_duplicates(
    documents: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, permutations: int = PERMUTATIONS
) -> DataFrame:
    """``doc_id``, ``class_id``: the smallest doc_id reachable over links of at least ``similarity``.

    See :func:`classes`. Null and empty texts link to each other alone; rows without a
    doc_id take no part; repeated rows and extra columns do no harm.
    """
    rows = named(documents).where("id is not null")
    found = classes(rows, shingle, similarity, permutations)
    least = rows.groupBy("h").agg(F.min("id").alias("least")).join(found, "h")
    least = materialize(least, "least")
    ids = least.groupBy("class").agg(F.min("least").alias("class_id"))
    names = least.join(ids, "class").select("h", "class_id")
    return rows.select("id", "h").join(names, "h").select(F.col("id").alias("doc_id"), "class_id")


def keep_one(
    documents: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, permutations: int = PERMUTATIONS
) -> DataFrame:
    """``documents`` with one row left of each class of near-duplicates, all columns kept.

    Letters of either case are alike. The row with the smallest doc_id stays (null last),
    among equal ids the one with the smallest hash of its text, and one of several equal rows.
    """
    rows = named(documents.select("doc_id", F.lower("text").alias("text"), F.xxhash64("text").alias("key")), "key")
    found = classes(rows, shingle, similarity, permutations)
    row = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("doc_id"), F.col("key").alias("h"))
    least = rows.groupBy("h").agg(F.min(row).alias("row")).join(found, "h")
    return rows_of(documents, least.groupBy("class").agg(F.min("row").alias("row")))
