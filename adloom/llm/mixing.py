"""Mixing sources to target weights by systematic sampling.

Within a source every document is expected ``target / source size`` times. Documents stand
in order of size; the running sum of expected copies starts at one random offset and a
document is emitted once for each whole number the sum passes. Standing in order of size,
what one stretch of the line takes too much the next takes too little, so the words taken
stay within about one largest document of the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm.common import ordered_rows, unused
from adloom.workspace import materialize

WEIGHTS = (3, 1, 2)
#: The mix holds this share of all words.
SHARE = 1.5
#: No source gives more than this many times its own words.
MOST = 2


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source: ``source_size``, ``target``.

    Weights repeat over the sources in order of code points, null last. A target is
    ``level * weight``, or ``most`` times the source's size if that is less; the level is
    raised until the targets make up their share, or all sources are at their limit. The
    driver sees three sums in each step; each step fixes at least one more source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row per source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = materialize(sources.withColumn("weight", weight), "sources")
    wanted = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    limit = F.col("source_size") * float(most)
    level, capped = 0.0, -1
    while True:
        at_limit = limit <= F.lit(level) * F.col("weight")
        now = sources.agg(
            F.coalesce(F.sum(F.when(at_limit, 1)), F.lit(0)).alias("n"),
            F.coalesce(F.sum(F.when(at_limit, limit)), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~at_limit, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if now["n"] == capped or not now["open"]:
            break
        capped, level = now["n"], (wanted - now["full"]) / now["open"]
    target = F.when(at_limit, limit).otherwise(F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) per source, from the md5 of its name and the seed."""
    name = F.concat(F.coalesce(source, F.lit("")), F.lit(f"/{seed}"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix_copies(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 7,
) -> DataFrame:
    """One row per row of ``documents``: its key, ``size``, ``source_size``, ``target``, ``copies``.

    The key is ``doc_id``, ``source`` and ``h``, a hash of the text. Size is the number of
    words; a null text has none. Documents without words are expected as often as others
    of their source, and cost nothing; a source without any words has target 0 and gives no
    copies. Rows equal in every key column are interchangeable. Reruns agree.
    """
    sized = materialize(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.xxhash64("text").alias("h"),
            words(F.col("text")).cast("long").alias("size"),
        ),
        "words",
    )
    targets = source_targets(sized, weights, share, most)
    line = ordered_rows(sized, [F.col("source"), F.col("size"), F.col("doc_id"), F.col("h")], "line")
    # A part holds a stretch of the line, so it adds a row for each source that it touches.
    touched = line.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = touched.select(
        F.col("source").alias("s"),
        F.col("part").alias("p"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
    )
    shifts = shifts.join(targets, shifts["s"].eqNullSafe(targets["source"])).drop("source")
    ranked = line.join(shifts, line["source"].eqNullSafe(shifts["s"]) & (F.col("part") == F.col("p")))
    rank = (F.col("row") + F.col("shift")).cast("double")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = offset(F.col("source"), seed)
    copies = F.floor((rank + 1) * expected + start) - F.floor(rank * expected + start)
    return ranked.select(
        "doc_id", "source", "h", "size", "source_size", "target", copies.cast("long").alias("copies")
    )


def mix(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``documents``, each as often as it was drawn.

    All columns are kept, whatever their names. Rows equal in doc_id, source and text are
    interchangeable, so only how many copies such a group gets is decided, and the extra
    ones go to the first of them.
    """
    key, nth, copies, *other = (unused(documents, f"_{c}") for c in ("hash", "nth", "copies", "id", "source", "key", "at"))
    d, s, k, at = other
    id_, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    drawn = mix_copies(documents, **options).select(
        F.col("doc_id").alias(d), F.col("source").alias(s), F.col("h").alias(k), F.col("copies").alias(copies)
    )
    drawn = drawn.withColumn(at, F.row_number().over(Window.partitionBy(d, s, k).orderBy(F.desc(copies))))
    twins = Window.partitionBy(id_, source, key).orderBy(F.lit(0))
    numbered = documents.withColumn(key, F.xxhash64("text")).withColumn(nth, F.row_number().over(twins))
    taken = numbered.join(
        drawn.where(F.col(copies) > 0),
        id_.eqNullSafe(F.col(d)) & source.eqNullSafe(F.col(s)) & (F.col(key) == F.col(k)) & (F.col(nth) == F.col(at)),
    )
    repeated = taken.withColumn(at, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return repeated.select(*[repeated[f"`{c}`"] for c in documents.columns])
