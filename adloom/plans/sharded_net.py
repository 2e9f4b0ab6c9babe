"""Nets whose parameters stay a table: no net on the driver, no broadcast, no bound on the vocabulary.

A net is a table with one row per parameter row. Instances are dealt to parts by a seeded
hash of their number; each part is sent the rows of the wide first matrix that its
instances name, found by a join, and a copy of the narrow layers, whose size follows from
the hidden widths alone. Parameter rows come first in a part, instances stream behind
them. What the parts changed is averaged, or what their gradients add up to is stepped
with, by Spark per parameter row; the driver sees the loss.

Tasks exchange nothing while they run, so there is no barrier: a gather between running
tasks would pass through the driver, and a lost executor would repeat all parts, not its own.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions import layers, net_parts
from adloom.operators.metrics import evaluate
from adloom.plans import net as nets
from adloom.plans.training import Fit, OnIteration, history_frame
from adloom.workspace import materialize, release, scratch

for module in (layers, net_parts):  # workers need no copy of the package
    cloudpickle.register_pickle_by_value(module)

_CHANGES = "layer string, row int, delta array<double>, weight double"
_SUMS = "layer string, row int, g array<double>"


@dataclass
class NetTable:
    """``params`` is ``(layer, row, v, m, s)``: values and, once stepped with, Adam's moments.

    ``starts`` has the first multi-hot position of every slot, one number for each slot.
    ``steps`` counts the steps behind the moments.
    """

    params: DataFrame
    starts: np.ndarray
    wide: str  # the layer with a row per position: "emb", or "w1" of a raw multi-hot net
    single: bool = True  # passes run in single precision
    steps: int = 0


def slot_starts(slots: DataFrame) -> tuple[np.ndarray, int]:
    """First position of each slot, and the number of positions; ``slots`` has a row per slot."""
    sizes = [r["n_feats"] + 1 for r in slots.orderBy("slot_idx").select("n_feats").collect()]
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.concatenate([[0], ends[:-1]]).astype(np.int64), int(ends[-1])


def _start_value(layer: str, k: Column, seed: int) -> Column:
    """Normal within a radius of two deviations, from a hash of the place."""
    def uniform(salt: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(layer), F.col("row"), k, F.lit(seed), F.lit(salt)), F.lit(1 << 32)) / F.lit(2.0**32)

    within = 1.0 - float(np.exp(-2.0))  # share of a plane normal that lies in that radius
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(0) * within))
    return radius * F.cos(2.0 * float(np.pi) * uniform(1)) * nets.START_SPREAD


def hashed_net(
    slots: DataFrame, mode: str = "embedding", hidden=nets.HIDDEN, embedding: int = nets.EMBEDDING, seed: int = 0
) -> NetTable:
    """A start net written by Spark, row by row from hashes."""
    spark = slots.sparkSession
    starts, width = slot_starts(slots)
    shapes: list[tuple[str, int, int]] = []
    if mode == "embedding":
        shapes.append(("emb", width, embedding))
        width = len(starts) * embedding
    for i, size in enumerate([*hidden, 1], start=1):
        shapes += [(f"w{i}", width, size), (f"b{i}", 1, size)]
        width = size
    table = None
    for name, n, size in shapes:
        rows = spark.range(n).select(F.lit(name).alias("layer"), F.col("id").cast("int").alias("row"))
        if name.startswith("b"):
            v = F.array_repeat(F.lit(nets.START_BIAS), size)
        else:
            v = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k, name=name: _start_value(name, k, seed))
        rows = rows.select("layer", "row", v.alias("v"))
        table = rows if table is None else table.unionByName(rows)
    none = F.lit(None).cast("array<double>")
    table = materialize(table.withColumns({"m": none, "s": none}), "net", lasting=True)
    return NetTable(table, starts, "emb" if mode == "embedding" else "w1")


def as_table(spark: SparkSession, net: nets.Net) -> NetTable:
    """A net that is held whole, as a table."""
    none = F.lit(None).cast("array<double>")
    table = materialize(nets.net_frame(spark, net).withColumns({"m": none, "s": none}), "net", lasting=True)
    starts = np.flatnonzero(np.diff(net.slot_of, prepend=-1)).astype(np.int64)
    single = net.params["b1"].dtype == np.float32
    return NetTable(table, starts, "emb" if "emb" in net.params else "w1", single)


def lay_rows(rows: DataFrame) -> DataFrame:
    """``(at, instance_id, label, idx)``, written once and numbered, so that rows that share an id are dealt apart."""
    idx = F.coalesce("idx", F.array().cast("array<int>")).alias("idx")
    return materialize(
        rows.select(F.monotonically_increasing_id().alias("at"), "instance_id", "label", idx), "net-rows", lasting=True
    )


def _dealt(laid: DataFrame, net: NetTable, parts: int, seed: int) -> DataFrame:
    """One partition per part: its parameter rows, then its instances in seeded order."""
    order = F.xxhash64("at", F.lit(seed))
    placed = laid.select(
        F.pmod(order, F.lit(parts)).cast("int").alias("part"), order.alias("order"), "instance_id", "label", "idx"
    )
    is_wide = F.col("layer") == net.wide
    met = placed.select("part", F.explode("idx").alias("row")).distinct()
    wanted = met.join(net.params.where(is_wide), "row")
    narrow = net.params.where(~is_wide).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    given = wanted.unionByName(narrow).select("part", F.lit(0).alias("kind"), F.col("row").cast("long").alias("order"), "layer", "row", "v")
    both = given.unionByName(placed.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartitionById(parts, "part").sortWithinPartitions("kind", "layer", "order").drop("part", "order")


def _parts(laid: DataFrame, parts: int | None) -> int:
    return parts or int(laid.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _loss_of(table: DataFrame, column: str) -> tuple:
    loss = table.where(F.col("layer") == "loss").first()
    if loss is None:
        raise ValueError("a net cannot be trained without rows")
    return loss[column], loss


def train_epoch(
    laid: DataFrame, net: NetTable, parts: int | None = None, seed: int = 0,
    learning_rate: float = nets.LEARNING_RATE, batch: int = nets.BATCH,
) -> tuple[NetTable, float]:
    """The averaged net after one pass over ``laid`` (see ``lay_rows``), and its mean loss.

    Parts weigh by their rows; one that does not name a parameter row counts as no change.
    Each part starts with moments of its own, so the new table has none.
    """
    settings = (net.starts, net.wide, net.single)
    dealt = _dealt(laid, net, _parts(laid, parts), seed)
    changes = dealt.mapInPandas(net_parts.train(settings, learning_rate, batch), _CHANGES)
    mean = Summarizer.mean(array_to_vector(F.col("delta")), F.col("weight"))
    averaged = changes.groupBy("layer", "row").agg(mean.alias("mean"), F.sum("weight").alias("weight"))
    averaged = materialize(averaged.select("layer", "row", vector_to_array("mean").alias("mean"), "weight"), "changes", lasting=True)
    (loss,), total = _loss_of(averaged, "mean")
    share = F.col("weight") / F.lit(total["weight"])
    moved = averaged.where(F.col("layer") != "loss").select("layer", "row", F.transform("mean", lambda x: x * share).alias("delta"))
    v = F.when(F.col("delta").isNull(), F.col("v")).otherwise(F.zip_with("v", "delta", lambda a, b: a + b))
    none = F.lit(None).cast("array<double>")
    params = net.params.join(moved, ["layer", "row"], "left").select("layer", "row", v.alias("v"), none.alias("m"), none.alias("s"))
    params = materialize(params, "net", lasting=True)
    release(averaged)
    return replace(net, params=params, steps=0), loss


def train_step(
    laid: DataFrame, net: NetTable, parts: int | None = None,
    learning_rate: float = nets.LEARNING_RATE, batch: int = nets.BATCH,
) -> tuple[NetTable, float]:
    """One Adam step with the gradient of all instances, and the mean loss before it.

    The result is that of one process over one batch of all rows, for any number of parts.
    Moments are columns of the table, for rows that some instance has named; the step itself
    is a join and column arithmetic.
    """
    settings = (net.starts, net.wide, net.single)
    dealt = _dealt(laid, net, _parts(laid, parts), net.steps)
    sums = dealt.mapInPandas(net_parts.add_up(settings, batch), _SUMS).groupBy("layer", "row")
    summed = sums.agg(Summarizer.sum(array_to_vector(F.col("g"))).alias("g"))
    summed = materialize(summed.select("layer", "row", vector_to_array("g").alias("g")), "gradient", lasting=True)
    (loss, n), _ = _loss_of(summed, "g")
    t = net.steps + 1
    rate = float(learning_rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t))
    gradient = summed.where(F.col("layer") != "loss").select("layer", "row", F.transform("g", lambda x: x / n).alias("g"))
    zeros = F.transform("v", lambda _: F.lit(0.0))
    known = net.params.join(gradient, ["layer", "row"], "left").withColumn("moves", F.col("g").isNotNull() | F.col("m").isNotNull())
    known = known.withColumns({c: F.when(F.col("moves"), F.coalesce(c, zeros)) for c in ("g", "m", "s")})
    known = known.withColumns({
        "m": F.zip_with("m", "g", lambda m, g: 0.9 * m + 0.1 * g),
        "s": F.zip_with("s", "g", lambda s, g: 0.999 * s + 0.001 * g * g),
    })
    change = F.zip_with("m", "s", lambda m, s: rate * m / (F.sqrt(s) + 1e-8))
    v = F.when(F.col("moves"), F.zip_with("v", change, lambda a, b: a - b)).otherwise(F.col("v"))
    params = materialize(known.select("layer", "row", v.alias("v"), "m", "s"), "net", lasting=True)
    release(summed)
    return replace(net, params=params, steps=t), loss / n


def score(laid: DataFrame, net: NetTable, parts: int | None = None) -> DataFrame:
    """``(instance_id, label, p)`` for every row of ``laid``; each part is sent the rows that it names."""
    settings = (net.starts, net.wide, net.single)
    schema = laid.select("instance_id", "label", F.lit(0.0).alias("p")).schema
    return _dealt(laid, net, _parts(laid, parts), 0).mapInPandas(net_parts.predict(settings), schema)


@dataclass
class NetTableFit(Fit):
    net: NetTable | None = None


def train_dnn(
    train: DataFrame,
    evaluation: DataFrame,
    slots: DataFrame,
    mode: str = "embedding",
    hidden=nets.HIDDEN,
    embedding: int = nets.EMBEDDING,
    epochs: int = 1,
    learning_rate: float = nets.LEARNING_RATE,
    batch: int = nets.BATCH,
    parts: int | None = None,
    seed: int = 0,
    resolution: int | None = None,
    on_iteration: OnIteration | None = None,
) -> NetTableFit:
    """``plans.net.train_dnn`` with the net as a table. Rows are dealt anew every epoch;
    tables before the last are deleted unless ``on_iteration`` has been given them."""
    spark = train.sparkSession
    rows, held_out = lay_rows(train), lay_rows(evaluation)
    n = rows.count()
    net = hashed_net(slots, mode, hidden, embedding, seed)
    history: list[tuple] = []
    for epoch in range(epochs):
        before = net
        net, loss = train_epoch(rows, before, parts, seed + epoch, learning_rate, batch)
        if epoch == 0 or not on_iteration:
            release(before.params)
        with scratch(spark):
            result = evaluate(score(held_out, net, parts), resolution).first()
        history.append((epoch, n, result["auc"], result["mae"], float(loss)))
        if on_iteration:
            on_iteration(epoch, net.params)
    release(rows)
    release(held_out)
    return NetTableFit(net.params.select("layer", "row", "v"), history_frame(spark, history), net=net)
