"""One query per operator over the given tables; floats are rounded for comparison."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions.columns import binarize_label, log_loss_term, sigmoid_clamped, token_parts
from adloom.operators import factor, linear, metrics, tokens, vocab
from adloom.operators.ranking import dense_index
from adloom.plans import convex, fm, gd, net, sharded_net
from adloom.plans.training import lay_out
from adloom.sinks import text as sinks
from adloom.sources import text as sources
from adloom.sources.tables import document_words, event_instances, order_tokens, read_table
from adloom.workspace import fresh_path, materialize

MIN_SHOWS = 50  # fixed value: the instance filter's threshold
MIN_FREQ = 700  # between the two slots of the orders, so that the threshold drops some
TIGHT_SHOWS = 420  # empties some of the events' instances
RATE = 0.5
FM_K = 4
FM_SCALE = 0.2
VOCAB = 200
BIG_SIGN = 2**64 - 1
NET_SHAPE = (4, 3, 1)  # widths of the fixed net's layers


def r(column: Column | str, digits: int = 6) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def bigint_sign(df: DataFrame) -> DataFrame:
    """Table signs fit BIGINT, which both engines compare alike."""
    return df.withColumn("sign", F.col("sign").cast("bigint"))


def event_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.explode_tokens(event_instances(spark, d))


def event_stat(spark: SparkSession, d: str) -> DataFrame:
    return materialize(tokens.feature_stat(event_tokens(spark, d)), "stat")


def kept_signs(spark: SparkSession, d: str) -> DataFrame:
    stat = tokens.feature_stat(event_tokens(spark, d))
    return materialize(tokens.frequent_features(stat, MIN_SHOWS), "keep")


def kept_instances(spark: SparkSession, d: str) -> DataFrame:
    return tokens.filter_instances(event_instances(spark, d), kept_signs(spark, d))


def tight_instances(spark: SparkSession, d: str) -> DataFrame:
    """Instances of which some lose all of their features."""
    stat = tokens.feature_stat(event_tokens(spark, d))
    keep = materialize(tokens.frequent_features(stat, TIGHT_SHOWS), "keep")
    return tokens.filter_instances(event_instances(spark, d), keep)


def split_tokens(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    train, held_out = tokens.split_train_eval(
        materialize(kept_instances(spark, d), "kept")
    )
    return tokens.explode_tokens(train), tokens.explode_tokens(held_out)


def log_odds(stat: DataFrame) -> DataFrame:
    """A simple weight per feature, taken from its own clicks."""
    clicked = F.col("click_sum").cast("double") + 1
    skipped = (F.col("show_sum") - F.col("click_sum")).cast("double") + 1
    return stat.select("sign", (F.ln(clicked / skipped) / 4).alias("w"))


def event_weights(spark: SparkSession, d: str) -> DataFrame:
    return materialize(log_odds(tokens.feature_stat(event_tokens(spark, d))), "weights")


def order_weights(t: DataFrame) -> DataFrame:
    return materialize(log_odds(tokens.feature_stat(t)), "weights")


def event_preds(spark: SparkSession, d: str) -> DataFrame:
    return linear.score_linear(event_tokens(spark, d), event_weights(spark, d))


def event_fm(spark: SparkSession, d: str) -> DataFrame:
    weights = event_weights(spark, d)
    start = fm.init_model(weights, FM_K, FM_SCALE, arithmetic=True)
    return materialize(start.drop("w").join(weights, "sign").select("sign", "w", "v"), "fm")


def factor_rows(df: DataFrame, v: str, *others: str) -> DataFrame:
    return df.select(*others, F.posexplode(v).alias("k", "value"))


# ---- sources -----------------------------------------------------------------------


def write_event_lines(spark: SparkSession, d: str) -> str:
    path = fresh_path(spark, "lines")
    sinks.write_instances(event_instances(spark, d), path)
    return path


def read_instances(spark, d):
    read = sources.read_instances(spark, write_event_lines(spark, d), label_mode="raw")
    return bigint_sign(tokens.explode_tokens(read))


def read_instances_slot(spark, d):
    read = sources.read_instances(spark, write_event_lines(spark, d), need_slot=True)
    return read.select(
        "instance_id",
        "label",
        F.size("feats").alias("n_feats"),
        F.array_join(F.transform("feats", lambda f: f["slot"].cast("string")), ",").alias("slots"),
    )


def write_odd_lines(spark: SparkSession, d: str) -> str:
    """Event lines with ids that look like features, signs beyond BIGINT, and malformed fields."""
    def every(n: int, then: Column | str, other: Column | str = "") -> Column:
        then, other = (c if isinstance(c, Column) else F.lit(c) for c in (then, other))
        return F.when(F.col("instance_id") % n == 0, then).otherwise(other)

    id_ = F.col("instance_id").cast("string")
    tokens_ = F.transform("feats", lambda f: F.concat_ws(":", f["sign"], f["slot"]))
    line = F.concat(
        every(7, F.concat(id_, F.lit(":9")), id_), F.lit(" "), "shows", F.lit(" "),
        every(11, "x", F.col("clicks").cast("string")), F.lit(" "), F.array_join(tokens_, " "),
        every(13, f" {BIG_SIGN}:4"), every(17, " a:b"), every(5, " plain 1:2:3"),
    )
    path = fresh_path(spark, "lines")
    event_instances(spark, d).select(line.alias("value")).write.text(path)
    return path


def read_instances_strict(spark, d):
    """Ids that are no numbers and features from the fourth field on."""
    read = sources.read_instances(spark, write_odd_lines(spark, d), ids="generated", strict=True)
    return read.select(
        "line_id", "shows", "clicks", "label", F.size("feats").alias("n_feats"),
        F.array_join(F.transform("feats", lambda f: f["sign"].cast("string")), ",").alias("signs"),
    )


def read_rejects(spark, d):
    return sources.read_rejects(spark, write_odd_lines(spark, d), ids="generated", strict=True)


def read_feature_list(spark, d):
    path = fresh_path(spark, "features")
    sinks.write_feature_list(kept_signs(spark, d), path)
    return bigint_sign(sources.read_feature_list(spark, path))


def read_feature_freq(spark, d):
    path = fresh_path(spark, "freq")
    sinks.write_feat_freq(tokens.feature_freq(order_tokens(spark, d)), path)
    return bigint_sign(sources.read_feature_freq(spark, path, MIN_FREQ))


def read_feat_stat_text(spark, d):
    path = fresh_path(spark, "stat")
    sinks.write_feat_stat(tokens.feature_stat(event_tokens(spark, d)), path, "text")
    return bigint_sign(sources.read_feat_stat_text(spark, path))


def read_slot_stat(spark, d):
    path = fresh_path(spark, "slots")
    counts = order_tokens(spark, d).groupBy("sign", "slot").count()
    counts.select(F.concat_ws(" ", "count", F.concat_ws(":", "sign", "slot"))).write.text(path)
    return bigint_sign(sources.read_slot_stat(spark, path, MIN_FREQ))


def read_predictions(spark, d):
    path = fresh_path(spark, "preds")
    sinks.write_predictions(event_preds(spark, d), path, 0)
    return sources.read_predictions(spark, sinks.iteration_path(path, 0)).select("label", r("p").alias("p"))


# ---- sinks -------------------------------------------------------------------------


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value")


def feat_stat_roundtrip(spark, d):
    path = fresh_path(spark, "stat")
    sinks.write_feat_stat(tokens.feature_stat(event_tokens(spark, d)), path)
    return spark.read.parquet(path)


def feature_list_roundtrip(spark, d):
    path = fresh_path(spark, "features")
    sinks.write_feature_list(kept_signs(spark, d), path)
    return _lines(spark, path)


def instances_text(spark, d):
    path = fresh_path(spark, "lines")
    sinks.write_instances(tight_instances(spark, d), path)
    return _lines(spark, path)


def feat_freq_roundtrip(spark, d):
    path = fresh_path(spark, "freq")
    sinks.write_feat_freq(tokens.feature_freq(order_tokens(spark, d)), path)
    return _lines(spark, path)


def weights_text(spark, d):
    path = fresh_path(spark, "weights")
    sinks.write_weights(event_weights(spark, d), path, 3)
    return spark.read.text(path).select("value", F.col("iter").cast("int").alias("iter"))


def gradient_text(spark, d):
    path = fresh_path(spark, "gradient")
    t = event_tokens(spark, d)
    sinks.write_gradient(linear.gradient_linear(t, event_weights(spark, d)), path, 0)
    return _lines(spark, sinks.iteration_path(path, 0))


def predictions_text(spark, d):
    path = fresh_path(spark, "preds")
    sinks.write_predictions(event_preds(spark, d), path, 0)
    return _lines(spark, sinks.iteration_path(path, 0))


def fm_weights_text(spark, d):
    path = fresh_path(spark, "fm")
    sinks.write_fm_weights(event_fm(spark, d), path, 0)
    return _lines(spark, sinks.iteration_path(path, 0))


# ---- projections, filters, sampling ------------------------------------------------


def explode_tokens(spark, d):
    return event_tokens(spark, d)


def token_validity(spark, d):
    """Every third word becomes a feature, every third has a colon too many."""
    fields = F.transform(
        F.split("text", " "),
        lambda word, i: F.when(i % 3 == 0, F.concat(word, F.lit(":"), i))
        .when(i % 3 == 1, F.concat(word, F.lit(":1:"), i))
        .otherwise(word),
    )
    return read_table(spark, d, "documents").select(
        "doc_id",
        F.size(fields).alias("n_tokens"),
        F.size(token_parts(fields)).alias("n_valid"),
    )


def frequent_features(spark, d):
    return tokens.frequent_features(tokens.feature_stat(event_tokens(spark, d)), MIN_SHOWS)


def filter_instances(spark, d):
    signs = F.transform("feats", lambda f: f["sign"].cast("string"))
    return tight_instances(spark, d).select(
        "instance_id", "shows", "clicks", "label", F.array_join(signs, " ").alias("signs")
    )


def binary_label(spark, d):
    return (
        order_tokens(spark, d, "raw")
        .select("instance_id", "clicks")
        .distinct()
        .select("instance_id", "clicks", binarize_label(F.col("clicks")).alias("label"))
    )


def sigmoid(spark, d):
    z = (F.col("l_extendedprice") - 50000.0) / 1000.0
    q = F.col("l_quantity")
    return read_table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        r(sigmoid_clamped(z, 30.0)).alias("p_lr"),
        r(sigmoid_clamped(z * 20, 500.0)).alias("p_fm"),
        r(0.5 * q * q - 2.0).alias("affine"),
        r(F.abs(z)).alias("magnitude"),
        r(F.sqrt(q)).alias("root"),
        r(log_loss_term(F.lit(1), F.col("l_tax"))).alias("loss"),
    )


def sample_instances(spark, d):
    return tokens.sample_instances(event_instances(spark, d), 0.1, seed=3).select("instance_id", "label")


def split_train_eval(spark, d):
    train, held_out = tokens.split_train_eval(event_instances(spark, d))
    return (
        train.select("instance_id", F.lit("train").alias("part"))
        .unionByName(held_out.select("instance_id", F.lit("eval").alias("part")))
    )


def shuffle_instances(spark, d):
    return tokens.shuffle_instances(event_instances(spark, d), seed=1).select("instance_id", "label")


def assign_batches(spark, d):
    return tokens.assign_batches(event_instances(spark, d), 256)


# ---- joins -------------------------------------------------------------------------


def attach_weights(spark, d):
    train, held_out = split_tokens(spark, d)
    weights = materialize(log_odds(tokens.feature_stat(train)), "weights")
    return linear.attach_weights(event_tokens(spark, d), weights).select(
        "instance_id", "pos", "sign", r("w").alias("w")
    )


def index_gradient(spark, d):
    t = event_tokens(spark, d)
    gradient = linear.gradient_linear(t, event_weights(spark, d))
    return linear.index_gradient(gradient, dense_index(kept_signs(spark, d), "sign")).select(
        "idx", r("g").alias("g")
    )


def merge_weights(spark, d):
    """Event and order features share some signs but not all."""
    weights, delta = event_weights(spark, d), order_weights(order_tokens(spark, d))
    return linear.merge_weights(weights, delta).select("sign", r("w").alias("w"))


def encoded_events(spark, d, v: int = VOCAB):
    """Training dictionary and vocabulary from nine tenths of the events; all encoded."""
    instances = event_instances(spark, d)
    train, _ = tokens.split_train_eval(instances)
    dictionary = materialize(vocab.train_dictionary(tokens.explode_tokens(train)), "dictionary")
    table, slots = vocab.build_vocabulary(dictionary, v)
    table, slots = materialize(table, "vocab"), materialize(slots, "slots")
    encoded = vocab.encode_slots(tokens.explode_tokens(instances), dictionary, table, slots)
    return encoded, slots


def encode_slots(spark, d):
    return encoded_events(spark, d)[0]


# ---- aggregations ------------------------------------------------------------------


def feature_stat(spark, d):
    return tokens.feature_stat(order_tokens(spark, d))


def feature_freq(spark, d):
    return tokens.feature_freq(order_tokens(spark, d))


def distinct_features(spark, d):
    """Features frequent among events, orders or both."""
    by_events = tokens.feature_stat(event_tokens(spark, d))
    by_orders = tokens.feature_stat(order_tokens(spark, d))
    return tokens.frequent_features(by_events.unionByName(by_orders), MIN_SHOWS)


def count_instances(spark, d):
    return tokens.count_instances(event_instances(spark, d))


def score_linear(spark, d):
    return event_preds(spark, d).select("instance_id", "label", r("p").alias("p"))


def gradient_linear(spark, d):
    t = order_tokens(spark, d, "raw")
    return linear.gradient_linear(t, order_weights(t)).select("sign", r("g", 2).alias("g"))


def sum_vectors(spark, d):
    df = read_table(spark, d, "embeddings").select(
        "label", F.col("embedding").cast("array<double>").alias("v")
    )
    return factor_rows(factor.sum_vectors(df, "label", "v", 64), "v", "label").select(
        "label", "k", r("value", 4).alias("total")
    )


def sampled_count(spark, d):
    return linear.sampled_count(tokens.sample_instances(order_tokens(spark, d), RATE, seed=1))


def log_loss(spark, d):
    return metrics.log_loss(event_preds(spark, d)).select(r("loss").alias("loss"))


def mae(spark, d):
    t = order_tokens(spark, d, "raw")
    return metrics.mae(linear.score_linear(t, order_weights(t))).select(r("mae").alias("mae"))


def train_dictionary(spark, d):
    """Every third instance has its features under other slots; the first slot of a sign wins."""
    slot = F.when(F.col("instance_id") % 3 == 0, F.col("slot") + 10).otherwise(F.col("slot"))
    return vocab.train_dictionary(event_tokens(spark, d).withColumn("slot", slot))


def repeated(encoded: DataFrame) -> DataFrame:
    """The tokens of every second instance occur twice."""
    return encoded.unionByName(encoded.where(F.col("instance_id") % 2 == 0))


def slot_embedding(slots: DataFrame) -> DataFrame:
    """Two numbers per vocabulary index, the last index of each slot included."""
    return slots.select(
        "slot_idx", F.explode(F.sequence(F.lit(0), F.col("n_feats"))).alias("feat_idx")
    ).withColumn(
        "v",
        F.array(
            (F.pmod(F.col("slot_idx") * 31 + F.col("feat_idx") * 17, F.lit(23)) - 11) / 10.0,
            (F.pmod(F.col("slot_idx") * 7 + F.col("feat_idx") * 5, F.lit(19)) - 9) / 10.0,
        ),
    )


def pool_embeddings(spark, d):
    encoded, slots = encoded_events(spark, d)
    pooled = vocab.pool_embeddings(
        repeated(encoded), slot_embedding(slots), event_instances(spark, d), slots.count(), 2
    )
    return factor_rows(pooled, "v", "instance_id", "slot_idx").select(
        "instance_id", "slot_idx", "k", r("value").alias("value")
    )


def multi_hot(spark, d):
    return vocab.multi_hot(repeated(encoded_events(spark, d)[0])).select(
        "instance_id", "slot_idx", F.array_join(F.col("active").cast("array<string>"), ",").alias("active")
    )


def score_fm(spark, d):
    return factor.score_fm(event_tokens(spark, d), event_fm(spark, d), FM_K).select(
        "instance_id", "label", r("p").alias("p")
    )


def weight_norms(spark, d):
    return linear.weight_norms(event_weights(spark, d)).select(r("l2_sq").alias("l2_sq"), r("l1").alias("l1"))


def objective(spark, d):
    preds, weights = event_preds(spark, d), event_weights(spark, d)
    penalized = linear.objective(preds, weights, l1=3.0, l2=5.0)
    averaged = linear.objective(preds, weights, l2=4.0, mean=True)
    return penalized.withColumn("form", F.lit("sum")).unionByName(
        averaged.withColumn("form", F.lit("mean"))
    ).select("form", r("objective").alias("objective"))


def loss_and_gradient(spark, d):
    """The gradient of every dictionary feature, and the objective as row -1."""
    dictionary = materialize(dense_index(kept_signs(spark, d), "sign"), "dictionary")
    loss, gradient = linear.loss_and_gradient(
        event_tokens(spark, d), event_weights(spark, d), dictionary, l2=4.0, mean=True
    )
    none = F.lit(-1).cast("bigint")
    return loss.select(none.alias("sign"), none.alias("idx"), r("objective").alias("value")).unionByName(
        gradient.select("sign", "idx", r("g").alias("value"))
    )


def embedding_moments(spark, d):
    """Moments of all vectors; moving ones over the even and then the odd rows."""
    pooled = read_table(spark, d, "embeddings").select(
        "vec_id", F.col("label").alias("slot_idx"), F.col("embedding").alias("v")
    )
    moments = vocab.embedding_moments(pooled, 64)
    moving = None
    for half in (0, 1):
        batch = pooled.where(F.col("vec_id") % 2 == half)
        moving = materialize(vocab.update_moments(moving, vocab.embedding_moments(batch, 64)), "moving")
    return moments.join(
        moving.withColumnsRenamed({"mean": "moving_mean", "variance": "moving_variance"}),
        ["slot_idx", "dim"],
    ).select(
        "slot_idx", "dim", *[r(c).alias(c) for c in ("mean", "variance", "moving_mean", "moving_variance")]
    )


def pseudo_gradient(spark, d):
    """At weights of which the small ones have been set to 0."""
    t, weights = event_tokens(spark, d), event_weights(spark, d)
    small = F.abs("w") < 0.35
    mixed = materialize(
        weights.select("sign", F.when(small, 0.0).otherwise(F.col("w")).alias("w")), "weights"
    )
    gradient = linear.gradient_linear(t, mixed)
    return linear.pseudo_gradient(gradient, mixed, l1=4.0).select("sign", r("pg").alias("pg"))


# ---- ranking -----------------------------------------------------------------------


def auc(spark, d):
    return metrics.auc(event_preds(spark, d), resolution=6).select(r("auc").alias("auc"), "n_pos", "n_neg")


def value_preds(spark, d, score: Column) -> DataFrame:
    """Scores that both engines hold to the last bit."""
    return event_instances(spark, d).select("instance_id", "label").join(
        read_table(spark, d, "events").select(F.col("event_id").alias("instance_id"), score.alias("p")), "instance_id"
    )


def auc_exact(spark, d):
    preds = value_preds(spark, d, F.col("value") / 500)
    return metrics.auc(preds).select(r("auc").alias("auc"), "n_pos", "n_neg")


def auc_margins(spark, d):
    """Rounded scores outside [0, 1]."""
    preds = value_preds(spark, d, F.floor("value").cast("double") - 150)
    return metrics.auc(preds, resolution=6).select(r("auc").alias("auc"), "n_pos", "n_neg")


def word_index(spark, d):
    return dense_index(document_words(spark, d), "word")


def top_features(spark, d):
    dictionary = vocab.train_dictionary(event_tokens(spark, d))
    return vocab.top_features(dictionary, VOCAB)


def build_vocabulary(spark, d):
    table, slots = vocab.build_vocabulary(vocab.train_dictionary(event_tokens(spark, d)), VOCAB)
    return table.join(F.broadcast(slots.select("slot", "n_feats")), "slot")


# ---- training ----------------------------------------------------------------------


def _gd_weights(spark, d, mode: str, steps: int, compat: bool = False, rate: float = RATE):
    layout = lay_out(order_tokens(spark, d), rate)
    weights = gd.no_weights(layout.tokens)
    expected = layout.all().n_instances * rate
    for i in range(steps):
        part = layout.sample(i)
        weights = materialize(
            gd.gd_step(
                part.tokens, weights, part.n_instances,
                mode=mode, n_expected=expected, compat=compat, hot=part.hot,
            ),
            "weights",
        )
    return weights.select("sign", r("w").alias("w"))


def gd_step_per_instance(spark, d):
    return _gd_weights(spark, d, "per_instance", 2)


def gd_step_aggregated(spark, d):
    return _gd_weights(spark, d, "aggregated", 2, rate=1.0)


def gd_step_compat(spark, d):
    return _gd_weights(spark, d, "aggregated", 2, compat=True)


def _gd_fit(spark, d, **options):
    train, held_out = split_tokens(spark, d)
    return gd.train_lr_gd(train, held_out, rate=RATE, max_iter=3, **options)


def train_lr_gd(spark, d):
    return _gd_fit(spark, d).weights.select("sign", r("w").alias("w"))


def train_lr_gd_colocated(spark, d):
    """The same fit over tokens bucketed by instance."""
    return _gd_fit(spark, d, colocate=True).weights.select("sign", r("w").alias("w"))


def train_history(spark, d):
    """The log of a run whose callback saves the weights after every iteration."""
    path = fresh_path(spark, "run")
    fit = _gd_fit(spark, d, resolution=6, on_iteration=lambda i, w: sinks.write_weights(w, path, i))
    saved = spark.read.text(path).groupBy(F.col("iter").cast("int").alias("iter")).agg(
        F.count(F.lit(1)).alias("n_saved")
    )
    return fit.history.join(saved, "iter").select(
        "iter", "n_sampled", "n_saved", *[r(c).alias(c) for c in ("auc", "mae", "loss")]
    )


def _convex_data(spark, d):
    keep = kept_signs(spark, d)
    kept = materialize(tokens.filter_instances(event_instances(spark, d), keep), "kept")
    return *tokens.split_train_eval(kept), keep


def train_lr_l2(spark, d):
    fit = convex.train_lr_l2(*_convex_data(spark, d), tol=1e-7, solver="tables")
    return fit.weights.select("sign", r("w", 4).alias("w"))


def train_lr_elastic(spark, d):
    fit = convex.train_lr_elastic(*_convex_data(spark, d), l1=3.0, l2=5.0, tol=1e-13, solver="path")
    return fit.weights.select("sign", r("w", 4).alias("w"))


def fm_gradient(spark, d):
    # Rare features have no model row.
    model = event_fm(spark, d).join(kept_signs(spark, d), "sign", "left_semi")
    gradient = factor.fm_gradient(event_tokens(spark, d), model, FM_K)
    return factor_rows(gradient, "gv", "sign", "g").select(
        "sign", "k", r("g", 5).alias("g"), r("value", 5).alias("gv")
    )


def fm_step_search(spark, d):
    t, model = event_tokens(spark, d), event_fm(spark, d)
    n = event_instances(spark, d).count()
    gradient = factor.fm_gradient(t, model, FM_K)
    stepped, accepted, trace = factor.fm_step_search(t, model, gradient, FM_K, n)
    v_sum = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    sums = stepped.agg(r(F.sum("w"), 4).alias("w_sum"), r(F.sum(v_sum), 4).alias("v_sum")).first()
    rows = [(m, loss, int(m == accepted)) for m, loss in trace]
    return spark.createDataFrame(rows, "multiplier int, loss double, accepted int").select(
        "multiplier", r("loss", 4).alias("loss"), "accepted",
        F.lit(sums["w_sum"]).alias("w_sum"), F.lit(sums["v_sum"]).alias("v_sum"),
    )


def train_fm(spark, d):
    train, held_out = split_tokens(spark, d)
    fit = fm.train_fm(
        train, held_out, kept_signs(spark, d),
        k=FM_K, rate=RATE, max_iter=2, init_scale=FM_SCALE, arithmetic=True,
    )
    return factor_rows(fit.weights, "v", "sign", "w").select(
        "sign", "k", r("w", 5).alias("w"), r("value", 5).alias("v")
    )


def _net_data(spark, d):
    encoded, slots = encoded_events(spark, d)
    rows = materialize(vocab.index_rows(encoded, slots, event_instances(spark, d)), "rows")
    return *tokens.split_train_eval(rows), slots


def train_dnn_embedding(spark, d):
    return net.train_dnn(*_net_data(spark, d), mode="embedding", epochs=2).history


def train_dnn_discrete(spark, d):
    return net.train_dnn(*_net_data(spark, d), mode="discrete", epochs=1).history


def fixed_net(slots: DataFrame) -> net.Net:
    """A small net whose parameters follow from their positions."""
    sizes = [row["n_feats"] + 1 for row in slots.orderBy("slot_idx").collect()]
    slot_of = np.repeat(np.arange(len(sizes)), sizes)
    feat_of = np.concatenate([np.arange(s) for s in sizes])
    params = {"emb": (((slot_of * 31 + feat_of * 17) % 23 - 11) / 10.0)[:, None]}
    width = len(sizes)
    for i, size in enumerate(NET_SHAPE, start=1):
        a, b = np.indices((width, size))
        params[f"w{i}"] = ((a * 13 + b * 7 + i) % 11 - 5) / 10.0
        params[f"b{i}"] = np.full((1, size), 0.1)
        width = size
    return net.Net(slot_of, params)


def score_dnn(spark, d):
    encoded, slots = encoded_events(spark, d)
    rows = vocab.index_rows(encoded, slots, event_instances(spark, d))
    return net.score_dnn(rows, fixed_net(slots)).select("instance_id", "label", r("p").alias("p"))


def train_dnn_step(spark, d):
    """One step of the small net with the gradient of all instances."""
    encoded, slots = encoded_events(spark, d)
    rows = vocab.index_rows(encoded, slots, event_instances(spark, d))
    start = fixed_net(slots)
    start.params["b1"] += 0.0137  # no unit stands exactly at the kink of its ReLU
    stepped, _, loss = net.train_step(rows, start)
    frame = net.net_frame(spark, stepped).select("layer", "row", F.posexplode("v").alias("k", "v"))
    whole = spark.createDataFrame([("loss", 0, 0, float(loss))], "layer string, row int, k int, v double")
    return frame.unionByName(whole).select("layer", "row", "k", r("v", 5).alias("v"))


def train_dnn_sharded_step(spark, d):
    """The same step by a net that is a table."""
    encoded, slots = encoded_events(spark, d)
    laid = sharded_net.lay_rows(vocab.index_rows(encoded, slots, event_instances(spark, d)))
    start = fixed_net(slots)
    start.params["b1"] += 0.0137
    stepped, loss = sharded_net.train_step(laid, sharded_net.as_table(spark, start))
    frame = stepped.params.select("layer", "row", F.posexplode("v").alias("k", "v"))
    whole = spark.createDataFrame([("loss", 0, 0, float(loss))], "layer string, row int, k int, v double")
    return frame.unionByName(whole).select("layer", "row", "k", r("v", 5).alias("v"))


def score_dnn_sharded(spark, d):
    encoded, slots = encoded_events(spark, d)
    laid = sharded_net.lay_rows(vocab.index_rows(encoded, slots, event_instances(spark, d)))
    scores = sharded_net.score(laid, sharded_net.as_table(spark, fixed_net(slots)))
    return scores.select("instance_id", "label", r("p").alias("p"))


def evaluate(spark, d):
    """Two full gradient steps on frequent features, then held-out AUC, MAE and loss."""
    train, held_out = split_tokens(spark, d)
    part = lay_out(train).all()
    weights = gd.no_weights(part.tokens)
    for _ in range(2):
        step = gd.gd_step(part.tokens, weights, part.n_instances, hot=part.hot)
        weights = materialize(step, "weights")
    result = metrics.evaluate(linear.score_linear(held_out, weights), resolution=6)
    return result.select(
        *[r(c).alias(c) for c in ("auc", "mae", "loss")], "n", "n_pos", "n_neg"
    )


QUERIES = {
    "read_instances": read_instances,
    "read_instances_slot": read_instances_slot,
    "read_instances_strict": read_instances_strict,
    "read_rejects": read_rejects,
    "read_feature_list": read_feature_list,
    "read_feature_freq": read_feature_freq,
    "read_feat_stat_text": read_feat_stat_text,
    "read_slot_stat": read_slot_stat,
    "read_predictions": read_predictions,
    "feat_stat_roundtrip": feat_stat_roundtrip,
    "feature_list_roundtrip": feature_list_roundtrip,
    "instances_text": instances_text,
    "feat_freq_roundtrip": feat_freq_roundtrip,
    "weights_text": weights_text,
    "gradient_text": gradient_text,
    "predictions_text": predictions_text,
    "fm_weights_text": fm_weights_text,
    "explode_tokens": explode_tokens,
    "token_validity": token_validity,
    "frequent_features": frequent_features,
    "filter_instances": filter_instances,
    "binarize_label": binary_label,
    "sigmoid_clamped": sigmoid,
    "sample_instances": sample_instances,
    "split_train_eval": split_train_eval,
    "shuffle_instances": shuffle_instances,
    "assign_batches": assign_batches,
    "attach_weights": attach_weights,
    "index_gradient": index_gradient,
    "merge_weights": merge_weights,
    "encode_slots": encode_slots,
    "feature_stat": feature_stat,
    "feature_freq": feature_freq,
    "distinct_features": distinct_features,
    "count_instances": count_instances,
    "score_linear": score_linear,
    "gradient_linear": gradient_linear,
    "sum_vectors": sum_vectors,
    "sampled_count": sampled_count,
    "log_loss": log_loss,
    "mae": mae,
    "train_dictionary": train_dictionary,
    "pool_embeddings": pool_embeddings,
    "multi_hot": multi_hot,
    "score_fm": score_fm,
    "weight_norms": weight_norms,
    "objective": objective,
    "loss_and_gradient": loss_and_gradient,
    "embedding_moments": embedding_moments,
    "pseudo_gradient": pseudo_gradient,
    "auc": auc,
    "auc_exact": auc_exact,
    "auc_margins": auc_margins,
    "dense_index": word_index,
    "top_features": top_features,
    "build_vocabulary": build_vocabulary,
    "gd_step_per_instance": gd_step_per_instance,
    "gd_step_aggregated": gd_step_aggregated,
    "gd_step_compat": gd_step_compat,
    "train_lr_gd": train_lr_gd,
    "train_lr_gd_colocated": train_lr_gd_colocated,
    "train_lr_l2": train_lr_l2,
    "train_lr_elastic": train_lr_elastic,
    "fm_gradient": fm_gradient,
    "fm_step_search": fm_step_search,
    "train_fm": train_fm,
    "train_dnn_embedding": train_dnn_embedding,
    "train_dnn_discrete": train_dnn_discrete,
    "train_dnn_step": train_dnn_step,
    "train_dnn_sharded_step": train_dnn_sharded_step,
    "score_dnn": score_dnn,
    "score_dnn_sharded": score_dnn_sharded,
    "evaluate": evaluate,
    "train_history": train_history,
}
