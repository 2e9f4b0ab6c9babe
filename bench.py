"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each time is the median of warm runs. Inputs a job would find already written (filtered
instances, laid-out tokens, a model) are prepared outside the clock.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from adloom.catalog import queries as q
from adloom.operators import factor, linear, metrics, tokens, vocab
from adloom.plans import convex, fm, gd, net
from adloom.plans.training import lay_out
from adloom.session import tune
from adloom.sources.tables import event_instances, order_tokens
from adloom.workspace import materialize

RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def jobs(spark: SparkSession, d: str):
    yield "feature_stat", lambda: drain(tokens.feature_stat(order_tokens(spark, d)))

    instances = event_instances(spark, d)
    stat = tokens.feature_stat(tokens.explode_tokens(instances))
    keep = materialize(tokens.frequent_features(stat, q.MIN_SHOWS), "keep")
    yield "filter_instances", lambda: drain(tokens.filter_instances(instances, keep))

    order_layout = lay_out(order_tokens(spark, d)).all()
    orders = order_layout.tokens
    model = materialize(q.log_odds(tokens.feature_stat(order_tokens(spark, d))), "weights")
    n = order_layout.n_instances
    yield "gd_iteration", lambda: drain(gd.gd_step(orders, model, n, hot=order_layout.hot))

    preds = materialize(linear.score_linear(orders, model), "preds")
    yield "score_linear", lambda: drain(linear.score_linear(orders, model))
    yield "auc_rounded", lambda: metrics.evaluate(preds, resolution=6).first()
    yield "auc_exact", lambda: metrics.evaluate(preds).first()

    kept = materialize(tokens.filter_instances(instances, keep), "kept")
    train, held_out = tokens.split_train_eval(kept)
    yield "elastic_net_fit", lambda: convex.train_lr_elastic(train, held_out, keep, l1=3.0, l2=5.0)

    fm_model = materialize(fm.init_model(model, fm.FACTORS, 0.1), "fm")

    def fm_iteration():
        gradient = factor.fm_gradient(orders, fm_model, fm.FACTORS, n, order_layout.hot)
        stepped, _, _ = factor.fm_step_search(
            orders, fm_model, gradient, fm.FACTORS, n, hot=order_layout.hot
        )
        drain(stepped)

    yield "fm_iteration", fm_iteration

    def encode():
        dictionary = materialize(vocab.train_dictionary(tokens.explode_tokens(train)), "dictionary")
        table, slots = vocab.build_vocabulary(dictionary)
        drain(vocab.encode_slots(tokens.explode_tokens(kept), dictionary, table, slots))

    yield "vocabulary_encode", encode

    dictionary = materialize(vocab.train_dictionary(tokens.explode_tokens(train)), "dictionary")
    table, slots = vocab.build_vocabulary(dictionary)
    slots = materialize(slots, "slots")
    encoded = vocab.encode_slots(tokens.explode_tokens(kept), dictionary, table, slots)
    rows = materialize(vocab.index_rows(encoded, slots, kept), "rows")
    start = net.new_net(slots)
    yield "net_epoch", lambda: net.train_epoch(tokens.shuffle_instances(rows, 0), start)
    yield "net_score", lambda: drain(net.score_dnn(rows, start))


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    builder = builder.config("spark.sql.shuffle.partitions", cpus)
    builder = builder.config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    spark = tune(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name, job in jobs(spark, d):
        runs = []
        for _ in range(RUNS + 1):  # the first run warms up
            begin = time.perf_counter()
            job()
            runs.append(time.perf_counter() - begin)
        times[name] = round(statistics.median(runs[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    result = {
        "metric": "headline_jobs_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": d.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
