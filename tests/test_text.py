import gzip

import pytest
from pyspark.sql import functions as F

from adloom.functions.columns import fixed
from adloom.operators.tokens import explode_tokens, filter_instances
from adloom.sinks import text as sinks
from adloom.sources import text as sources

BIG = 18446744073709551615


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture
def lines(tmp_path):
    return write(
        tmp_path / "part-00051",
        [
            "1 1 0 10:1 11:2",
            "2 3 1 10:1 10:1  ",  # repeated token, trailing blanks
            f"3 2 3 {BIG}:4",
            "4 1 0",  # no token
            "5 1 1 12: 13:3:4 :x",  # ':x' has no sign
            "6  1 0 10:1",  # two blanks shift the fields
            "7 1 1 a:b",
            "8 1 0 12: 1:2:3 plain",  # a missing slot is allowed where slots are not needed
            "x 1 0 10:1",
            "\t9 0 0 10:1\t",
            "10 1 1 1.5:2",
        ],
    )


def parsed(df):
    return {r.instance_id: (r.shows, r.clicks, r.label, [(int(f.sign), f.slot) for f in r.feats]) for r in df.collect()}


def test_instances(spark, lines):
    got = parsed(sources.read_instances(spark, lines))
    assert got == {
        1: (1, 0, 0, [(10, 1), (11, 2)]),
        2: (3, 1, 1, [(10, 1), (10, 1)]),
        3: (2, 3, 1, [(BIG, 4)]),
        4: (1, 0, 0, []),
        8: (1, 0, 0, [(12, None)]),
        9: (0, 0, 0, [(10, 1)]),
    }
    rejects = sources.read_rejects(spark, lines)
    assert rejects.count() == 5
    assert rejects.count() + len(got) == 11


def test_raw_label_and_slots(spark, lines):
    assert parsed(sources.read_instances(spark, lines, label_mode="raw"))[3][2] == 3
    assert 8 not in parsed(sources.read_instances(spark, lines, need_slot=True))


def test_generated_ids_are_stable(spark, lines):
    df = sources.read_instances(spark, lines, ids="generated")
    assert df.count() == 7
    assert sorted(df.collect()) == sorted(df.collect())
    assert df.select("instance_id").distinct().count() == 7


def test_gzip_folder_and_glob(spark, tmp_path):
    folder = tmp_path / "train"
    folder.mkdir()
    with gzip.open(folder / "part-00001.gz", "wt") as f:
        f.write("1 1 0 10:1\n")
    write(folder / "part-00051", ["2 1 1 11:1"])
    assert sources.read_instances(spark, str(folder)).count() == 2
    assert sources.read_instances(spark, f"{folder}/*51").count() == 1
    assert sources.read_instances(spark, f"{folder}/part-*.gz").count() == 1


def test_instance_roundtrip(spark, lines, tmp_path):
    first = sources.read_instances(spark, lines, label_mode="raw")
    sinks.write_instances(first.where("instance_id < 4"), str(tmp_path / "out"))
    again = sources.read_instances(spark, str(tmp_path / "out"), label_mode="raw")
    assert parsed(again) == {k: v for k, v in parsed(first).items() if k < 4}


def test_explode_keeps_empty_on_request(spark, lines):
    instances = sources.read_instances(spark, lines)
    assert explode_tokens(instances).where("instance_id = 4").count() == 0
    assert explode_tokens(instances, keep_empty=True).where("instance_id = 4").count() == 1


def test_feature_list_drops_repeats(spark, tmp_path):
    path = write(tmp_path / "f", ["30", "10", "30", f" {BIG} ", "bad"])
    got = {int(r.sign): r.idx for r in sources.read_feature_list(spark, path).collect()}
    assert got == {10: 0, 30: 1, BIG: 2}


def test_feature_freq(spark, tmp_path):
    path = write(tmp_path / "f", ["5\t10000", "3\t20000", "4\t9999"])
    got = {int(r.sign): (r.freq, r.idx) for r in sources.read_feature_freq(spark, path).collect()}
    assert got == {3: (20000, 0), 5: (10000, 1)}


def test_feat_stat_tuples(spark, tmp_path):
    path = write(tmp_path / "f", ["(12, (3, 1))", f"({BIG}L, (5, 0))", "junk"])
    got = {(int(r.sign), r.show_sum, r.click_sum) for r in sources.read_feat_stat_text(spark, path).collect()}
    assert got == {(12, 3, 1), (BIG, 5, 0)}


def test_slot_stat_in_any_order(spark, tmp_path):
    path = write(tmp_path / "f", ["499 1:2", "500 3:4", "900 5:6"])
    got = {(r.freq, int(r.sign), r.slot) for r in sources.read_slot_stat(spark, path).collect()}
    assert got == {(500, 3, 4), (900, 5, 6)}


def test_ids_that_are_no_numbers_stay(spark, tmp_path):
    path = write(tmp_path / "l", ["a7 1 0 10:1", "5:9 1 1 11:2 12:3"])
    read = sources.read_instances(spark, path, ids="generated", strict=True)
    assert {r.line_id: [int(f.sign) for f in r.feats] for r in read.collect()} == {"a7": [10], "5:9": [11, 12]}
    loose = sources.read_instances(spark, path, ids="generated").where("line_id = '5:9'").first()
    assert [int(f.sign) for f in loose.feats] == [5, 11, 12]
    keep = spark.createDataFrame([(10,), (12,)], "sign long").selectExpr("cast(sign AS decimal(20,0)) AS sign")
    sinks.write_instances(filter_instances(read, keep), str(tmp_path / "out"))
    assert {r.value for r in spark.read.text(str(tmp_path / "out")).collect()} == {"a7 1 0 10:1", "5:9 1 1 12:3"}


@pytest.mark.parametrize(("fmt", "good", "bad"), [
    ("feat_stat", "(12, (3, 1))", "(12, 3, 1)"),
    ("slot_stat", "900 5:6", "900 x:6"),
    ("predictions", "0.25\t1", "high\t1"),
])
def test_malformed_lines_are_rejected(spark, tmp_path, fmt, good, bad):
    path = write(tmp_path / "f", [good, bad, ""])
    read = {"feat_stat": sources.read_feat_stat_text, "slot_stat": sources.read_slot_stat, "predictions": sources.read_predictions}
    assert read[fmt](spark, path).count() == 1
    assert {r.line for r in sources.read_format_rejects(spark, path, fmt).collect()} == {bad, ""}


def test_prediction_orders(spark, tmp_path):
    a = write(tmp_path / "a", ["0.25\t1"])
    b = write(tmp_path / "b", ["1\t0.25"])
    want = [(1, 0.25)]
    assert [tuple(r) for r in sources.read_predictions(spark, a).collect()] == want
    assert [tuple(r) for r in sources.read_predictions(spark, b, "label,score").collect()] == want


def test_fm_line_without_factors(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, []), (2, 0.25, [0.125])], "sign long, w double, v array<double>")
    sinks.write_fm_weights(df, str(tmp_path / "fm"), 4)
    got = {r.value for r in spark.read.text(str(tmp_path / "fm" / "iter=4")).select("value").collect()}
    assert got == {"1\t0.500000\t", "2\t0.250000\t0.125000000000"}


def test_only_nonzero_weights_are_saved(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 0.0)], "sign long, w double")
    sinks.write_weights(df, str(tmp_path / "w"), 0)
    assert [r.value for r in spark.read.text(str(tmp_path / "w" / "iter=0")).select("value").collect()] == ["1\t0.500000"]


def test_decimals_round_the_value_and_not_its_shortest_name(spark):
    values = [0.1234567890125, 0.0000000000005, 2.0**-13, 3 * 2.0**-13, -1e-9, -0.0, 0.0000005, 123456.7890125, 9e12, 5e12 + 0.5]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    got = rows.select("x", fixed(F.col("x"), 6).alias("six"), fixed(F.col("x"), 12).alias("twelve")).collect()
    exact = [v for v in values if abs(v) < 1e6]
    assert {(r["x"], r["six"]) for r in got} == {(v, f"{v:.6f}") for v in values}
    assert {(r["x"], r["twelve"]) for r in got if abs(r["x"]) < 1e6} == {(v, f"{v:.12f}") for v in exact}
    model = spark.createDataFrame([(7, 0.0, values[:4])], "sign long, w double, v array<double>")
    line = model.select(sinks.fm_weight_line()).first()[0]
    assert line == "\t".join(["7", "0.000000", *[f"{v:.12f}" for v in values[:4]]])
