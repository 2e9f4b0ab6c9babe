import pandas as pd
import pytest

from adloom.operators import vocab


def toks(spark, rows):
    return spark.createDataFrame(
        pd.DataFrame(rows, columns=["instance_id", "pos", "label", "sign", "slot"]),
        "instance_id long, pos int, label int, sign long, slot int",
    )


TRAIN = [
    (1, 0, 1, 100, 5), (1, 1, 1, 200, 6), (1, 2, 1, 100, 5),
    (2, 0, 0, 100, 9),  # later slot of a known feature
    (2, 1, 0, 300, 6), (3, 0, 0, 400, 7), (3, 1, 0, 200, 6),
]


@pytest.fixture
def built(spark):
    dictionary = vocab.train_dictionary(toks(spark, TRAIN))
    return dictionary, *vocab.build_vocabulary(dictionary, 2)


def test_first_slot_wins(built):
    assert {tuple(r) for r in built[0].collect()} == {(100, 5, 3), (200, 6, 2), (300, 6, 1), (400, 7, 1)}


def test_vocabulary(built):
    _, table, slots = built
    assert {tuple(r) for r in table.collect()} == {(100, 5, 3, 0, 0), (200, 6, 2, 1, 0)}
    assert {tuple(r) for r in slots.collect()} == {(5, 0, 1), (6, 1, 1)}


def test_vocabulary_larger_than_data(spark, built):
    table, slots = vocab.build_vocabulary(built[0], 1000)
    assert table.count() == 4
    # equal counts: the smaller sign ranks first, so slot 6 comes before slot 7
    assert {(r.slot, r.slot_idx) for r in slots.collect()} == {(5, 0), (6, 1), (7, 2)}


def test_encoding(spark, built):
    rows = [
        (8, 0, 1, 100, 99),  # slot of the line is ignored
        (8, 1, 1, 300, 6),  # rare: last index of slot 6
        (8, 2, 1, 555, 5),  # unseen in training
        (8, 3, 1, 400, 7),  # its slot is outside the vocabulary
        (9, 0, 0, 200, 6), (9, 1, 0, 200, 6),
    ]
    encoded = vocab.encode_slots(toks(spark, rows), *built)
    assert sorted(tuple(r) for r in encoded.collect()) == [(8, 1, 0, 0), (8, 1, 1, 1), (9, 0, 1, 0), (9, 0, 1, 0)]
    active = {(r.instance_id, r.slot_idx): r.active for r in vocab.multi_hot(encoded).collect()}
    assert active == {(8, 0): [0], (8, 1): [1], (9, 1): [0]}
    everyone = spark.createDataFrame([(8, 1), (9, 0), (10, 1)], "instance_id long, label int")
    rows = {r.instance_id: (r.label, r.idx) for r in vocab.index_rows(encoded, built[2], everyone).collect()}
    assert rows == {8: (1, [0, 3]), 9: (0, [2]), 10: (1, [])}  # 10 has nothing known
    embedding = spark.createDataFrame(
        [(0, 0, [1.0]), (0, 1, [2.0]), (1, 0, [5.0]), (1, 1, [7.0])], "slot_idx int, feat_idx int, v array<double>"
    )
    def pooled(dedupe):
        out = vocab.pool_embeddings(encoded, embedding, everyone, 2, 1, dedupe).collect()
        return {(r.instance_id, r.slot_idx): r.v for r in out}
    assert pooled(False) == {
        (8, 0): [1.0], (8, 1): [7.0], (9, 0): [0.0], (9, 1): [10.0],
        (10, 0): [0.0], (10, 1): [0.0],
    }
    assert pooled(True)[(9, 1)] == [5.0]


def test_moving_moments(spark):
    batch = spark.createDataFrame([(0, 0, 2.0, 0.5)], "slot_idx int, dim int, mean double, variance double")
    once = vocab.update_moments(None, batch)
    row = vocab.update_moments(once, batch).first()
    assert row.mean == pytest.approx(0.999 * 0.002 + 0.002)
    assert row.variance == pytest.approx(0.999 * (0.0999 + 0.0005) + 0.0005)
