"""Substring dedup against a plain version over the words of each window."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from adloom.llm import substrings

W = substrings.WINDOW
SCHEMA = "doc_id long, text string, d long, a string, h int, spans string"


def plain(rows):
    words = [(t or "").encode().split() for _, t in rows]
    ids = [substrings.LAST if i is None else i for i, _ in rows]
    least = {}
    for d, own in zip(ids, words):
        for i in range(len(own) - W + 1):
            run = tuple(own[i : i + W])
            least[run] = min(least.get(run, d), d)
    out = []
    for (doc_id, _), d, own in zip(rows, ids, words):
        gone = {i + j for i in range(len(own) - W + 1) if least[tuple(own[i : i + W])] < d for j in range(W)}
        kept = b" ".join(x for i, x in enumerate(own) if i not in gone)
        out.append((doc_id, len(own), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_with_copies():
    random = np.random.default_rng(4)
    passage = [f"p{i}" for i in range(60)]
    rows = [(None, None), (1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "x " * 100), (6, "x " * 50 + "y"), (None, "x " * 20)]
    for n in range(60):
        own = [f"w{x}" for x in random.integers(0, 400, random.integers(0, 80))]
        if n % 3 == 0:
            at, a, b = random.integers(0, len(own) + 1), *sorted(random.integers(0, 61, 2))
            own[at:at] = passage[a:b]
        rows.append((100 - n, "\t".join(own) if n % 2 else "  ".join(own) + "\n"))
    for i in range(30):  # copies, some with one id, and a text that a third of the rows share
        rows.append((200 + i // 2, " ".join(passage)))
        rows.append((300 + i, rows[20 + i % 7][1]))
    rows += [rows[-1], rows[9], (None, " ".join(passage)), (None, " ".join(passage[:30]))]
    edges = ["a" * 12, "a", "naïve", "中文", "b\x00c", "b"] * 4
    rows += [(400, " ".join(edges)), (401, "\x0b".join(edges)), (402, "".join(edges)), (403, "\xa0".join(edges))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0, "c", 0, "c") for i, t in rows_with_copies()], SCHEMA)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_rows_are_those_of_a_plain_version(docs, monkeypatch):
    want = plain(rows_with_copies())
    assert got(substrings.digest(docs)) == want
    assert substrings.digest(docs.where("false")).collect() == []
    # Hot windows apart, spans not broadcast, other copies set aside, and no filter: the same rows.
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(substrings, "HOT", 50)
    monkeypatch.setattr(substrings, "HEAVY", 3)
    assert got(substrings.digest(docs)) == want
    monkeypatch.setattr(substrings, "LEAST_BITS", 100)
    assert got(substrings.digest(docs)) == want


def test_spans_are_maximal_and_text_is_kept(docs):
    for r in substrings.dedup_windows(docs).collect():
        spans = [(s["first"], s["last"]) for s in r["spans"]]
        assert sum(b - a + 1 for a, b in spans) == r["n_removed"]
        assert all(b + 1 < c for (_, b), (c, _) in zip(spans, spans[1:]))
        assert len(r["text"].encode().split()) == r["n_words"] - r["n_removed"]


@pytest.mark.parametrize("piece,slice_", [(1 << 18, 4 << 20), (7, 40), (64, 300)])
def test_hashes_name_windows(monkeypatch, piece, slice_):
    monkeypatch.setattr(substrings, "PIECE", piece)
    monkeypatch.setattr(substrings, "SLICE", slice_)
    substrings._piece_powers.cache_clear()
    texts = [t or "" for _, t in rows_with_copies()]
    batch = pa.RecordBatch.from_arrays([pa.array(["skipped", *texts])], ["text"]).slice(1)
    names, seen, row = {}, 0, 0
    for rows, data, offsets in substrings._slices([batch], 0):
        for h, check, text, pos in zip(*substrings.windows(data, offsets, 3)):
            own = texts[row + text].encode().split()
            assert names.setdefault((h, check), tuple(own[pos : pos + 3])) == tuple(own[pos : pos + 3])
            seen += 1
        row += rows.num_rows
    assert seen == sum(max(0, len(t.encode().split()) - 2) for t in texts) and len(set(names.values())) == len(names)
    substrings._piece_powers.cache_clear()


def test_filter_holds_all_it_was_given():
    random = np.random.default_rng(0)
    h = random.integers(0, 1 << 48, 20_000)
    made = substrings.Filter(len(h))
    table = np.frombuffer(b"".join(made.block(h[h % made.blocks == i]) for i in range(made.blocks)), np.uint8)
    assert len(made.holds(table, h)) == len(h)
    assert len(made.holds(table, random.integers(0, 1 << 48, 20_000))) < 400


def test_tables_are_released(docs, spark, tmp_path):
    from adloom.workspace import shared_dir
    from pathlib import Path

    before = set(Path(shared_dir(spark), "adloom").iterdir())
    substrings.digest(docs).collect()
    left = {p.name.split("-")[0] for p in set(Path(shared_dir(spark), "adloom").iterdir()) - before}
    assert left == {"heavy", "spans"}  # the result reads them
