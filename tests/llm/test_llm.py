"""The text operators against brute force, on small fixtures and edge rows."""

import gc
import hashlib
import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from adloom.llm import bpe, components, linededup, minhash, mixing, multi_index, shards, simhash, token_counts, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, size string, fp string"
LONG = "the same long word " * 3000
RUN = "\n".join(f"line {i} of a passage that many documents share with one another" for i in range(6))
TEXTS = [
    None, "", " ", "a", "A b", "a  b\n\nc\t", "\n", "no </s> <s> <|endoftext|>x", "naïve ▁ 中文 😀",
    LONG, LONG + "end", RUN, "own line\n" + RUN + "\nlast", RUN, "x " * 40, "you are an IDIOT!!!",
]
ROWS = [(i, t, "en", f"s{i % 3}" if i % 5 else None, i, "c", "c", "c") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[11], (None, "a text without an id", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def size(text):
    return len((text or "").encode().split())


def test_shards_are_gapless_and_near_equal(docs, none):
    got = shards.shard(docs, 4).collect()
    assert len(got) == len(ROWS) and shards.shard(none, 4).count() == 0
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    text = dict(r[:2] for r in ROWS)
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "bytes")


def test_overfull_groups_are_cut(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) AS text")
    sizes = [r["sum"] for r in shards.shard(rows, 8).groupBy("shard").agg({"size": "sum"}).toDF("shard", "sum").collect()]
    assert len(sizes) == 8 and max(sizes) < 1.08 * min(sizes)


def test_a_group_of_equal_rows_is_cut(spark, monkeypatch):
    drawn = []
    sample = shards._sample
    monkeypatch.setattr(shards, "_sample", lambda *a: drawn.append(sample(*a)) or drawn[-1])
    rows = spark.range(9000).selectExpr(
        "if(id % 3 = 0, null, id) AS doc_id", "if(id % 3 = 0, 'the hot text', concat('t', lpad(id, 11, '0'))) AS text", "'x' AS h", "1 AS c"
    )
    got = shards.shard(rows, 8).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 9000 and len(sizes) == 8 and sizes.max() <= 1.06 * sizes.min()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert max(map(len, drawn)) < 2 * shards.SAMPLE_PER_RANGE * 128  # 128 ranges; the hot group has 3000 rows
    keys = rows.selectExpr("xxhash64(text) AS h", "coalesce(doc_id, 0) AS d", "monotonically_increasing_id() AS c", "1L AS size")
    _, ranges, _ = shards.split(keys, 128)
    assert sum(ranges.values()) == 9000 and max(ranges.values()) <= shards.OVERFULL * 9000 / 128


def test_small_groups_share_a_shard(spark):
    rows = spark.range(8000).selectExpr("id AS doc_id", "concat('text ', id % 500) AS text")  # 16 rows a text, 0.2 % of the bytes
    got = shards.shard(rows, 8).toPandas()
    assert (got.groupby("text_crc32").shard.nunique() == 1).all() and got.shard.nunique() == 8


def test_mix_meets_targets(spark, docs, none):
    got = mixing.mix_copies(docs).collect()
    assert len(got) == len(ROWS) and mixing.mix_copies(none).count() == 0
    assert all(0 <= r["copies"] <= 2 for r in got)
    rows = spark.range(2000).selectExpr("id AS doc_id", "repeat('w ', int(id % 50)) AS text", "concat('s', id % 4) AS source")
    got = mixing.mix_copies(rows).toPandas()
    taken = (got.copies * got["size"]).groupby(got.source).sum()
    assert np.allclose(taken, got.groupby("source").target.first(), atol=60)
    again = mixing.mix_copies(rows).toPandas()
    assert sorted(zip(again.doc_id, again.copies)) == sorted(zip(got.doc_id, got.copies))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in mixing.mix_copies(docs).collect())


def test_search_is_near_brute_force(spark):
    x = np.random.default_rng(3).normal(size=(1500, 8)).astype(np.float32)
    x[700:900] = x[700]
    odd = [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [1.0]), (None, [1.0] * 8)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<float>")
    got = multi_index.search(rows).collect()
    assert {r["query_id"] for r in got} == set(range(0, 1500, 100))
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 11)) and all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(want.tolist()))
    assert hits >= 0.9 * 150
    same = [(5000, [9.0, 9.0 + i / 8]) for i in range(3)] + [(5001, [9.0, 9.0]), (5100, [9.0, 9.0])]
    both = rows.unionByName(spark.createDataFrame(same, rows.schema)).selectExpr("*", "1 AS row", "2 AS cell")
    short = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in multi_index.search(both).collect() if r["query_id"] >= 5000)
    want = []
    for n, (q, v) in enumerate(same):
        others = sorted((float(np.hypot(v[0] - x[0], v[1] - x[1])), i) for m, (i, x) in enumerate(same) if m != n)
        want += [(q, rank, i, d) for rank, (d, i) in enumerate(others, 1) if q % 100 == 0]
    assert short == sorted(want)
    assert multi_index.search(rows.where("false")).count() == 0
    assert multi_index.search(rows.where("vec_id in (100, 101)")).collect()[0]["vec_id"] == 101


def test_traversal_is_in_order():
    a, b = np.random.default_rng(0).random((2, 9))
    cells = multi_index.traverse(a, b, np.ones(81), 81)
    sums = [a[c // 9] + b[c % 9] for c in cells]
    assert sorted(cells) == list(range(81)) and sums == sorted(sums)


def test_urls(spark):
    rows = [
        (1, "http://EN.example.net/en/a?x"), (2, "http://b.net/"), (3, "http://example.com/de/1"), (4, "http://x.org/fr/"),
        (5, "http://a.com/xxx"), (6, "http://a.com/xxxl"), (7, "http://a.com/free-bonus"), (8, "http://a.com/free/free"),
        (9, None), (10, "no scheme xxx"), (11, "http://b.net"), (12, ""),
    ]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[i]["verdict"] for i in range(1, 13)] == "allow block block allow block allow block allow allow block allow allow".split()
    assert [got[i]["rule"] for i in range(1, 5)] == ["example.net/en/", "net/", "example.com/de/", "org/fr/"]
    assert (got[1]["host"], got[1]["path"], got[10]["host"]) == ("en.example.net", "/en/a", "")


def test_token_counts_are_the_librarys(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, path).collect())
    want = [(i or -1, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in ROWS]
    assert got == sorted((*w, w[2] > 4096) for w in want)
    assert token_counts.count_tokens(none, path).count() == 0


def test_bpe_is_the_librarys(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digest(docs, path).collect())
    want = []
    for i, t, *_ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i or -1, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digest(none, path).count() == 0


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_components(docs, none):
    prints = [plain_simhash(t) for _, t, *_ in ROWS]
    root = list(range(len(ROWS)))
    for _ in ROWS:
        for i, a in enumerate(prints):
            root[i] = min(root[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 2)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else 99, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert [g[1] for g in got] == [f"{p:016x}" for p, r in sorted(zip(prints, ROWS), key=lambda x: 99 if x[1][0] is None else x[1][0])]
    ids = {99 if r[0] is None else r[0]: ROWS[root[i]][0] for i, r in enumerate(ROWS)}
    assert all(c == ids[i] for i, _, c in got if i != 99)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))


def test_components_of_a_chain(spark):
    links = spark.range(60).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.sql("SELECT 100L AS a, 101L AS b UNION ALL SELECT null, 5L"))
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def plain_signature(text, hasher):
    """Minima of ``a * x + b`` in whole numbers, over runs that are spelled out."""
    words = [xxhash.xxh64_intdigest(w) for w in text.encode().split()]
    k, runs = min(5, len(words)), set()
    for i in range(len(words) - k + 1 if words else 0):
        run = words[i]
        for word in words[i + 1 : i + k]:
            run = ((run ^ run >> 29) * 0x9E3779B97F4A7C15 + word) % 2**64
        runs.add(run ^ run >> 32)
    least = [min(((int(a) * x + int(b)) % 2**64 for x in runs), default=2**64 - 1) for a, b in zip(hasher.a, hasher.b)]
    return [m >> 16 & 0xFFFF for m in least]


def plain_edited(rows):
    """All columns of the result for rows (doc_id, text), by the definition."""
    from adloom.llm.minhash import MinHash

    hasher, out = MinHash(), []
    signed = [xxhash.xxh64_intdigest(t.encode(), 42) for _, t in rows]  # Spark's xxhash64 of a text
    signed = [h - 2**64 if h >= 2**63 else h for h in signed]
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, -(rows[n][0] or 0), signed[n]))
    prints = {}
    for n, m in zip(order, order[1:] + order[:1]):
        (i, text), next_ = rows[n], rows[m][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + next_[:half]
        a, b, c = (prints.setdefault(t, plain_signature(t, hasher)) for t in (text, edited, next_))
        out.append((
            str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:04x}" for x in a), "".join(f"{x:04x}" for x in b),
            sum(x == y for x, y in zip(a, b)) / 128, sum(x == y for x, y in zip(a, c)) / 128,
        ))
    return sorted(out)


def shown(frame):
    return sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in frame.collect())


def test_minhash_of_edited_texts(docs, none):
    got = minhash.edited_fingerprints(docs)
    assert shown(got) == plain_edited([(r[0], r[1] or "") for r in ROWS])
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[0]["fingerprint"] == by_id[1]["fingerprint"] and minhash.edited_fingerprints(none).count() == 0
    assert minhash.edited_fingerprints(docs.where("doc_id = 4")).first()["near_next"] == 1


@pytest.mark.parametrize("hot", ["concat('no id but a text ', id)", "'one text of all rows without an id'"])
def test_rows_with_one_id_spread(spark, monkeypatch, hot):
    monkeypatch.setattr(minhash, "COPIES", 100)
    rows = spark.range(1500).selectExpr("if(id % 3 = 0, null, id) AS doc_id", f"if(id % 3 = 0, {hot}, concat('an own text ', id % 700, ' here')) AS text")
    parts, copies = minhash._neighbours(rows, 8)
    sizes = [r["count"] for r in parts.groupBy("range").count().collect()]
    assert max(sizes) <= 2.2 * 1500 / 8 and (copies is None) == hot.startswith("concat")
    assert shown(minhash.edited_fingerprints(rows)) == plain_edited([tuple(r) for r in rows.collect()])


def test_minhash_classes(docs):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got[13] == 11 and got[10] == 9 and got[1] == got[0] and got[3] == 3


def test_line_runs(docs, none):
    got = {}
    for r in linededup.dedup_lines(docs, removed="gone").collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["gone"]))
    assert sorted(got[11]) == sorted([(RUN, 0), ("", 6)]) and got[13] == [("", 6)]
    assert got[12] == [("own line\nlast", 6)]
    assert all(got[i] == [(t, 0)] for i, t in enumerate(TEXTS) if i not in (11, 12, 13))
    assert linededup.dedup_lines(none).count() == 0
    ahead, back = linededup.windows(np.array([3, 0, 4, 1]), 4)
    assert ahead.tolist() == [2, 2, 2, -1] and back.tolist() == [-1, -1, 2, 2]


def test_toxicity_ranks_held_out_texts(spark, docs, none):
    bad = "('scum moron idiot')"
    rows = spark.range(1200).selectExpr("id AS doc_id", f"concat('plain word', id, ' text ', if(id % 4 = 0, {bad}, 'fine')) AS text")
    labels = spark.range(1200).selectExpr("id AS doc_id", "int(id % 4 = 0) AS toxic")
    got = toxicity.score(rows, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert held and all((r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    nobody = labels.where("false")
    assert toxicity.score(docs, nobody).count() == len(ROWS) and toxicity.score(none, nobody).count() == 0
    assert toxicity.reject_toxic(docs, nobody).columns == docs.columns


def test_pipeline_on_edge_rows(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (15, 1), (None, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def plain_runs(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else {()}


def plain_kept(rows):
    """Ids of the rows (id, text) that stay if one of each group with Jaccard >= 0.8 does."""
    runs = [plain_runs(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, x in enumerate(runs):
        for j in range(i):
            if len(x & runs[j]) >= 0.8 * len(x | runs[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, i), i)
    return sorted(least.values())


def near_texts(seed=5):
    """Texts and copies at 0.6 to 1 of one another, chains among them, and one large group of near misses."""
    random, rows = np.random.default_rng(seed), []
    for n in range(30):
        words = [f"w{x}" for x in random.integers(0, 5000, 300)]
        for edits in (0, 1, 3, 5, 7, 9, 12):
            rows.append(" ".join(words))
            for at in random.integers(0, 300, edits):
                words[at] = f"e{random.integers(1 << 30)}"
    page = [f"p{i}" for i in range(300)]
    for n in range(200):
        words = list(page)
        for at in random.integers(0, 300, 4 + n % 4):
            words[at] = f"f{n}-{at}"
        rows.append(" ".join(words))
    return list(enumerate(rows + [rows[3], rows[4].upper()]))


def test_pipeline_drops_pairs_of_likeness_080(spark, monkeypatch):
    rows = near_texts()
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = plain_kept(rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()) == want
    monkeypatch.setattr(minhash, "BLOCK", 8)  # the large group spans many blocks
    got = minhash.near_duplicates(frame.selectExpr("doc_id", "lower(text) AS text")).collect()
    assert sorted({r["class_id"] for r in got}) == want


def test_terms_are_counted_over_all_labels(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 8)
    rows = spark.range(1200).selectExpr("id AS doc_id", "concat('plain word', if(id % 12 = 0, ' rareword', '')) AS text")
    labels = spark.range(1200).selectExpr("id AS doc_id", "int(id % 4 = 0) AS toxic")
    assert "rareword" in toxicity.fit(rows, labels).learned


def test_a_worker_holds_one_thing():
    from adloom.llm.common import _held, held

    made = []
    assert held("a", lambda: made.append("a") or [1]) == [1] and held("a", lambda: made.append("again")) == [1]
    assert held("b") is None and _held == ["b", None]
    assert held("a", lambda: made.append("a") or [2]) == [2] and made == ["a", "a"]
    held(None)


def test_simhash_links_reach_the_pipeline(spark, monkeypatch):
    """With one band of the whole signature, only fingerprints can bring two texts together."""
    monkeypatch.setattr(minhash, "BAND_ROWS", minhash.PERMUTATIONS)
    words = [f"w{i}" for i in range(400)]
    text, base = " ".join(words), simhash.fingerprint(" ".join(words))
    near = [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(0, 400, 4)]
    near = next(t for t in near if 0 < (simhash.fingerprint(t) ^ base).bit_count() <= 2)
    hasher = minhash.MinHash()
    assert (hasher.signature(text) != hasher.signature(near)).any()
    rows = [(1, text), (2, near), (3, "nothing like it at all"), (4, None), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()) == [1, 3, 4]


def _kept_mb(make):
    """MB that Python objects take which ``make`` leaves behind."""
    gc.collect()
    tracemalloc.start()
    try:
        left = make()
        gc.collect()
        return tracemalloc.get_traced_memory()[0] / 1e6, left
    finally:
        tracemalloc.stop()


def test_a_worker_keeps_little_for_bpe():
    """Each Python worker of an executor has an automaton, with all that it may remember."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        vocabulary = f.read()
    mb, automaton = _kept_mb(lambda: bpe.Automaton(vocabulary))
    assert mb < 30  # 59 as dicts of tuples

    def fill():
        automaton.known.function = lambda word: bytes(8)
        for i in range(2 * 250_000):
            automaton.known.one(f"word{i}")
        for i in range(250_000):
            automaton.follows(i % 256, i // 256)

    mb, _ = _kept_mb(fill)
    assert mb < 55  # 80 with 250,000 words in a generation, and as many arcs


def test_minhash_keeps_no_words():
    hasher, text = minhash.MinHash(), " ".join(f"word{i}" for i in range(200_000))
    mb, _ = _kept_mb(lambda: len(hasher.shingles(text)))
    assert mb < 1
