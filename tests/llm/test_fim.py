"""Fill-in-the-middle against a plain version over the units of the pattern."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adloom.llm import fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n long, form int, output string, h string"
TEXTS = [
    None, "", " ", "\n\t ", "a", " a ", "a b  c\n", "naïve 中文 😀 x", "<P> in it", "ends in <", "<S", "< P> <M x",
    "wide space and\x85more", "word " * 40_000, "x" * 5000 + " " * 5000 + "y",
]
ROWS = [(i, t, 1, 2, "c", "c") for i, t in enumerate(TEXTS * 8)] + [(None, "no id at all here", 0, 0, "", "")] * 2 + [(-7, "a b c d e f g", 0, 0, "", "")]


def plain(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    if h4 % 100 < 80:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(out), sha(text)


def test_rows_are_those_of_a_plain_version(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted((tuple(r) for r in fim.digest(docs).collect()), key=str)
    want = sorted((plain(i, t) for i, t, *_ in ROWS), key=str)
    assert got == want and {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fim.digest(docs.where("false")).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\x0b<PSM>é中😀 "), max_size=60), st.integers(1, 9))
def test_every_cut_of_every_block_size(text, block):
    raw, units = text.encode(), UNITS.findall(text)
    blocks = fim.Blocks(raw, block)
    assert blocks.units == len(units)
    for k in range(len(units) + 1):
        head = "".join(units[:k])
        assert blocks.cut(k) == (len(head.encode()), len(head))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 1000])
def test_descent_finds_each_unit(n):
    import numpy as np

    units = np.random.default_rng(n).integers(0, 4, n)
    tree = fim.Fenwick(units, units * 3)
    for k in range(1, tree.total + 1):
        block, before, points = tree.descend(k)
        assert before < k <= before + units[block] and before == units[:block].sum() and points == 3 * before
