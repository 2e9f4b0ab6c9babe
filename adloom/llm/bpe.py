"""Byte-level BPE as a deterministic automaton.

Compiling applies one gadget per merge, in order of rank. The automaton starts with a
single state and an arc to it for each byte. The gadget of (u, v) -> w

- copies the state that u leads to, leaves the arc of v out of the copy, and lets u lead
  to the copy instead, so that v can no longer follow u;
- adds an arc w wherever u followed by v was possible, to the state that v leads to.

All arcs of one token lead to one state, so the token names the state. A state is a copy
of an older one less one arc, so it is kept as the reference it was copied from and the
time of the copy, never as a list of arcs: ``exits`` holds, for a token, the tokens whose
lost arcs its state shares and until when, ``entries`` the tokens through whose loss its
own arc would be missing. ``follows`` reads an arc from those, and arcs that were read
stay in a table until it is full. Every Python worker holds an automaton of its own, so
its pairs are kept in arrays: as objects, the same numbers take several times their room.

A pre-split word is encoded by following arcs whose labels spell it; just one path does.
Decoding joins the labels of the arcs.
"""

from __future__ import annotations

import json
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import Memory, held

#: Encoded words (in each of two generations) and arcs that a task remembers. A dict doubles beyond 174,762 keys.
REMEMBERED_WORDS = 170_000
REMEMBERED_ARCS = 170_000
LONGEST_KEPT = 64
_SLICE = 128  # rows that are encoded before they are passed on

# Fixed value: the pattern that splits text ahead of the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pairs:
    """For each token pairs of a token and a time, set once, end to end in two arrays."""

    def __init__(self, size: int):
        self.token, self.until = array("i"), array("i")
        self.start, self.end = array("i", [-1]) * size, array("i", [-1]) * size

    def __contains__(self, token: int) -> bool:
        return self.start[token] >= 0

    def __getitem__(self, token: int) -> Iterator[tuple[int, int]]:
        a, b = self.start[token], self.end[token]
        return zip(self.token[a:b], self.until[a:b])

    def __setitem__(self, token: int, pairs: Iterable[tuple[int, int]]) -> None:
        self.start[token] = len(self.token)
        for t, until in pairs:
            self.token.append(t)
            self.until.append(until)
        self.end[token] = len(self.token)


class Automaton:
    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        letters, model = byte_letters(), spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.label = [b""] * self.size
        for t, i in ids.items():
            self.label[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            self.label[i] = t.encode()
        forever = len(model["merges"])
        #: (u, v) as one number -> the time at which the gadget took arc v from u's state.
        self.lost: dict[int, int] = {}
        self.exits, self.entries = Pairs(self.size), Pairs(self.size)
        merged = [ids[c] for c in letters]
        for i in merged:
            self.exits[i] = self.entries[i] = ((i, forever),)
        self.arcs: dict[int, bool] = {}
        for time, (left, right) in enumerate(model["merges"]):
            u, v, w = ids[left], ids[right], ids[left + right]
            if u in self.exits and v in self.exits and w not in self.exits and self._arc(u, v):
                self.exits[w] = ((w, forever), *((t, min(time, until)) for t, until in self.exits[v]))
                # Where u repeats itself, the copy lacks u before w is added, so w is no arc of it.
                reach = time + (u == v)
                self.entries[w] = ((w, forever), *((t, min(reach, until)) for t, until in self.entries[u]))
                self.lost[u * self.size + v] = time
                merged.append(w)
        #: A trie of the labels: (node, byte) as one number -> node; and the token at a node.
        self.trie: dict[int, int] = {}
        self.ends = array("i", [-1])
        #: The longest token that begins each token, -1 where none does.
        self.shorter = array("i", [-1]) * self.size
        for i in sorted(merged, key=lambda t: len(self.label[t])):
            node, begins = 0, -1
            for byte in self.label[i]:
                begins = max(begins, self.ends[node], key=lambda t: len(self.label[t]) if t >= 0 else 0)
                if (next_ := self.trie.get(node << 8 | byte)) is None:
                    next_ = self.trie[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                node = next_
            self.ends[node], self.shorter[i] = i, begins
        self.split = regex.compile(PATTERN)
        self.mark = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known = Memory(self.word, REMEMBERED_WORDS, LONGEST_KEPT)

    def _arc(self, u: int, v: int) -> bool:
        """Whether the state that u leads to has an arc v."""
        lost, size, entries = self.lost, self.size, list(self.entries[v])
        for a, until in self.exits[u]:
            for b, too in entries:
                time = lost.get(a * size + b)
                if time is not None and time < until and time < too:
                    return False
        return True

    def follows(self, u: int, v: int) -> bool:
        key = u * self.size + v
        arc = self.arcs.get(key)
        if arc is None:
            if len(self.arcs) >= REMEMBERED_ARCS:
                self.arcs.clear()
            arc = self.arcs[key] = self._arc(u, v)
        return arc

    def longest(self, word: bytes, at: int) -> int:
        """The longest token that ``word`` has at a position."""
        step, ends, node, found = self.trie.get, self.ends, 0, -1
        for byte in word[at:] if at else word:
            if (node := step(node << 8 | byte)) is None:
                break
            if (token := ends[node]) >= 0:
                found = token
        return found

    def path(self, word: bytes) -> list[int]:
        """The tokens on the only path that reads ``word``.

        At each position the longest arc goes first. Every beginning of a word has one path
        only, so a position without a way on is dead however it is reached, and none is
        left more than once.
        """
        n, arcs, size, shorter = len(word), self.arcs, self.size, self.shorter
        label, out, at, dead = self.label, [], 0, set()
        token = self.longest(word, 0)
        while at < n:
            u = out[-1] if out else -1
            while token >= 0:
                arc = u < 0 or (arc if (arc := arcs.get(u * size + token)) is not None else self.follows(u, token))
                if arc and at + len(label[token]) not in dead:
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += len(label[token])
                token = self.longest(word, at)
            else:
                dead.add(at)
                at -= len(label[u])
                token = shorter[out.pop()]
        return out

    def word(self, word: str) -> bytes:
        """Ids of a word as little-endian 32-bit integers."""
        ids = self.path(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def plain(self, text: str) -> bytes:
        return b"".join(self.known.all(self.split.findall(text)))

    def encode(self, text: str) -> bytes:
        """All ids; strings of special tokens inside a text become those tokens."""
        if self.mark is None or not self.mark.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.mark.finditer(text):
            out += [self.plain(text[at : m.start()]), struct.pack("<I", self.special[m[0]])]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.label.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian 32-bit), ``decoded`` of every document.

    A null text counts as empty and gives no ids. Repeated rows stay, extra columns are
    ignored. The vocabulary file (under two megabytes) is read on the driver and broadcast.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(("bpe", vocabulary.value), lambda: Automaton(vocabulary.value))
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):  # results are as large as the texts
                part = batch.slice(at, _SLICE)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text).mapInArrow(run, f"doc_id {id_type}, ids binary, decoded string")


def digest(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of ``encode``."""
    return encode(documents, vocabulary_path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
