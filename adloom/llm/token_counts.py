"""Token counts of a piece vocabulary with a whole-token shortcut.

No piece of the vocabulary crosses from another character to a space mark, and none holds
a line end beside other characters; both are checked when the vocabulary is loaded. So a
text falls apart at those places and the count is a sum over pre-tokens. Ahead of any
text, each vocabulary string is merged by itself: those that end as one token make the
table of whole tokens, which count 1 without merging. Only other pre-tokens are merged,
each once as long as the bounded memory of results has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import Memory

#: Results of merges that a task keeps, in each of two generations.
REMEMBERED = 250_000
#: Longer pre-tokens are merged again each time.
LONGEST_KEPT = 64
LIMIT = 4096

_SPACE = "▁"
_BYTE = regex.compile(r"<0x[0-9A-F]{2}>")
_PIECES = regex.compile(f"{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+|\n")


class PieceCounter:
    """Counts tokens as the model's library does, without begin and end."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = {i: sp.id_to_piece(i) for i in range(sp.vocab_size())}
        score = {
            p: sp.get_score(i) for i, p in names.items() if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))
        }
        # The best score merges first; pieces of equal score have equal rank.
        order = {s: i for i, s in enumerate(sorted({*score.values()}, reverse=True))}
        self.rank = {p: order[s] for p, s in score.items()}
        for p in self.rank:
            if _SPACE in p.lstrip(_SPACE) or ("\n" in p and p != "\n"):
                raise ValueError(f"piece {p!r} crosses a pre-token boundary")
        self.newline = self.merge("\n")
        self.whole = {p for p in self.rank if self.merge(p) == 1}
        self.known = Memory(self.word, REMEMBERED, LONGEST_KEPT)

    def merge(self, text: str) -> int:
        """Number of tokens after all merges: best piece first, leftmost among equals."""
        parts = list(text)
        parts = self._merge_long(parts) if len(parts) > LONGEST_KEPT else self._merge_short(parts)
        return sum([1 if p in self.rank else len(p.encode()) for p in parts if p])

    def _merge_short(self, parts: list[str]) -> list[str]:
        get, none = self.rank.get, len(self.rank)
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap, in time nearly in proportion to the length."""
        get, n = self.rank.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i] if parts[i] else n
            if j >= n or get(parts[i] + parts[j]) != r:  # one of the two has changed
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(parts[i] + parts[k])) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(parts[h] + parts[i])) is not None:
                heappush(heap, (r, h))
        return parts

    def piece(self, pre_token: str) -> int:
        return 1 if pre_token in self.whole else self.merge(pre_token)

    def word(self, word: str) -> int:
        """Tokens of a word as str.split leaves it; one that starts a line has the line end in front."""
        if word[0] == "\n":
            return self.newline + (self.piece(word[1:]) if len(word) > 1 else 0)
        return self.piece(_SPACE + word)

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(_SPACE, " ")
        words = text.replace("\n", " \n").split(" ")
        if "" in words:  # runs of spaces, or spaces at an end or before a line end
            return sum(map(self.piece, _PIECES.findall(_SPACE + text.replace(" ", _SPACE))))
        return sum(self.known.all(words))


@lru_cache(1)
def _counter(model: bytes) -> PieceCounter:
    return PieceCounter(model)


def count_tokens(documents: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every document, whole texts.

    A null text counts as empty: no bytes, no tokens. Repeated rows stay, extra columns are
    ignored, and the model file (under a megabyte) is read on the driver and broadcast.
    """
    with open(model_path, "rb") as f:
        model = documents.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(model.value)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    counted = documents.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
