"""Toxicity by weak supervision.

Twelve voters look at a text: lexicons, lists of words and word beginnings learned from
labelled rows, and patterns. A generative label model explains how often each combination
of votes occurs over all documents by a hidden class: each voter fires with one probability
in toxic and another in clean texts; a given label is wrong with a small fixed probability.
Expectation maximisation estimates these accuracies. Within a class, voters that fire
together more often than independent ones would are correlated; each voter's evidence is
divided by one plus its positive correlations, and the model is fitted again. The
posteriors of labelled documents are the labels on which a linear classifier is trained;
documents without a label shape the accuracies and train nothing else.

There are at most 3 * 2^12 combinations of votes and label, whatever the corpus, so their
counts are all that the driver needs. Terms are counted over all labelled rows, votes over
every document; only the classifier is fitted on a sample of about ``SAMPLE`` labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import held, uniform, unused
from adloom.operators.lookup import lookup_join
from adloom.workspace import materialize

#: Expected number of labelled rows in the sample.
SAMPLE = 20_000
#: Most terms that are learned, and the least log odds ratio, two standard errors down.
TERMS, LEAST_ODDS = 3000, 2.5
#: Most terms that a task counts before it hands its counts on.
COUNTED = 300_000
#: How often a given label is taken to be wrong. Held fixed, it ties the hidden class to the labels.
LABEL_ERROR = 0.01
#: Texts at or above this score are rejected.
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
LEARNED = 4  # voters that share the learned terms

# The lexicons. Each is one voter.
LEXICONS = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass fool foolish imbecile cretin dimwit "
    "halfwit brainless clueless retard retarded dolt dunce nitwit simpleton clown clowns",
    "loser losers worthless pathetic useless failure nobody coward cowards weakling parasite parasites "
    "leech scum scumbag lowlife wretch wretched pitiful laughable vermin",
    "disgusting filth filthy trash garbage gross vile revolting repulsive nasty sick sickening creep "
    "creepy pig pigs swine rat rats dirtbag sleazy rotten",
    "fuck fucking fucked fucker shit shitty bullshit bitch bitches bastard bastards asshole assholes "
    "arse damn crap piss cunt dick prick slut whore wanker twat",
    "hate hated kill die murder hang burn destroy exterminate threat beat stab shoot rape torture "
    "racist nazi terrorist subhuman savages animals",
    "dumm dummkopf blöd blödmann arschloch scheiße scheisse trottel depp versager abschaum wertlos "
    "ekelhaft hurensohn connard connasse salope merde putain abruti débile crétin imbécile ordure "
    "minable tonto estúpido estúpida imbécil mierda puta cabrón pendejo basura asqueroso inútil escoria",
)
# The patterns.
PATTERNS = (
    r"(?:[Yy]ou(?:'re| are)?|[Dd]u bist|[Tt]u es|[Vv]ous êtes|[Ee]res)\s+(?:all\s+)?(?:a|an|such|so|just|nothing|ein|eine|un|une|nada)\b",
    r"!!!|[A-ZÄÖÜÉÈÇÑ]{3,}\W+(?:[A-ZÄÖÜÉÈÇÑ]{3,}\W+){3}",
)
VOTERS = len(LEXICONS) + LEARNED + len(PATTERNS)

_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    """The distinct words of a text; and their beginnings, marked by a dash."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:n]}-" for w in words for n in PREFIXES if len(w) > n}


@dataclass
class Model:
    """Learned terms with their weights, weights of the voters, and the bias."""

    learned: dict[str, int]  # term -> the learned voter that it belongs to
    weights: dict[str, float] = field(default_factory=dict)
    votes: list[float] = field(default_factory=lambda: [0.0] * VOTERS)
    bias: float = 0.0

    def __post_init__(self):
        self.lexicon = {w: i for i, words in enumerate(LEXICONS) for w in words.split()}
        self.patterns = [re.compile(p) for p in PATTERNS]
        begins = [t[:-1] for t in self.learned if t.endswith("-")]
        self.begins = [(n, frozenset(b for b in begins if len(b) == n)) for n in sorted({*map(len, begins)})]
        self.words = frozenset(t for t in self.learned if not t.endswith("-"))

    def look(self, text: str) -> tuple[list[str], int]:
        """The learned terms in a text and the votes on it, one bit each."""
        words = set(_WORD.findall(text.lower()))
        hits = words & self.words
        for n, begins in self.begins:
            found = {w[:n] for w in words if len(w) > n} & begins
            hits.update(f"{b}-" for b in found)
        fired = {self.lexicon[w] for w in words & self.lexicon.keys()}
        fired |= {len(LEXICONS) + self.learned[t] for t in hits}
        fired |= {len(LEXICONS) + LEARNED + i for i, p in enumerate(self.patterns) if p.search(text)}
        return list(hits), sum(1 << i for i in fired)

    def score(self, text: str) -> float:
        hits, votes = self.look(text)
        total = self.bias + sum(self.weights.get(t, 0.0) for t in hits)
        total += sum(w for i, w in enumerate(self.votes) if votes >> i & 1)
        return float(1 / (1 + np.exp(-np.clip(total, -60, 60))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def label_model(votes: np.ndarray, label: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the toxic class for each combination, and the voters' correlations.

    ``votes`` is combinations x voters of 0 and 1; ``label`` is 1, 0, or -1 where none is
    given. A voter's evidence is its log odds, divided by one plus its correlations.
    """
    n_voters = votes.shape[1]
    discount, known = np.ones(n_voters), label >= 0
    # At first a text is toxic if its label says so, or without a label if two voters fire.
    start = np.where(known, 0.1 + 0.8 * label, np.where(votes.sum(1) >= 2, 0.8, 0.05))
    correlation = np.zeros((n_voters, n_voters))
    posterior = start
    for _ in range(3):
        posterior = start
        for _ in range(rounds):
            weight = np.stack([count * (1 - posterior), count * posterior])  # class x combination
            size = weight.sum(1)
            fires = (weight @ votes + 0.5) / (size + 1)[:, None]
            prior = (size + 1) / (size.sum() + 2)
            on, off = np.log(fires[1] / fires[0]), np.log((1 - fires[1]) / (1 - fires[0]))
            logit = np.log(prior[1] / prior[0]) + votes @ (on * discount) + (1 - votes) @ (off * discount)
            logit[known] += np.log(1 / LABEL_ERROR - 1) * (2 * label[known] - 1)
            posterior = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        pooled = np.zeros((n_voters, n_voters))
        for c, p in enumerate((1 - posterior, posterior)):
            w = count * p
            centred = votes - fires[c]
            pooled += (centred * w[:, None]).T @ centred
        spread = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
        correlation = pooled / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0)
        discount = 1 / (1 + np.maximum(correlation, 0).sum(1))
    return posterior, correlation


def _learned_terms(labelled: DataFrame) -> dict[str, int]:
    """Terms whose presence raises the odds of a toxic label, each given to one voter.

    ``labelled`` has ``text`` and ``toxic``, and all of it is counted: each task adds up its
    own terms, so a term is shuffled once for each time that a task's counts are full.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held("toxicity")
        seen, bad = Counter(), Counter()

        def full() -> pd.DataFrame:
            return pd.DataFrame([(t, bad[t], n) for t, n in seen.items()], columns=["term", "a", "n"])

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                own = terms(text) | {""}  # no term is empty: its counts are those of the rows
                seen.update(own)
                if toxic:
                    bad.update(own)
                if len(seen) >= COUNTED:
                    yield full()
                    seen.clear()
                    bad.clear()
        yield full()

    seen = labelled.select("text", "toxic").mapInPandas(count, "term string, a long, n long")
    seen = seen.groupBy("term").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    seen = materialize(seen.where("a >= 5 OR term = ''"), "terms")
    totals = seen.where("term = ''").first()
    if not totals or totals["a"] in (0, totals["n"]):
        return {}
    toxic, clean = totals["a"], totals["n"] - totals["a"]
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    odds = F.log(a / (toxic - F.col("a") + 0.5)) - F.log(b / (clean - F.col("n") + F.col("a") + 0.5))
    error = F.sqrt(1 / a + 1 / b + 1 / (toxic - F.col("a") + 0.5) + 1 / (clean - F.col("n") + F.col("a") + 0.5))
    strong = seen.where("a >= 5 AND term <> ''").withColumn("low", odds - 2 * error).where(F.col("low") >= LEAST_ODDS)
    # Terms with one beginning go to one voter: they say much the same.
    voter = F.pmod(F.xxhash64(F.substring("term", 1, min(PREFIXES))), F.lit(LEARNED)).cast("int")
    best = strong.orderBy(F.desc("low"), "term").limit(TERMS).select("term", voter.alias("voter")).collect()
    return {r["term"]: r["voter"] for r in best}


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from all documents and the labels that are not held out.

    A document with several labels is toxic if one of them says so. Without labels of both
    classes there are no learned terms, and the label model's own evidence is the score.
    """
    given = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    given = given.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    given = materialize(given, "given")
    labelled = given.count()
    rate = SAMPLE / max(labelled, 1)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    drawn = F.broadcast(given.where(uniform("doc_id") < rate))  # SAMPLE rows of two numbers
    sample = materialize(texts.join(drawn, "doc_id"), "sample")
    model = Model(_learned_terms(lookup_join(texts, given, "doc_id", "inner", right_rows=labelled)))

    @F.pandas_udf("hits array<string>, votes int")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held("toxicity")
        for batch in batches:
            yield pd.DataFrame([model.look(t) for t in batch], columns=["hits", "votes"])

    voted = texts.select("doc_id", look("text")["votes"].alias("votes"))
    voted = voted.join(given, "doc_id", "left").withColumn("label", F.coalesce("toxic", F.lit(-1)))
    rows = voted.groupBy("votes", "label").count().collect()  # at most 3 * 2^12 rows
    if not rows:
        return model
    votes = np.array([[r["votes"] >> i & 1 for i in range(VOTERS)] for r in rows], float)
    label, count = np.array([r["label"] for r in rows]), np.array([r["count"] for r in rows], float)
    posterior, correlation = label_model(votes, label, count)

    spark = documents.sparkSession
    table = [(r["votes"], r["label"], float(p)) for r, p in zip(rows, posterior)]
    table = F.broadcast(spark.createDataFrame(table, "votes int, toxic int, p double"))
    seen = sample.select("toxic", look("text").alias("l")).select("toxic", "l.hits", "l.votes").join(table, ["votes", "toxic"])
    bits = F.array(*[F.when(F.col("votes").bitwiseAND(F.lit(1 << i)) != 0, F.lit(f"#{i}")) for i in range(VOTERS)])
    seen = materialize(seen.select("p", F.concat("hits", F.array_compact(bits)).alias("names")), "posteriors")
    names = [*model.learned, *[f"#{i}" for i in range(VOTERS)]]
    vectors = CountVectorizerModel.from_vocabulary(names, inputCol="names", outputCol="features", binary=True).transform(seen)
    each = vectors.select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")),
    )).alias("e")).select("features", "e.label", "e.weight")
    if sample.isEmpty():
        weights, model.bias = _evidence(votes, posterior, count)
    else:
        fitted = LogisticRegression(weightCol="weight", regParam=2e-4, maxIter=60, standardization=False).fit(each)
        weights, model.bias = dict(zip(names, fitted.coefficients.toArray().tolist())), float(fitted.intercept)
    model.votes = [weights.get(f"#{i}", 0.0) for i in range(VOTERS)]
    model.weights = {t: weights.get(t, 0.0) for t in model.learned}
    return model


def _evidence(votes: np.ndarray, posterior: np.ndarray, count: np.ndarray) -> tuple[dict[str, float], float]:
    """The label model as a linear score."""
    weight = np.stack([count * (1 - posterior), count * posterior])
    size = weight.sum(1)
    fires = (weight @ votes + 0.5) / (size + 1)[:, None]
    off = np.log((1 - fires[1]) / (1 - fires[0]))
    on = np.log(fires[1] / fires[0]) - off
    bias = float(np.log((size[1] + 1) / (size[0] + 1)) + off.sum())
    return {f"#{i}": float(w) for i, w in enumerate(on)}, bias


def with_score(documents: DataFrame, model: Model, name: str) -> DataFrame:
    """``documents`` with the score of their whole text; a null text counts as empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held("toxicity")
        for batch in batches:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return documents.withColumn(name, run(F.coalesce("text", F.lit(""))))


def score(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document.

    Equal texts have equal scores; nothing but the text is an input. Null and empty texts
    have the score of a text without any vote. Repeated rows stay; extra columns are
    ignored; a null doc_id is not held out and has no label; no documents give no rows.
    """
    rows = with_score(documents.select("doc_id", "text"), fit(documents, labels), "score")
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def reject_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` without those that score at or above the threshold, all columns kept."""
    name = unused(documents, "_score")
    kept = with_score(documents, fit(documents, labels), name)
    return kept.where(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in documents.columns])
