"""Toxicity: a weighted finite-state grammar over clauses, with arcs learned from labelled rows.

Five transducers read the words of a clause. *Insult* and *threat* are tries of words and stems
(an arc with ``*`` accepts any ending) that emit weights; *target*, *negation* and *reported speech*
emit marks. Their composition (`Grammar.clause`) is one pass: a weight counts more beside a target and less
under negation or in reported speech. A document is described by its strongest clause, the sum and the number of
matched clauses; a logistic map, fitted on rows that the arcs were not learned from, gives the score.

Only rows with crc32(doc_id as text) mod 3 other than 1 are learned from, and of these at most ``toxic``
and ``clean`` documents in the order of a hash (parameters; the bound of the sample). Words and stems get the log
ratio of their shares in toxic and clean documents, if chance would hardly give it. Labels, language, source and
doc_id are no inputs of a score. Every text is scored whole; equal texts have equal scores.

Null text is empty text; a text without match gets the score of no match. Without labels, or with one
class only, the seed words alone are the arcs. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from snapspan.llm.common import written

#: Seed words of each transducer.
INSULTS = ["idiot", "moron", "stupid", "scum", "worthless", "pathetic", "loser", "disgusting", "trash", "clown", "dumb", "imbecile"]
THREATS = ["kill", "hurt", "destroy", "burn", "shoot", "stab"]
TARGETS = {"you", "your", "he", "she", "him", "her", "they", "them", "these", "those", "everyone", "du", "ihr", "dich", "tu", "vous", "usted", "ellos"}
NEGATIONS = {"not", "never", "no", "isn't", "aren't", "don't", "without", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "sin"}
REPORTS = {"said", "says", "wrote", "quoted", "reported", "called", "claimed", "sagte", "schrieb", "dit", "dijo"}
SEED_WEIGHT, THREAT_WEIGHT = 3.0, 2.0
STEMS = (4, 5, 6)
CLAUSE, WORD = re.compile(r"[.!?;:\n]+"), re.compile(r"[^\W_]+(?:'[^\W_]+)?")
#: What standing beside a target, under negation and in reported speech make of a weight.
BESIDE_TARGET, NEGATED, REPORTED = 1.25, 0.35, 0.5
REACH = 3
#: An arc may occur in so many clean documents for each toxic one.
SLIPS = 0.01
FEATURES = 4


def forms(words) -> set[str]:
    """The words and their stems, as arcs are written."""
    return {*words, *(f"{w[:k]}*" for w in words for k in STEMS if len(w) > k)}


@dataclass
class Grammar:
    """Arcs of the insult and threat transducers by word or stem, and the logistic map."""

    insult: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, SEED_WEIGHT))
    threat: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, THREAT_WEIGHT))
    weight: tuple[float, ...] = (-4.0, 5.0, 0.5, 0.5, 0.5)

    def __post_init__(self):
        arcs = {**self.threat, **self.insult}
        self.whole = {a for a in arcs if a[-1] != "*"}
        self.stems = {k: {a[:-1] for a in arcs if a[-1] == "*" and len(a) == k + 1} for k in STEMS}

    def emits(self, word: str, arcs: dict[str, float]) -> float:
        """The heaviest arc that accepts the word."""
        return max([arcs.get(word, 0.0), *(arcs.get(f"{word[:k]}*", 0.0) for k in STEMS if len(word) > k)])

    def meets(self, words: set[str]) -> bool:
        """Whether any word is accepted: most texts end here."""
        if not self.whole.isdisjoint(words):
            return True
        return any(s and not s.isdisjoint({w[:k] for w in words if len(w) > k}) for k, s in self.stems.items())

    def clause(self, words: list[str]) -> float:
        """The weight of the best path of the composed transducers through one clause."""
        total, negated, reported, target = 0.0, -REACH - 1, False, -REACH - 1
        pending = []  # weights that a target within reach may still raise
        for i, w in enumerate(words):
            if w in NEGATIONS:
                negated = i
            elif w in REPORTS:
                reported = True
            elif w in TARGETS:
                total += sum((BESIDE_TARGET - 1) * v for at, v in pending if i - at <= REACH)
                pending, target = [], i
            if (v := self.emits(w, self.insult)) or (v := self.emits(w, self.threat) * (target >= i - REACH)):
                v *= (NEGATED if i - negated <= REACH else 1.0) * (REPORTED if reported else 1.0)
                if i - target <= REACH:
                    v *= BESIDE_TARGET
                else:
                    pending.append((i, v))
                total += v
        return total

    def features(self, text: str) -> list[float]:
        """Any match, the strongest clause, the sum and the number of matched clauses, damped."""
        low = text.lower()
        if not self.meets(set(WORD.findall(low))):
            return [0.0] * FEATURES
        found = [v for c in CLAUSE.split(low) if (v := self.clause(WORD.findall(c))) > 0]
        if not found:
            return [0.0] * FEATURES
        best = min(max(found), 6.0)
        return [min(best / 2.0, 1.0), best / 6.0, math.log1p(sum(found)) / 4.0, math.log1p(len(found)) / 4.0]

    def score(self, text: str | None) -> float:
        z = self.weight[0] + sum(a * b for a, b in zip(self.weight[1:], self.features(text or "")))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column | str) -> Column:
    """The rows that are never learned from."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: int, clean: int) -> DataFrame:
    """(text, toxic, fold) of a bounded sample of learnable labelled documents, in the order of a hash."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"), F.xxhash64("doc_id").alias("h")))
    picked = known.filter("toxic = 1").orderBy("h", "doc_id").limit(toxic).unionAll(known.filter("toxic = 0").orderBy("h", "doc_id").limit(clean))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # at most toxic + clean rows of three numbers are broadcast
    return texts.join(F.broadcast(picked), "doc_id").select("text", "toxic", F.pmod(F.col("h"), F.lit(3)).cast("int").alias("fold"))


def learn_arcs(rows: DataFrame, most: int = 4000) -> dict[str, float]:
    """Words and stems with their log ratios; the surest ``most`` of them."""
    def count(batches):
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for t, y in zip(batch["text"], batch["toxic"]):
                seen[y].update(forms(set(WORD.findall(t.lower()))))
            keys = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"form": keys, "t": [seen[1][k] for k in keys], "c": [seen[0][k] for k in keys]})

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    T, C = sizes.get(1, 0), sizes.get(0, 0)
    if not T or not C:
        return {}
    share = T / (T + C)
    counts = rows.select("text", "toxic").mapInPandas(count, "form string, t long, c long").groupBy("form").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    n = F.col("t") + F.col("c")
    sure = F.col("t") * F.log(F.col("t") / (n * share)) + F.col("c") * F.log(F.greatest("c", F.lit(0.5)) / (n * (1 - share)))
    ratio = F.log((F.col("t") + 0.5) / (T + 1)) - F.log((F.col("c") + 0.5) / (C + 1))
    kept = (counts.filter(f"t >= 3 and c <= {SLIPS} * t").select("form", sure.alias("sure"), ratio.alias("ratio"))
            .filter((F.col("sure") >= math.log(20 * (T + C)) + 2) & (F.col("ratio") >= 3.0)).orderBy(F.desc("sure"), "form").limit(most).collect())
    return {r["form"]: min(r["ratio"], 6.0) for r in kept}


def calibrate(grammar: Grammar, rows: DataFrame, rounds: int = 50) -> tuple[float, ...]:
    """The logistic map from features of documents that the arcs were not learned from; counts of equal features only reach the driver."""
    @F.pandas_udf("array<double>")
    def describe(texts: pd.Series) -> pd.Series:
        return pd.Series([[round(v, 2) for v in grammar.features(t)] for t in texts], dtype=object)

    got = rows.select(describe("text").alias("x"), "toxic").groupBy("x", "toxic").count().collect()
    if len({r["toxic"] for r in got}) < 2:
        return Grammar().weight
    x = np.array([[1.0, *r["x"]] for r in got])
    y, n = np.array([r["toxic"] for r in got], float), np.array([r["count"] for r in got], float)
    n[y == 1] *= n[y == 0].sum() / n[y == 1].sum()  # both classes weigh alike
    n /= n.sum() / 200
    w, prior = np.array(Grammar().weight), np.array(Grammar().weight)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + 0.3 * (w - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w)), slope)
        w -= step * min(1.0, 1.0 / np.abs(step).max(initial=1e-9))
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: int = 3000, clean: int = 9000) -> Grammar:
    """Arcs from two folds of the sample, the logistic map from the third."""
    rows = written(training_rows(docs, labels, doc_id, text, toxic, clean), "toxicity-sample")
    arcs = Grammar().insult | learn_arcs(rows.filter("fold <> 0"))
    grammar = Grammar(arcs)
    return Grammar(arcs, weight=calibrate(grammar, rows.filter("fold = 0")))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", grammar: Grammar | None = None) -> Column:
    """The score of ``text``, with the grammar fitted on ``docs`` and ``labels`` unless it is given."""
    grammar = grammar or fit(docs, labels, doc_id, text)

    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series([grammar.score(t) for t in texts], dtype=float)

    return F.pandas_udf(rate, DoubleType())(F.col(text))


def report(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per document whether it is held out, the score and the prediction at ``threshold``."""
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), toxicity(docs, labels, doc_id, text).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
