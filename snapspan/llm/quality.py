"""Quality: heuristic labellers vote, expectation-maximisation weighs them, a hashed linear scorer learns the posterior.

Each labeller says good, bad or nothing about a text from simple statistics. How often each vote
pattern occurs is counted over all documents; expectation-maximisation over these counts (at most
3**10 patterns) estimates what each labeller says about good and about bad texts, and so the
posterior of each pattern. The posteriors of a sample of ``sample`` documents (a parameter, taken
in the order of a hash; the bound of what the driver sees) train a logistic scorer over hashed byte pairs and hashed buckets of repetition.
Every text is scored whole. The labels table is never read.

Null text is empty text. A text without words gets score 0 and posterior 0. Equal texts have equal scores.
Columns with the names of the results are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructType

from snapspan.llm import rolling
from snapspan.llm.common import sample_texts, slices, utf8_views

DIM = 1024
#: Symbols that prose seldom has.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#$%&*|!@^~<>{}[]=\\+_")] = True
STOPS = np.zeros(256, bool)
STOPS[list(b".,;:?!)\"'")] = True

#: name: (statistic, good range, bad below, bad above); in neither range the labeller says nothing.
LABELLERS = {
    "symbols": ("symbols", (0, 0.01), None, 0.04),
    "shouting": ("upper", (0, 0.12), None, 0.35),
    "separators": ("bare", (0, 0.02), None, 0.10),
    "echo": ("echo", (0, 0.08), None, 0.30),
    "stutter": ("echo", (0, 0.05), None, 0.50),
    "loops": ("loops", (0, 0.40), None, 0.60),
    "marked_words": ("marked", (0, 0.03), None, 0.15),
    "stops": ("stops", (0.01, 0.45), None, 0.60),
    "word_length": ("mean_word", (3.0, 9.5), 2.0, 14.0),
    "variety": ("variety", (0.25, 1.0), 0.10, None),
}
STATISTICS = ["symbols", "upper", "bare", "echo", "loops", "marked", "stops", "mean_word", "variety"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of statistics for each text, and its number of words."""
    rows = len(offsets) - 1
    start, end, row = rolling.words(data, offsets)
    count = np.bincount(row, minlength=rows).astype(float)
    some = np.maximum(count, 1)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    size = np.maximum(np.diff(offsets), 1)
    per_byte = lambda mask: np.bincount(owner[mask], minlength=rows) / size
    per_word = lambda mask: np.bincount(row[mask], minlength=rows) / some
    letters = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
    upper = (data >= 65) & (data <= 90)
    stat = {"symbols": per_byte(SYMBOLS[data]), "upper": np.bincount(owner[upper], minlength=rows) / np.maximum(np.bincount(owner[letters], minlength=rows), 1)}
    if len(start):
        code = rolling.Rolling(rolling.lower_ascii(data)).of(start, end)
        marks = SYMBOLS[data[end - 1]]
        stat["bare"] = per_word((end - start <= 2) & SYMBOLS[data[start]])
        stat["marked"] = per_word(marks)
        stat["stops"] = per_word(STOPS[data[end - 1]] & ~marks)
        same = np.zeros(len(row), bool)
        same[1:] = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
        stat["echo"] = per_word(same)
        stat["mean_word"] = np.bincount(row, end - start, rows) / some
        stat["variety"] = _distinct(code, row, rows) / np.minimum(some, 60 + some / 8)
        four = code.copy()
        whole = np.zeros(len(row), bool)
        if len(row) > 3:
            four[:-3] = rolling.mix(code[:-3] * rolling.U(3) + code[1:-2] * rolling.U(5) + code[2:-1] * rolling.U(7) + code[3:] * rolling.U(11))
            whole[:-3] = row[:-3] == row[3:]
        n = np.bincount(row[whole], minlength=rows)
        stat["loops"] = 1 - _distinct(four[whole], row[whole], rows) / np.maximum(n, 1)
        stat["loops"][n == 0] = 0
    zero = np.zeros(rows)
    return np.stack([stat.get(k, zero) for k in STATISTICS], 1), count


def _distinct(code: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    key = np.sort(rolling.row_key(row, code))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> rolling.U(44)).astype(np.int64), minlength=rows).astype(float)


def votes(stat: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One column a labeller: 1 good, 0 bad, 2 nothing; a text of under five words gets no vote."""
    out = np.full((len(stat), len(LABELLERS)), 2, np.int8)
    for k, (name, (low, high), below, above) in enumerate(LABELLERS.values()):
        x = stat[:, STATISTICS.index(name)]
        out[(x >= low) & (x <= high), k] = 1
        out[(x < (below if below is not None else -1)) | (x > (above if above is not None else np.inf)), k] = 0
    out[count < 5] = 2
    return out


def hashed(data: np.ndarray, offsets: np.ndarray, stat: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs, and one-hot hashed buckets of repetition."""
    rows = len(offsets) - 1
    out = np.zeros((rows, DIM), np.float32)
    if len(data) > 1:
        owner = np.repeat(np.arange(rows), np.diff(offsets))
        pair = (data[:-1].astype(np.uint32) * np.uint32(256) + data[1:]) * np.uint32(2654435761) >> np.uint32(22)
        inside = owner[:-1] == owner[1:]
        at = owner[:-1][inside] * DIM + pair[inside]
        out += np.bincount(at, minlength=rows * DIM).reshape(rows, DIM)
        out /= np.maximum(out.sum(1, keepdims=True), 1)
        out = np.sqrt(out)
    for k, name in ((3, "echo"), (4, "loops"), (8, "variety")):
        bucket = np.minimum((stat[:, k] * 20).astype(np.int64), 19)
        out[np.arange(rows), (bucket * 37 + k * 331) % DIM] += 1.0
    return out


@dataclass
class Scorer:
    weight: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.bias, -40, 40)))


def label_model(patterns: list[tuple[str, int]], rounds: int = 60) -> dict[str, float]:
    """The posterior of good for each vote pattern, by expectation-maximisation over pattern counts.

    It starts from "bad if any labeller says so"; a labeller's votes are independent given the class.
    """
    if not patterns:
        return {}
    vote = np.array([[int(c) for c in p] for p, _ in patterns])
    weight = np.array([n for _, n in patterns], float)
    post = np.where((vote == 0).any(1), 0.1, 0.9)
    for _ in range(rounds):
        good = (weight @ post + 1) / (weight.sum() + 2)
        logit = np.full(len(vote), np.log(good / (1 - good)))
        for k in range(vote.shape[1]):
            for v in (0, 1):
                said = vote[:, k] == v
                rate = [((weight * p)[said].sum() + 0.5) / ((weight * p)[vote[:, k] != 2].sum() + 1.0) for p in (post, 1 - post)]
                logit[said] += np.log(rate[0] / rate[1])
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return {p: float(x) for (p, _), x in zip(patterns, post)}


def train(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-4, step: float = 2.0) -> Scorer:
    """Logistic regression on soft labels by accelerated gradient steps."""
    w, b, mw, mb = np.zeros(DIM, np.float32), 0.0, np.zeros(DIM, np.float32), 0.0
    x, y = x.astype(np.float32), y.astype(np.float32)
    for _ in range(rounds if len(x) else 0):
        gap = (1 / (1 + np.exp(-np.clip(x @ (w + np.float32(0.9) * mw) + np.float32(b + 0.9 * mb), -40, 40))) - y).astype(np.float32)
        mw = (0.9 * mw - step * (x.T @ gap / len(x) + ridge * w)).astype(np.float32)
        mb = 0.9 * mb - step * float(gap.mean())
        w, b = w + mw, b + mb
    return Scorer(w, float(b))


def _blocks(texts: pa.Array):
    data, offsets = utf8_views(texts)
    for a, b in slices(offsets):
        yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _patterns(texts: pa.Array) -> pa.Array:
    out = []
    for data, offsets in _blocks(texts):
        out += ["".join(map(str, v)) for v in votes(*statistics(data, offsets)).tolist()]
    return pa.array(out, pa.string())


def _vectors(texts: pa.Array) -> pa.Array:
    out = []
    for data, offsets in _blocks(texts):
        out += [v.tobytes() for v in hashed(data, offsets, statistics(data, offsets)[0])]
    return pa.array(out, pa.binary())


def fit(docs: DataFrame, text: str = "text", sample: int = 4000) -> tuple[dict[str, float], Scorer]:
    """Labeller posteriors over all documents, and the scorer trained on a bounded sample."""
    pattern = F.arrow_udf(_patterns, StringType())(text)
    counts = docs.select(pattern.alias("pattern")).groupBy("pattern").count().collect()
    posterior = label_model(sorted((r["pattern"], r["count"]) for r in counts))
    rows = (sample_texts(docs, text, sample)
            .select(F.arrow_udf(_patterns, StringType())("text").alias("p"), F.arrow_udf(_vectors, BinaryType())("text").alias("x")).collect())
    rows = [r for r in rows if set(r["p"]) != {"2"}]
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(-1, DIM)
    return posterior, train(x, np.array([posterior[r["p"]] for r in rows]))


def quality(docs: DataFrame, text: str = "text", model=None) -> Column:
    """struct<posterior, score> of ``text``, fitted on ``docs`` unless a model is given; both lie in 0..1."""
    posterior, scorer = model or fit(docs, text)

    def rate(texts: pa.Array) -> pa.Array:
        out = [(np.zeros(0), np.zeros(0))]
        for data, offsets in _blocks(texts):
            stat, count = statistics(data, offsets)
            post = [posterior.get("".join(map(str, v)), 0.5) for v in votes(stat, count).tolist()]
            some = count > 0
            out.append((np.where(some, post, 0.0), np.where(some, scorer.score(hashed(data, offsets, stat)), 0.0)))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(c).astype(np.float64)) for c in zip(*out)], names=["posterior", "score"])

    return F.arrow_udf(rate, StructType().add("posterior", DoubleType()).add("score", DoubleType()))(F.col(text))


def good_documents(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores ``threshold`` or more, columns as they are."""
    kept = [F.col(f"d.`{c}`") for c in docs.columns]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), quality(docs, text).alias("q")).filter(F.col("q.score") >= threshold).select(*kept)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document the posterior of the labellers, the score of the linear scorer and the verdict."""
    return docs.select(F.col(doc_id).alias("doc_id"), quality(docs, text).alias("q")).select(
        "doc_id", F.col("q.posterior").alias("posterior"), F.col("q.score").alias("score"), (F.col("q.score") >= threshold).alias("kept"))
