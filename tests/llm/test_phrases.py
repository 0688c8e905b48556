"""Collocations by prefix-free parsing, against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from snapspan.llm import phrases


def pieces(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [ws for ws in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)) if ws]


def grams(text):
    return Counter(tuple(ws[i : i + k]) for ws in pieces(text) for k in range(1, 6) for i in range(len(ws) - k + 1))


def plain(rows, least, most):
    counts, total = {}, Counter()
    for lang, text in rows:
        c = grams(text)
        counts.setdefault(lang or "und", Counter()).update(c)
        total[lang or "und"] += sum(n for g, n in c.items() if len(g) == 1)
    out = []
    for lang, f in counts.items():
        candidates = {g: n for g, n in f.items() if len(g) > 1 and n >= least}
        inside = lambda g, h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
        lines = []
        for g, a in candidates.items():
            if any(len(h) > len(g) and n >= a and inside(g, h) for h, n in candidates.items()):
                continue
            score, _, l, r = min((1000 * a * total[lang] // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            lines.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(lines)[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    base = ["the", "of", "état", "new", "york", "a-b", "x", "日本", "co", "\x00z", "plus"]
    sentence = lambda: " ".join(rng.choice(base[: rng.choice([3, 6, 11])]) for _ in range(rng.randint(1, 14))) + rng.choice([".", ", ", "\n", "; ", "!?", " \t", "\r\n"])
    out = []
    for lang in ("en", "fr", None):
        texts = ["".join(sentence() for _ in range(rng.randint(0, 12))) for _ in range(25)]
        out += [(lang, t) for t in texts] + [(lang, t.upper() + texts[0]) for t in texts[:10]] + [(lang, texts[3])] * 7
    out += [("en", None), ("en", ""), ("de", " ,.\n"), ("de", "one"), ("fr", "loop " * 3000), ("en", "New York, new york. NEW YORK"), ("fr", "\n".join(["new york city hall now open"] * 40))]
    return out


def test_chunks_own_each_word_once_and_hold_their_phrases(rows):
    texts = [t for _, t in rows]
    for every, longest in ((24, 512), (3, 7), (1, 2), (10**9, 5)):
        row, own, chunk = phrases.parse(*phrases.closed(pa.array(texts, pa.string())), every, longest)
        mine = [Counter() for _ in texts]
        for r, n, c in zip(row.tolist(), own.tolist(), chunk):
            at = 0
            for ws in pieces(c.decode()):
                for i in range(len(ws)):
                    if at < n:
                        mine[r].update(tuple(ws[i : i + k]) for k in range(1, 6) if i + k <= len(ws))
                    at += 1
        assert mine == [grams(t) for t in texts]


def test_equal_passages_share_chunks(spark):
    rng = random.Random(2)
    body = " ".join(f"w{rng.randrange(500)}" for _ in range(3000))
    frame = spark.createDataFrame([("en", f"start{i} {body} end{i}") for i in range(20)], "lang string, text string")
    found = phrases.dictionary(frame).agg({"own": "sum", "times": "max", "chunk": "count"}).first()
    assert found["max(times)"] == 20 and found["count(chunk)"] < 3000 / 10 and found["sum(own)"] < 2 * 3000


@pytest.mark.parametrize("least,most", [(5, 2000), (12, 6)])
def test_collocations_equal_plain_counting(spark, rows, least, most):
    frame = spark.createDataFrame([(i, lang, t, 3, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, n long, phrase string").repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(frame, least=least, most=most).collect())
    assert got == plain(rows, least, most)


def test_a_full_filter_changes_nothing(spark, rows):
    """A filter of 64 bits lets everything through; the counts by string decide."""
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(frame, least=5, most=50, bits=64).collect()) == plain(rows, 5, 50)


def test_filter_has_what_was_put_in(spark):
    hashes = np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 2000)
    known = phrases.Filter(phrases.filter_of(spark.createDataFrame([(int(h),) for h in hashes], "h long")).value)
    assert known.has(hashes.view(np.uint64)).all() and known.has(np.arange(100_000, dtype=np.uint64)).sum() < 10


def test_large_counts_stay_exact(spark):
    """Products over 64 bits: weights as of a corpus of 10**13 words."""
    big = 3 * 10**12 + 7
    chunks = spark.createDataFrame([("en", "a b c", 3, big), ("en", "a", 1, 10**12 + 1), ("en", "b c", 2, 5)], "lang string, chunk string, own long, times long")
    real, phrases.dictionary = phrases.dictionary, lambda docs: chunks
    try:
        got = [tuple(r) for r in phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect()]
    finally:
        phrases.dictionary = real
    n, a, l, r = 3 * big + 10**12 + 11, big, big + 10**12 + 1, big + 5
    scores = sorted((1000 * x * n // (p * q), k, p, q) for x, p, q, k in [(a, l, r, 1), (a, big, big + 5, 2)])
    assert [x[2] for x in got] == ["b c", "a b c"] and got[1] == ("en", 2, "a b c", a, scores[0][2], scores[0][3], n, scores[0][0])


def test_no_documents(spark):
    empty = phrases.collocations(spark.createDataFrame([], "lang string, text string"))
    assert empty.count() == 0 and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
