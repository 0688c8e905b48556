"""The divergence audit against a plain version, with forced digest collisions."""

import random
import re
from collections import Counter

import pytest

from snapspan.llm import divergence


def plain(rows, least, most):
    rows = [tuple(x or "" for x in r) for r in rows]
    found = []
    for lang, source, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        found.append((lang, source, Counter(re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered))))
    out = []
    for lang in {r[0] for r in rows}:
        docs, counts = Counter(), {r[1]: Counter() for r in rows if r[0] == lang}
        for at, source, terms in found:
            if at == lang:
                docs.update(terms.keys())
                counts[source].update(terms)
        kept = [t for t, n in docs.items() if n >= least]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(sum(counts.values(), Counter()))
        p = {s: shares(c) for s, c in counts.items()}
        for s in counts:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            term = sorted((-(p[s][t] - q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:most]
            out += [(lang, s, part, item.decode(), -v, k) for part, lines in (("pair", pair), ("term", term)) for k, (v, item) in enumerate(lines, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["the", "The", "of", "été", "Été", "straße", "zz9yy", "a-b", "x" * 40, "日本", "not"] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(30)]
    out = []
    for lang in ("en", "fr", None):
        for k in range(90):
            mine = words[: 8 + 4 * (k % 5)]
            out.append((lang, rng.choice(["s1", "s2", "S2", None, "é"]), " ".join(rng.choice(mine) + rng.choice(["", ".", ",", "1"]) for _ in range(rng.randint(0, 40)))))
    out += [("en", "quiet", None), ("en", "quiet", ""), ("de", "alone", "few words"), ("es", "u", "1 2"), ("es", "v", None), ("en", "s1", "the " * 50), ("en", "s1", "the " * 50)]
    return out


def got(spark, rows, least, most, bits):
    frame = spark.createDataFrame([(i, *r, 7, "z") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, digest int, split string").repartition(3)
    return sorted(tuple(r) for r in divergence.audit(frame, least=least, most=most, bits=bits).collect())


@pytest.mark.parametrize("bits", [64, 3])
def test_audit_equals_the_plain_version(spark, rows, bits):
    """With digests of three bits nearly all terms share one; they are split by string."""
    assert got(spark, rows, 12, 5, bits) == plain(rows, 12, 5)


def test_ties_at_the_end_of_the_list(spark):
    rows = [("en", "a", "one two three four five"), ("en", "b", "six seven")] * 3
    assert got(spark, rows, 2, 2, 64) == plain(rows, 2, 2)


def test_slices_and_full_tables_change_nothing(spark, rows, monkeypatch):
    """Sums told early and texts of many slices add up to the same counts."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 7)
    monkeypatch.setattr(divergence, "PIECE", 60)
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] or "" for r in rows], "text": [r[2] or "" for r in rows]})
    got = Counter()
    for b in divergence._documents(64)([batch]):
        for lang, digest, n in zip(*(c.to_pylist() for c in b.columns)):
            got[lang, digest] += n
    want = Counter()
    for lang, _, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        want.update((lang or "", t) for t in set(re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)))
    names = pa.array([t.encode() for _, t in want], pa.binary())
    assert got == Counter(dict(zip(((k[0], int(d)) for k, d in zip(want, divergence._digests(names, 64).view(np.int64))), want.values())))


def test_a_task_holds_little_at_once():
    """Texts of 4 MB in one batch, each word a new one, are worked off in small slices."""
    import tracemalloc

    import pyarrow as pa

    texts = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}x{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}" for k in range(500)) for i in range(1000)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": texts})
    tracemalloc.start()
    told = sum(b.num_rows for b in divergence._documents(64)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told == 500_000 and peak < 80e6, (told, peak)


def test_no_documents(spark):
    empty = divergence.audit(spark.createDataFrame([], "doc_id long, lang string, source string, text string"))
    assert empty.count() == 0 and empty.columns == ["lang", "source", "part", "item", "value", "rank"]
