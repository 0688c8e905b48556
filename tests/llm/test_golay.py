"""Golay-code fuzzy hashing of fingerprints, against plain versions."""

import random

import numpy as np
import pytest
import xxhash

from snapspan.llm import golay


def plain_print(text):
    """The contract, word by word."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(space, " ")
    words = [w for w in lowered.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_print(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                up[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[top(i)] = min(doc, low.get(top(i), doc))
    return sorted(((doc, f"{prints[i]:016x}", low.get(top(i))) for i, (doc, _) in enumerate(rows)), key=str)


def got(frame):
    return sorted((tuple(r) for r in golay.near_copies(frame).collect()), key=str)


def test_code_is_perfect():
    parity, count, nearest, lists = golay.codewords()
    every = np.arange(4096) << 11
    every |= golay.remainder(every)
    for v in [0, 1, 77, 4095, 65535, *random.Random(1).sample(range(65536), 300)]:
        away = np.bitwise_count(every ^ v)
        assert (away <= 3).sum() == 1 and away[nearest[v]] <= 3
        want = {int(nearest[v])} | (set(np.flatnonzero(away == 4).tolist()) if away[nearest[v]] == 3 else set())
        assert set(lists[v, : count[v]].tolist()) == want and parity[v] == v.bit_count() % 2


def test_every_pair_within_the_radius_shares_a_key():
    """Each of the ways to deal up to four errors to 64 bits, many times: an entry of the one meets a probe of the other, both ways."""
    rng = random.Random(5)
    a = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    flips = np.array([sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in a], np.uint64)
    one_each = np.array([sum(1 << (16 * j + rng.randrange(16)) for j in range(4)) for _ in a], np.uint64)
    for gap in (flips, one_each):
        for x, y in ((a, a ^ gap), (a ^ gap, a)):
            row, key, role = golay.keys(x, True)
            probes = set(zip(row[role & golay.PROBE > 0].tolist(), key[role & golay.PROBE > 0].tolist()))
            row, key, role = golay.keys(y, False)
            assert {r for r, k in zip(row.tolist(), key.tolist()) if (r, k) in probes} == set(range(len(a)))


def test_groups_equal_all_pairs(spark):
    """Clusters with drifting fingerprints, chains of them, and strangers."""
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):
            at ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            prints.add(at)
    core = rng.getrandbits(64)
    prints |= {core ^ sum(1 << b for b in rng.sample(range(20), rng.randint(1, 6))) for _ in range(300)}
    prints = sorted(prints)
    up = {p: p for p in prints}

    def top(p):
        while up[p] != p:
            p = up[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 4:
                up[top(p)] = top(q)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    frame = spark.createDataFrame([(signed(p),) for p in prints], "print long").repartition(3)
    lead = {r["print"]: r["lead"] for r in golay.groups(frame).collect()}
    mine, want = {}, {}
    for p in prints:
        mine.setdefault(lead[signed(p)], set()).add(p)
        want.setdefault(top(p), set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["re", "ti", "on", "an", "é", "ß", "st"]) for _ in range(rng.randint(1, 4)))
    out = []
    for _ in range(25):
        words = [word() for _ in range(rng.choice([2, 5, 60, 400]))]
        out.append(" ".join(words))
        for _ in range(3):
            again = list(words)
            again[rng.randrange(len(again))] = word()
            out.append(" ".join(again))
    out += [None, "", " \n\t ", "one", "ONE", "one two three", "One  two\tTHREE", out[0], out[0].upper(), "x" * 5000, "ab " * 300, " ".join(word() for _ in range(150_000))]
    return [(i * 3 % 101, t) for i, t in enumerate(out)]


def test_near_copies_equal_the_plain_version(spark, texts):
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in texts], "doc_id long, text string, print int, lead string, component_id int").repartition(4)
    assert got(frame) == plain_components(texts)


def test_edges(spark):
    rows = [(7, "a b c d e"), (7, "a b c d e"), (7, "other words of the same id"), (None, "a b c d e"), (None, "nobody else says this"), (2, None), (9, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(frame) == plain_components(rows)
    empty = golay.near_copies(frame.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fingerprint", "component_id"]
