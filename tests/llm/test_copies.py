"""Near copies, suffix dedup, fingerprints and the pipeline, against plain versions."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from snapspan.llm import graph, lyndon, near, packing, rolling, simhash, suffix
from snapspan.llm.common import read_table


def word(rng):
    return "".join(rng.choice(["re", "ti", "on", "an", "er", "st", "é"]) for _ in range(rng.randint(1, 5)))


@pytest.fixture(scope="module")
def texts():
    """Prose with exact and near copies, shared passages, repeats inside, empty and null texts."""
    rng = random.Random(11)
    prose = [" ".join(word(rng) for _ in range(rng.choice([3, 8, 40, 90, 130, 300]))) for _ in range(60)]
    passage = " ".join(word(rng) for _ in range(60))
    out = list(prose)
    for k in range(40):
        words = prose[k % 20].split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = word(rng)
        out.append(" ".join(words))
    out += [f"{prose[30 + k][: 50 * k]} {passage} {prose[40 + k][:300]}" for k in range(8)]
    out += [prose[3], prose[3], prose[4].upper(), None, "", "", "   \n ", "one", "ONE", "ab " * 200, "x" * 450, "one two three four", "a b c"]
    return [(i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, id int, component int").repartition(5)


def sets(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_components(texts):
    found = {i: sets(t) for i, t in texts}
    up = {i: i for i in found}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(found, 2):
        x, y = found[a], found[b]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {i: (len(found[i]), top(i)) for i in found}


def test_shingles_equal_plain_sets(texts):
    import pyarrow as pa

    from snapspan.llm.common import utf8_views

    data, offsets = utf8_views(pa.array([t for _, t in texts], pa.string()))
    row, code = rolling.shingles(data, offsets)
    assert np.bincount(row, minlength=len(texts)).tolist() == [len(sets(t)) for _, t in texts]
    mine = {}
    for r, c in zip(row.tolist(), code.tolist()):
        mine.setdefault(r, set()).add(c)
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert len(mine.get(a, set()) & mine.get(b, set())) == len(sets(texts[a][1]) & sets(texts[b][1]))


def test_near_copies_equal_all_pairs(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_copies(docs).collect()}
    assert got == plain_components(texts)


def test_near_copies_edges(spark):
    base = "a b c d e f g h"
    rows = [(5, base), (5, base), (3, base + " "), (None, base), (None, "other words here"), (9, "different text of more than five words"), (9, base)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near.near_copies(frame).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (None, 3, False), (None, None, True), (9, 9, True), (9, 3, False)], key=str)
    assert near.near_copies(frame.limit(0)).count() == 0


def test_near_copies_through_a_hub(spark):
    """Copies that are each near the original but not each other are found through it, whatever its id."""
    rng = random.Random(8)
    original = [word(rng) + str(i) for i in range(400)]
    rows = []
    for k in range(60):
        words = list(original)
        for at in rng.sample(range(400), 5):
            words[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(words)))
    rows.append((1000, " ".join(original)))
    got = {r["doc_id"]: r["component_id"] for r in near.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in plain_components(rows).items()} and set(got.values()) == {0}


def test_hot_keys_are_compared_in_blocks(spark, monkeypatch):
    """Many variants of one text of which few are links: the same with one block and with many."""
    rng = random.Random(4)
    original = [word(rng) + str(i) for i in range(170)]
    rows = []
    for k in range(80):
        words = list(original)
        for at in rng.sample(range(170), rng.randint(2, 12)):
            words[at] = f"edit{k}x{at}"
        rows.append((k * 3, " ".join(words)))
    want = {i: c for i, (_, c) in plain_components(rows).items()}
    assert 1 < len(set(want.values())) < 80
    for block in (400, 7):
        monkeypatch.setattr(near, "BLOCK", block)
        assert {r["doc_id"]: r["component_id"] for r in near.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_near_copies_from_80_and_from_85(spark):
    """Short and long pairs planted at 0.80 to 0.85 are copies from 80 on and not from 85 on; those under 0.80 are never."""
    rng = random.Random(9)
    rows, want = [], []
    for k in range(40):
        size = rng.choice([45, 104, 110, 124, 125, 126, 130, 300, 900])
        words = [f"{word(rng)}{k}x{i}" for i in range(size + 4)]
        both = next(b for b in range(size) if 100 * b >= 80 * (2 * size - b)) - (k % 4 == 0)  # a new tail leaves so many
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: both + 4] + [f"new{k}x{i}" for i in range(size - both)]))]
        want += [2 * k] if k % 4 else [2 * k, 2 * k + 1]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near.one_of_each(frame, percent=80).collect()) == want
    assert near.near_copies(frame).filter("kept").count() == len(rows)
    assert (near.short_to(85), near.band_rows(85)) == (118, 5) and (near.short_to(80), near.band_rows(80)) == (125, 4)


def test_registers_estimate_likeness():
    rng = np.random.default_rng(1)
    both, left, right = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (8000, 1000, 1000))
    a, b = np.sort(np.concatenate((both, left))), np.sort(np.concatenate((both, right)))
    regs = near.registers(np.repeat([0, 1], [len(a), len(b)]), np.concatenate((a, b)), 2)
    assert abs(near.estimate(regs[0], regs[1:])[0][0] - 0.8) < 0.1 and near.estimate(regs[0], regs[:1])[0][0] == 1.0
    assert near.may_link(regs[0], regs[:1], len(a), np.array([len(a)]))[0]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    order = list(range(60))
    rng.shuffle(order)
    edges = list(zip(order, order[1:])) + [(100, 100 + k) for k in range(1, 30)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(60)}, **{100 + k: 100 for k in range(30)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_order_equals_sorting():
    rng = random.Random(1)
    for _ in range(3000):
        s = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 24))]
        assert lyndon.suffix_order(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def plain_removal(texts):
    where = {}
    coded = [(i, (t or "").encode()) for i, t in texts]
    for n, (_, b) in enumerate(coded):
        for s in range(len(b) - 199):
            where.setdefault(b[s : s + 200], []).append((n, s))
    gone = [np.zeros(len(b), bool) for _, b in coded]
    for places in where.values():
        if len(places) > 1:
            for n, s in places:
                gone[n][s : s + 200] = True
    out = {}
    for (i, b), g in zip(coded, gone):
        runs = int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum())
        out.setdefault(i, []).append((len(b), int(g.sum()), runs, hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()))
    return out


@pytest.mark.parametrize("wide", [256, 1])
def test_suffix_dedup_equals_all_windows(docs, texts, monkeypatch, wide):
    monkeypatch.setattr(suffix, "WIDE", wide)
    got = {}
    for r in suffix.report(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    assert got == plain_removal(texts) and sum(x[0][1] > 0 for x in got.values()) > 20


def test_no_gram_is_sorted_whole(spark, monkeypatch):
    """A passage with other surroundings in each of many texts: few contexts of a gram come to one sort, with equal results."""
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(700))
    rows = [(k, "".join(rng.choice("klmnopqrst ") for _ in range(250)) + passage + "".join(rng.choice("uvwxyz ") for _ in range(250))) for k in range(60)]
    sort = suffix._sort_contexts

    def watched(batches):
        seen = {}

        def watch():
            for batch in batches:
                keys = batch.select([c for c in ("gram", "part") if c in batch.schema.names])
                for key in zip(*(c.to_pylist() for c in keys.columns)):
                    seen[key] = seen.get(key, 0) + 1
                    assert seen[key] <= 16, "more than WIDE contexts in one group"
                yield batch

        yield from sort(watch())

    monkeypatch.setattr(suffix, "WIDE", 16)
    monkeypatch.setattr(suffix, "_sort_contexts", watched)
    got = {r["doc_id"]: [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])] for r in suffix.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_removal(rows) and all(x[0][1] >= 700 for x in got.values())


def test_suffix_dedup_edges(spark):
    rng = random.Random(2)
    a, b = ("".join(rng.choice("abcdefghij ") for _ in range(n)) for n in (260, 700))
    rows = [(1, a), (1, a), (2, "é" + b[:300]), (None, b[100:250] + "!" + b[50:260]), (3, None), (4, b[:199]), (5, "z" * 100_000), (6, a[:30] + b[300:500])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in suffix.report(frame).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    assert got == plain_removal(rows)
    assert suffix.report(frame.limit(0)).count() == 0
    left = {r["doc_id"]: r["text"] for r in suffix.remove_repeats(frame).collect()}
    assert left[1] == "" and left[3] is None and left[4] == b[:199] and left[5] == ""


def plain_fingerprint(spark, texts):
    """Votes counted one by one, with Spark's own term hashes."""
    terms = spark.createDataFrame([(i, t or "") for i, t in texts], "id long, text string").select("id", simhash.words("text").alias("w")).select("id", simhash.terms("w").alias("t")).collect()
    out = {}
    for r in terms:
        bits = 0
        for j in range(64):
            if sum(t["w"] * (1 if (t["h"] >> j) & 1 else -1) for t in r["t"]) > 0:
                bits |= 1 << j
        out[r["id"]] = bits
    return out


def test_fingerprints_equal_plain_votes(spark, docs, texts):
    got = {r["doc_id"]: r for r in simhash.report(docs).collect()}
    own = plain_fingerprint(spark, texts)
    edited = {}
    for (i, t), (_, after) in zip(texts[::-1], texts[::-1][1:] + texts[-1:]):
        t, after = t or "", after or ""
        edited[i] = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
    second = plain_fingerprint(spark, list(edited.items()))
    for k, (i, t) in enumerate(texts):
        r = got[i]
        assert r["n_chars"] == len(t or "") and r["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest()
        assert (int(r["fingerprint"], 16), int(r["edited_fingerprint"], 16)) == (own[i], second[i])
        assert r["near_edited"] == 1 - (own[i] ^ second[i]).bit_count() / 64 and r["near_next"] == 1 - (own[i] ^ own[texts[k - 1][0]]).bit_count() / 64
        near_by = sum((own[i] ^ o).bit_count() <= 3 for j, o in own.items() if j != i)
        assert r["n_within"] == (near_by if i % 20 == 0 else None)


def test_fingerprint_edges(spark):
    frame = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "other"), (None, None)], "doc_id long, text string")
    rows = simhash.report(frame).collect()
    assert len(rows) == 4 and {r["fingerprint"] for r in rows if r["doc_id"] is None} == {"0" * 16}
    assert simhash.report(frame.limit(0)).count() == 0 and simhash.report(frame.limit(1)).count() == 1


def test_block_tables_find_all_in_the_radius(spark):
    rng = random.Random(6)
    values = [rng.getrandbits(64) for _ in range(30)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for v in values for _ in range(8)]
    signed = sorted({simhash._signed(v) for v in values})
    frame = spark.createDataFrame([(v, 1) for v in signed], "own long, rows long")
    got = {r["own"]: r["others"] for r in simhash.within(frame, frame).collect()}
    want = {a: sum(0 < ((a ^ b) & (2**64 - 1)).bit_count() <= 3 for b in signed) for a in signed}
    assert got == {a: n for a, n in want.items() if n}


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs, seen = read_table(spark, sf, "documents"), {}
    for name, stage in cp.STAGES:
        before = docs
        docs = stage(spark, docs, sf).cache()
        seen[name] = docs.count()
        if name != cp.STAGES[-1][0]:
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
        if name == "near_dedup":
            want = plain_components([(r["doc_id"], r["text"]) for r in before.collect()])
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
        if name == "suffix_dedup":
            want = plain_removal([(r["doc_id"], r["text"]) for r in before.collect()])
            assert all((len((r["text"] or "").encode()) == want[r["doc_id"]][0][0]) == (want[r["doc_id"]][0][1] == 0) for r in docs.collect())
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "suffix_dedup", "secrets", "packing"]
    assert 0 < seen["near_dedup"] < seen["quality"] < 200 and seen["packing"] >= seen["secrets"]
    empty = read_table(spark, sf, "documents").limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
    assert packing.CAPACITY == 2048
