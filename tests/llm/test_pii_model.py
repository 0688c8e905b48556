"""What the fitted model adds to the fixed rules: planted codes, spelled addresses, hosts and numbers, beside look-alikes."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapspan.llm import boosting, pii


def iban(rng, country="DE"):
    bank = "".join(rng.choice("0123456789") for _ in range(18))
    return f"{country}{98 - int(bank + '131400') % 97:02d}{bank}"


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(17)
    word = lambda: "".join(rng.choice(["ba", "lo", "mi", "ten", "ras"]) for _ in range(rng.randint(1, 3)))
    out = []
    for i in range(240):
        code = iban(rng)
        wrong = code[:2] + f"{(int(code[2:4]) + 7) % 97:02d}" + code[4:]
        kind, span, good = [
            ("account", code, True), ("account", wrong, False), ("address", f"{word()} (at) {word()}{word()} (dot) org", True), ("address", f"{word()} (at) {word()}", False),
            ("host", f"{rng.randint(1, 255)} (dot) 7 (dot) 0 (dot) 12", True), ("host", f"{rng.randint(300, 999)} (dot) 7 (dot) 0 (dot) 12", False),
            ("number", f"0{rng.randint(10, 99)} {rng.randint(1000000, 9999999)}", True), ("number", f"0{rng.randint(10, 99)} {rng.randint(1000000, 9999999)}", False)][i % 8]
        before = {"number": "phone " if good else "serial "}.get(kind, "")
        lead = f"{word()} {word()} {before}"
        out.append((i, f"{lead}{span} {word()} and mail {word()}@{word()}.com", kind, len(lead), len(lead) + len(span), good))
    return out


def test_fitted_model_finds_planted_and_leaves_look_alikes(spark, planted):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in planted], "doc_id long, text string")
    got = {r["doc_id"]: set(r["spans"].split(",")) for r in pii.report(docs).collect()}
    for kind in pii.ADDED:
        rows = [p for p in planted if p[2] == kind]
        hits = {g: sum(f"{k}:{a}:{b}" in got[i] for i, _, k, a, b, good in rows if good == g) for g in (True, False)}
        assert hits[True] >= 0.9 * len(rows) / 2 and hits[False] <= 0.05 * len(rows) / 2, (kind, hits)
    assert all(any(s.startswith("email:") for s in got[i]) for i, *_ in planted)


def test_the_corpus_need_not_hold_examples(spark, planted):
    """A model fitted on plain prose finds them as well."""
    prose = spark.createDataFrame([(i, f"Some {i} plain words of a text without any data in it, number {i}.") for i in range(300)], "doc_id long, text string")
    model = pii.fit(prose)
    for _, text, kind, a, b, good in planted:
        if kind != "number":
            assert ((kind, a, b) in pii.select(text, *model)) == good, text


def test_evidence():
    assert pii.checked("DE89370400440532013000") and pii.checked("GB82 WEST 1234 5698 7654 32") and not pii.checked("DE88370400440532013000")
    assert pii.put_back("a.b (at) c (dot) org") == "a.b@c.org" and pii.put_back("10 [.] 0 [dot] 1(dot)2") == "10.0.1.2"
    text = "phone 030 1234567, order 030 1234567"
    assert pii.evidence("number", text, 6, 17) and not pii.evidence("number", text, 25, 36)


def test_made_up_examples_are_the_same_each_time_and_labelled():
    a, b = ([(k, t[s:e], pii.evidence(k, t, s, e)) for k, t, s, e in pii.made_up("some words lent", 5)] for _ in range(2))
    assert a == b and {k for k, _, good in a if good} == set(pii.ADDED) == {k for k, _, good in a if not good}


def test_every_text_is_fitted_on_and_calibrates(spark, monkeypatch):
    """Of 2,400 texts all candidates and all examples count, and the cuts are the best over the held-out third of all of them."""
    texts = [f"note {i} of a text " + ("phone 030 %07d" % (i * 37 % 9999991) if i % 7 == 0 else "order 030 %07d" % (i * 41 % 9999991) if i % 7 == 1 else "") for i in range(2400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    seen, fit = [], boosting.fit_counts
    monkeypatch.setattr(boosting, "fit_counts", lambda rows, cuts: seen.append(rows.agg(F.sum("n")).first()[0]) or fit(rows, cuts, rounds=8))
    model, threshold = pii.fit(docs)
    judged = {True: [], False: []}
    for r in docs.select("text", (F.pmod(F.xxhash64("text"), F.lit(3)) == 0).alias("held")).collect():
        own = [(kind, r["text"], a, b) for kind, a, b in pii._free(r["text"], pii.base_spans(r["text"]))]
        judged[r["held"]] += own + list(pii.made_up(r["text"], zlib.crc32(r["text"].encode())))
    assert seen == [len(judged[False])] and len(judged[True]) > 8000
    score = model.margin(np.array([pii.features(*c) for c in judged[True]], float))
    right = np.array([pii.evidence(*c) for c in judged[True]])
    for kind in pii.ADDED:
        mine = np.array([c[0] == kind for c in judged[True]])
        s, y = score[mine], right[mine]
        f1 = {cut: 2 * y[s >= cut].sum() / ((s >= cut).sum() + y.sum()) for cut in [*np.unique(s), threshold[kind]] if (y[s >= cut].sum() + 1) / ((s >= cut).sum() + 1) >= 0.99}
        assert f1[threshold[kind]] == pytest.approx(max(f1.values()), abs=1e-3), kind


def test_trees_on_counted_rows_do_not_depend_on_their_order(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (900, 3)).astype(float)
    y = (x[:, 0] > 2) ^ (x[:, 1] < 1)
    cuts = [np.arange(5) + 0.5] * 3
    rows = [(b.tobytes(), 1, int(h)) for b, h in zip(boosting.binned(x, cuts), y)]
    one, other = (boosting.fit_counts(spark.createDataFrame([(bytearray(b), n, h) for b, n, h in r], "bins binary, n long, hits long").repartition(k), cuts, rounds=6) for r, k in ((rows, 1), (rows[::-1], 5)))
    assert (one.margin(x) == other.margin(x)).all() and ((one.margin(x) > 0) == y).mean() > 0.97
    assert boosting.fit(x, y.astype(float), rounds=6).trees[0][0][0] == one.trees[0][0][0]


def test_threshold_takes_whole_steps():
    cut = lambda *rows: pii._threshold(*np.array(rows).T.reshape(3, -1), 0.9)
    assert cut((2048, 5, 5), (1024, 10, 10), (-1024, 40, 1)) == 1 / 2 / pii.STEP
    assert cut((10, 5, 0)) == float("inf") and cut((-pii.END, 30, 30)) == float("-inf")
