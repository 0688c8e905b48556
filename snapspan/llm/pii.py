"""Personal data: wide generators propose overlapping spans, boosted trees score them, calibrated thresholds select.

``email``, ``ip``, ``card`` and ``phone`` follow fixed patterns and validity rules and always stay.
Beyond them wide generators propose what those cannot see: account codes, addresses spelled out ("x (at) y (dot) org"), hosts spelled out, and
numbers without a plus sign. No row of the tables labels personal data, so the trees learn from evidence: an account code is positive where its check
digits hold (modulo 97), a spelled address where it reads as an address once the words are put back, a host where its four parts are at most 255, a number
where a word for telephones stands right before it and it has 7 to 15 digits. Candidates without the evidence are negative, and those that overlap a base span take no part.
As a corpus may hold few of either, each text also lends its words as context for made-up examples of both labels, drawn by a generator seeded with the text.

The trees see format and context of a span, each feature in the bins of fixed cuts. They are grown, and the cuts of the kinds chosen, on every candidate of every text and on the examples made of every text:
texts are read once, their proposals are written, equal ones counted in Spark, and only sums by bin and by score reach the driver. Texts that repeat count as often as they stand; two thirds of the texts by hash are
fitted on, one third calibrates. Each kind has its own threshold: of the cuts whose smoothed precision on the held-out texts reaches ``precision``, the one with the best F1; a kind without one adds nothing.

Null text is empty text; empty text has no spans. Added spans never overlap base spans or each other: the better score
stays, then the earlier start. Rows that repeat get equal spans. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import random
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StructType

from snapspan.llm import boosting
from snapspan.llm.common import SPANS, span_text, written

#: The base kinds in the order of listing.
KINDS = ["email", "ip", "card", "phone"]
#: The base patterns; a run is entered at its start only, so each is linear.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wide generators of what the base patterns may miss.
WIDE = {
    "number": re.compile(r"\+?+\(?[0-9][0-9\x20()./-]{5,}+"),
    "address": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{2,63})*+"),
    "account": re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?\b"),
    "host": re.compile(r"(?<![0-9])[0-9]{1,3}(?:\x20?(?:\(dot\)|\[dot\]|\[\.\])\x20?[0-9]{1,3}){3}(?![0-9])"),
}
ADDED = list(WIDE)
#: Words that often stand before personal data, words for telephones, and words before other numbers.
HINTS = ["mail", "tel", "phone", "call", "fax", "card", "visa", "iban", "account", "ssn", "passport", "born", "ip", "host", "address", "contact"]
DIAL = ["tel", "phone", "call", "fax", "mobile", "cell"]
OTHER = ["order", "serial", "part", "ref", "item", "invoice", "total", "no", "id", "page", "version", "price"]
SPELLED = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
NEAR = 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def checked(code: str) -> bool:
    """Whether the check digits of an account code hold."""
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def put_back(span: str) -> str:
    """A spelled address or host with its marks put back."""
    span = re.sub(r"\x20?(?:\(at\)|\[at\])\x20?|\x20?@\x20?", "@", span)
    return re.sub(r"\x20?(?:\(dot\)|\[dot\]|\[\.\])\x20?|\x20\.", ".", span)


def _words_before(text: str, start: int) -> list[str]:
    return re.findall(r"[a-z]+", text[max(0, start - NEAR) : start].lower())


def evidence(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a candidate proves to be personal data."""
    span = text[start:end]
    if kind == "account":
        return checked(span)
    if kind == "address":
        return SPELLED.fullmatch(put_back(span)) is not None
    if kind == "host":
        return all(int(p) < 256 for p in put_back(span).split("."))
    words = _words_before(text, start)
    return 7 <= sum("0" <= c <= "9" for c in span) <= 15 and any(w.startswith(h) for w in words for h in DIAL) and not any(w in OTHER for w in words)


def made_up(text: str, seed: int):
    """(kind, text, start, end) of examples that borrow the words around them from ``text``: of each kind one with and one without the evidence."""
    rng = random.Random(seed)
    words = re.findall(r"[A-Za-z]{2,12}", text[:5000]) or ["so", "it", "was"]
    pick, digits = lambda: rng.choice(words), lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    country, bank = "".join(rng.choice("ABCDEFGHIKLMNPST") for _ in range(2)), "".join(rng.choice("0123456789ABCD") if rng.random() < 0.2 else rng.choice("0123456789") for _ in range(4 * rng.randint(3, 6)))
    check = 98 - int("".join(str(int(c, 36)) for c in f"{bank}{country}00")) % 97
    at, dot = rng.choice([(" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" @ ", " (dot) ")])
    name, host = pick().lower() + rng.choice(["", f".{pick().lower()}", digits(2)]), pick().lower() + rng.choice(["", pick().lower()])
    number = rng.choice([f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)} {digits(3)} {digits(3)}", f"({digits(3)}) {digits(7)}", digits(9)])
    for kind, before, span in (
        ("account", rng.choice(["IBAN ", "account ", "to ", ""]), f"{country}{check:02d}{bank}"), ("account", rng.choice(["part ", "code ", "IBAN ", ""]), f"{country}{(check + rng.randint(1, 50)) % 97:02d}{bank}"),
        ("address", rng.choice(["mail ", "write to ", ""]), f"{name}{at}{host}{dot}{rng.choice(['com', 'org', 'net', 'io'])}"), ("address", rng.choice(["mail ", "", ""]), f"{name}{at}{host}"),
        ("host", rng.choice(["host ", "at ", ""]), dot.join(str(rng.randint(1, 255)) for _ in range(4))), ("host", rng.choice(["host ", "version ", ""]), dot.join(str(p) for p in (rng.randint(1, 255), rng.randint(256, 999), 7, rng.randint(1, 300)))),
        ("number", f"{rng.choice(DIAL)}{rng.choice([': ', ' ', '. '])}", number), ("number", f"{rng.choice(OTHER)} ", number), ("number", f"{pick()} ", number),
        ("number", f"{rng.choice(DIAL)} ", digits(rng.choice([6, 18])))):
        lead = f"{pick()} {pick()} {before}"
        yield kind, f"{lead}{span} {pick()}", len(lead), len(lead) + len(span)


def emails(text: str):
    """Leftmost: from the first local character that is not taken yet to the last label of the domain."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            past = m.end()
            at = text.find("@", past)
        else:
            past = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed rules, kind by kind."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals of the wide generators, without trailing separators."""
    out = set()
    for kind, rx in WIDE.items():
        for m in rx.finditer(text):
            end = m.end()
            while end > m.start() and text[end - 1] in " ()./-":
                end -= 1
            if end > m.start():
                out.add((kind, m.start(), end))
    return sorted(out, key=lambda s: (s[1], s[2], s[0]))


def _side(c: str) -> float:
    return 0.0 if not c or c.isspace() else 1.0 if c.isalpha() else 2.0 if c.isdigit() else 3.0


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format of the span and what stands around it."""
    span, before = text[start:end], text[max(0, start - 32) : start].lower()
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    letters = sum(c.isalpha() for c in span)
    words, back = _words_before(text, start), put_back(span)
    parts = back.split(".")
    return [
        *[float(kind == k) for k in ADDED], len(span), len(digits), letters, sum(c.isupper() for c in span), span.count(" "), span.count("."), span.count("-"), span.count("("), span.count("@"), span.count("/"),
        float(span.startswith("+")), len(groups), max(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0, len(set(digits)), float(digits[:1] or -1),
        _side(text[start - 1 : start]), _side(text[end : end + 1]), float(any(h in before for h in HINTS)), float(before.rstrip().endswith((":", "=", "#"))),
        float(kind == "account" and checked(span)), float(SPELLED.fullmatch(back) is not None), float(kind == "host" and all(int(p) < 256 for p in parts)),
        float(any(w.startswith(h) for w in words for h in DIAL)), float(any(w in OTHER for w in words)),
    ]


#: The cuts of the features, in their order.
_FLAG, _COUNT, _SIDES = [0.5], [*(i + 0.5 for i in range(20)), 23.5, 27.5, 31.5, 39.5, 47.5, 63.5, 127.5], [0.5, 1.5, 2.5]
CUTS = [np.array(c) for c in [*[_FLAG] * len(ADDED), *[_COUNT] * 10, _FLAG, *[_COUNT] * 5, [i - 0.5 for i in range(10)], _SIDES, _SIDES, *[_FLAG] * 7]]
#: Scores count in steps of this part of one, and what lies beyond the ends in the last step.
STEP, END = 1024, 32 * 1024

_CANDIDATE = StructType().add("kind", IntegerType()).add("right", BooleanType()).add("bins", BinaryType())
#: What is found in a text without the model: base spans, free candidates and made-up examples.
PROPOSED = StructType().add("base", SPANS).add("own", ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("what", _CANDIDATE))).add("made", ArrayType(_CANDIDATE))


def _free(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The candidates that overlap no base span."""
    if not (more := candidates(text)):
        return more
    taken = _Taken()
    for a, b in sorted((a, b) for _, a, b in base):
        taken.add(a, b)
    return [c for c in more if taken.free(c[1], c[2])]


def _proposed(texts: pd.Series) -> pd.DataFrame:
    found, judged = [], []
    for text in texts:
        text = text or ""
        base = base_spans(text)
        own = _free(text, base)
        made = list(made_up(text, zlib.crc32(text.encode("utf-8", "surrogatepass"))))
        found.append((base, own, len(made)))
        judged += [(kind, text, a, b) for kind, a, b in own] + made
    bins = boosting.binned(np.array([features(*c) for c in judged], float).reshape(-1, len(CUTS)), CUTS)
    what = iter([{"kind": ADDED.index(c[0]), "right": evidence(*c), "bins": b.tobytes()} for c, b in zip(judged, bins)])
    rows = []
    for base, own, made in found:
        rows.append(([{"kind": k, "start": a, "end": b} for k, a, b in base], [{"start": a, "end": b, "what": next(what)} for _, a, b in own], [next(what) for _ in range(made)]))
    return pd.DataFrame(rows, columns=["base", "own", "made"])


def proposals(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, third, base, own, made), written once: the base spans, candidates and made-up examples of every text, and its third."""
    found = docs.select(*keep, F.pmod(F.xxhash64(F.col(text)), F.lit(3)).alias("third"), F.pandas_udf(_proposed, PROPOSED)(F.col(text)).alias("p"))
    return written(found.select(*keep, "third", "p.*"), "pii-proposals")


def fit(docs: DataFrame, text: str = "text", precision: float = 0.99) -> tuple[boosting.Boosted, dict[str, float]]:
    """Trees and a threshold a kind from all documents: two thirds to fit, one third to calibrate."""
    return fit_proposals(proposals(docs, text), precision)


def fit_proposals(found: DataFrame, precision: float = 0.99) -> tuple[boosting.Boosted, dict[str, float]]:
    """The fit on what ``proposals`` wrote."""
    each = found.select("third", F.posexplode(F.concat(F.transform("own", lambda c: c["what"]), "made")).alias("at", "c"))
    counted = lambda held: each.groupBy(held.alias("held"), "c.kind", "c.bins").agg(F.count(F.lit(1)).alias("n"), F.count_if("c.right").alias("hits"))
    rows = written(counted(F.col("third") == 0), "pii-counts")
    sides = {r["held"] for r in rows.select("held").distinct().collect()}
    if not sides:
        return boosting.Boosted(-9.0), {}
    if len(sides) == 1:  # a text or two: the examples of each go both ways
        rows = written(counted(F.col("at") % 3 == 0), "pii-counts")
    model = boosting.fit_counts(rows.filter("NOT held"), CUTS)

    def add(bins: np.ndarray, columns: dict, sums: dict) -> None:
        step = _steps(model.margin(boosting.values(bins, CUTS))) + END
        key, at = np.unique(columns["kind"] * (2 * END + 1) + step, return_inverse=True)
        n, hits = (np.bincount(at, columns[c]).astype(np.int64) for c in ("n", "hits"))
        for k, of in zip(key.tolist(), np.stack([n, hits], 1)):
            sums[k] = sums.get(k, 0) + of

    counts: dict[int, np.ndarray] = {}
    for r in boosting.summed(rows.filter("held").select("bins", "kind", "n", "hits"), CUTS, add).collect():
        counts[r["key"]] = counts.get(r["key"], 0) + np.frombuffer(r["sums"], np.int64)
    threshold = {}
    for k, kind in enumerate(ADDED):
        own = sorted((key % (2 * END + 1) - END for key in counts if key // (2 * END + 1) == k), reverse=True)
        n, hits = np.array([counts[k * (2 * END + 1) + s + END] for s in own], np.int64).reshape(-1, 2).T
        threshold[kind] = _threshold(np.array(own, int), n, hits, precision)
    return model, threshold


def _steps(margin: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(margin * STEP), -END, END).astype(np.int64)


def _threshold(step: np.ndarray, n: np.ndarray, right: np.ndarray, precision: float) -> float:
    """Of the cuts whose smoothed precision is high enough the one with the best F1, half way to the next lower score.

    ``step`` falls; ``right`` of the ``n`` held-out candidates of a step, of all texts, are personal data.
    """
    hits, of = np.cumsum(right), np.cumsum(n)
    good = np.flatnonzero(((hits + 1) / (of + 1.0) >= precision) & (hits > 0))
    if not len(good):
        return float("inf")
    best = int(good[np.argmax(2 * hits[good] / (of[good] + right.sum()))])
    if step[best] <= -END:
        return float("-inf")
    lower = step[best + 1] + 1 if best + 1 < len(step) else step[best]
    return float(step[best] + lower) / 2 / STEP


def select(text: str, model: boosting.Boosted, threshold: dict[str, float] | float) -> list[tuple[str, int, int]]:
    """Base spans and the candidates over the threshold (of their kind) that overlap none of them, by kind, then start."""
    base = base_spans(text)
    if not (more := _free(text, base)):
        return base
    return base + _chosen(more, model.margin(np.array([features(kind, text, a, b) for kind, a, b in more], float)), threshold)


def _chosen(more: list[tuple[str, int, int]], score: np.ndarray, threshold: dict[str, float] | float) -> list[tuple[str, int, int]]:
    """Of candidates the better one first, those over the threshold that overlap none before, by kind, then start."""
    need = [threshold.get(kind, float("inf")) if isinstance(threshold, dict) else threshold for kind, _, _ in more]
    taken, kept = _Taken(), []
    for value, (kind, a, b), least in sorted(zip(-score, more, need), key=lambda p: (p[0], p[1][1], p[1][2], p[1][0])):
        if -value >= least and taken.free(a, b):
            taken.add(a, b)
            kept.append((kind, a, b))
    return sorted(kept, key=lambda s: (ADDED.index(s[0]), s[1]))


class _Taken:
    """Stretches that are taken, sorted and apart from each other; what overlaps becomes one."""

    def __init__(self):
        self.starts, self.ends = [], []

    def free(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def add(self, a: int, b: int) -> None:
        i, j = bisect.bisect_right(self.ends, a), bisect.bisect_left(self.starts, b)
        if i < j:
            a, b = min(a, self.starts[i]), max(b, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [a], [b]


def pii_spans(docs: DataFrame, text: str = "text", model: tuple[boosting.Boosted, dict[str, float]] | None = None) -> Column:
    """Spans of personal data in ``text`` of ``docs``; the model is fitted on them unless it is given."""
    trees, threshold = model or fit(docs, text=text)

    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in select(x, trees, threshold)] if x else [] for x in texts], dtype=object)

    return F.pandas_udf(find, SPANS)(F.col(text))


def _added(model: boosting.Boosted, threshold: dict[str, float]) -> Column:
    """The spans that the model adds, from the candidates in ``own``."""

    def choose(own: pd.Series) -> pd.Series:
        judged = [c["what"]["bins"] for of in own for c in of]
        score = model.margin(boosting.values(np.frombuffer(b"".join(judged), np.uint8).reshape(-1, len(CUTS)), CUTS))
        out, at = [], 0
        for of in own:
            more = [(ADDED[c["what"]["kind"]], c["start"], c["end"]) for c in of]
            out.append([{"kind": k, "start": a, "end": b} for k, a, b in _chosen(more, score[at : at + len(more)], threshold)])
            at += len(more)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(choose, SPANS)(F.col("own"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the counts by kind, a digest of the base spans and all spans as text."""
    found = proposals(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep=("doc_id",))
    added = _added(*fit_proposals(found))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", "base", added.alias("added")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"))
