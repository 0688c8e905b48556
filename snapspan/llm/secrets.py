"""Secret scans: an Aho-Corasick pass finds keywords, anchored expressions run at the hits only.

Kinds: ``assign`` (keyword, separator, value of 12 or more), ``access`` (AKIA key of 18 or more),
``hex`` (run of 16 or more lower-case hex digits) and ``signed`` (tokens that carry a CRC-32 of
their own body in six base-62 digits, kept only where it is right). Hex runs have no keyword: a run
of 16 covers a multiple of 16, so each sixteenth character is the prefilter and a hit is widened.

Null text is empty text. Offsets are code points, the end exclusive. Spans of one kind never
overlap; those of different kinds may. A keyword without value, a value too short or a wrong checksum gives no span.
An input column with the name of an output column is replaced; other columns are untouched.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from snapspan.llm.common import SPANS, span_text

#: The kinds in the order of ties.
KINDS = ["assign", "access", "hex", "signed"]
#: Keywords and patterns.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
SIGNED_WORDS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
SIGNED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
HEX_FROM = re.compile(r"[0-9a-f]{16,}")
HEX_PROBE = re.compile(r"[0-9a-f]")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {i: i + 32 for i in range(65, 91)}


@cache
def automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for kind, keys in (("assign", ASSIGN_WORDS), ("access", ["akia"]), ("signed", SIGNED_WORDS)):
        for key in keys:
            words.add_word(key, (kind, len(key)))
    words.make_automaton()
    return words


def base62(value: int) -> str:
    """Six digits, zero-padded."""
    digits = ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        digits = BASE62[rest] + digits
    return digits


def checksum_holds(m: re.Match) -> bool:
    return base62(zlib.crc32(m[1].encode())) == m[2]


def hex_runs(text: str):
    """Maximal hex runs of 16 or more, each found at a sixteenth character."""
    done = 0
    for probe in HEX_PROBE.finditer(text[15::16]):
        at = 15 + 16 * probe.start()
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in "0123456789abcdef":
            start -= 1
            if at - start == 15:
                break
        if (m := HEX_FROM.match(text, start)) is not None:
            # a longer run was met at an earlier probe, so this start is its first character
            yield m.start(), m.end()
            done = m.end()


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of one text by start, then kind."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_LOWER)
    found, past = [], {"assign": 0, "access": 0, "signed": 0}
    for last, (kind, size) in automaton().iter(low):
        at = last - size + 1
        if at < past[kind]:
            continue
        m = (ASSIGN if kind == "assign" else ACCESS if kind == "access" else SIGNED).match(text, at)
        if m is None:
            continue
        past[kind] = m.end()
        if kind == "assign" and len(m[2]) < 12 or kind == "access" and len(m[0]) < 18:
            continue
        if kind == "signed" and not checksum_holds(m):
            continue
        found.append((at, KINDS.index(kind), m.end()))
    found += [(a, 2, b) for a, b in hex_runs(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


@F.pandas_udf(SPANS)
def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan(x)] for x in texts], dtype=object)


@F.pandas_udf(StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(redact)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each covered stretch replaced once; spans that overlap or touch are one stretch."""
    if not text:
        return text
    out, at, until = [], 0, -1
    for _, a, b in scan(text):
        if a > until:
            out += [text[at:a], mark]
        until = max(until, b)
        at = until
    return "".join(out) + text[at:] if out else text


def secret_spans(text: Column | str = "text") -> Column:
    """Spans of secrets as array<struct<kind, start, end>>."""
    return _spans(F.col(text) if isinstance(text, str) else text)


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, secrets in ``text`` replaced by a mark; null stays null."""
    return docs.withColumn(text, _redacted(F.col(text)))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the counts by kind, a digest of the base spans and all spans as text."""
    base = F.filter("found", lambda s: s["kind"] != "signed")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), secret_spans(text).alias("found")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"),
        count("signed").alias("n_signed"))


def redact_documents(docs: DataFrame) -> DataFrame:
    """`redact_secrets` over ``text``, with ``n_chars`` set anew where there is such a column; null text counts 0."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else clean
