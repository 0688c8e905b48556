"""Phrase collocation mining by prefix-free parsing.

Texts are lowered (A-Z), split into pieces at ``.,;:!?`` and line breaks, and pieces into words at spaces and tabs. Everything is counted per language.

Parsing: a word is a trigger where the hash of the up to four words from it on (within its piece) falls into a residue class. Text is cut at triggers into
chunks; each chunk goes on for up to four words of its last piece after the next trigger, so every phrase of up to five words lies whole in the chunk in which
it begins. A chunk owns the words before the next trigger and only phrases that begin there are counted in it, so those of the overlap count once. A
text without triggers is cut every ``LONGEST`` words all the same, which is as exact. Equal texts give equal chunks: copies and shared passages become one entry of a dictionary with a frequency.

Counting goes over the dictionary, each phrase weighted by its chunk's frequency. First words and pairs are counted by a 64-bit hash, then longer phrases all of
whose pairs are frequent, then, by their words, all phrases whose hash was frequent; a hash may only let too much through, never too little, and final counts go by
string. What is frequent is passed on as a Bloom filter of a fixed size (``FILTER`` bits), so what is broadcast does not grow with the corpus; a filter that fills up costs
rows, not results.

Candidates are phrases of two to five words with at least 100 occurrences; see :func:`collocations` for their score. Null text is empty text, null lang is
``und``. Repeated rows count each, ties are broken by the phrase. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapspan.llm import rolling
from snapspan.llm.common import slices, utf8_views, written
from snapspan.llm.rolling import U

WORDS, OVERLAP = 5, 4
COMMON, LISTED = 100, 2000
#: One word in so many is a trigger; words after which a chunk ends without one.
EVERY, LONGEST = 24, 512
#: Bits of a filter, and bits a key sets.
FILTER, MARKS = 1 << 25, 3
#: Bytes of chunks that are counted at once.
PIECE = 4_000_000
SPACE, BREAK = 32, 10
#: A-Z lowered, tab a space, whatever ends a piece a line break.
TABLE = np.arange(256, dtype=np.uint8)
TABLE[65:91] += 32
TABLE[9] = SPACE
TABLE[list(b".,;:!?\n\x0b\x0c\r")] = BREAK
C = U(0x9DDFEA08EB382D69)


class Words:
    """The words of a buffer of texts: exact ids, hashes, and how many follow in the piece of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """``data`` holds lowered texts with spaces and line breaks as the only separators, each text closed by a line break."""
        inside = (data != SPACE) & (data != BREAK)
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        n = len(self.start)
        breaks = np.cumsum(data == BREAK, dtype=np.int64)
        piece = breaks[self.start] if n else np.zeros(0, np.int64)
        last = np.ones(n, bool)
        last[:-1] = piece[1:] != piece[:-1]
        self.last = last
        ends = np.flatnonzero(last)
        #: words of the piece from each word on, itself included
        self.left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1
        size = self.end - self.start
        at = np.zeros(n + 1, np.int64)
        np.cumsum(size, out=at[1:])
        letters = data[inside].tobytes()
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
        self.id = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.names = coded.dictionary
        bytes_of, place = utf8_views(coded.dictionary)
        self.code = rolling.Rolling(bytes_of).of(place[:-1], place[1:]) | U(1) if len(self.names) else np.zeros(0, U)


def closed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, a line break after each; and their starts."""
    data, offsets = utf8_views(texts)
    n = len(offsets) - 1
    out = np.full(len(data) + n, BREAK, np.uint8)
    shifted = offsets + np.arange(n + 1)
    mask = np.ones(len(out), bool)
    mask[shifted[1:] - 1] = False
    out[mask] = data
    return out, shifted


def _phrase_hash(codes: list[np.ndarray]) -> np.ndarray:
    return rolling.mix(reduce(lambda h, c: rolling.mix(h * C + c), codes, np.zeros(len(codes[0]), U)))


def parse(data: np.ndarray, offsets: np.ndarray, every: int = EVERY, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Row, number of owned words, and text of each chunk of a buffer of closed texts.

    Within a chunk one space or one line break follows each word but the last.
    """
    w = Words(TABLE[data], offsets)
    n = len(w.id)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    code = w.code[w.id]
    window = code.copy()
    for k in range(1, OVERLAP):
        there = np.zeros(n, U)
        there[: n - k] = code[k:]
        window = rolling.mix(window * C + np.where(w.left > k, there, U(0)))
    first = np.ones(n, bool)
    first[1:] = w.row[1:] != w.row[:-1]
    trigger = first | (window % U(every) == 0)
    # cuts where no trigger came for long, counted from the last one
    since = np.arange(n) - np.maximum.accumulate(np.where(trigger, np.arange(n), 0))
    cut = np.flatnonzero(trigger | (since % longest == 0))
    stop = np.append(cut[1:], n)
    # a chunk takes the words of its last piece that a phrase from its last own word may reach
    to = stop - 1 + np.minimum(w.left[stop - 1] - 1, OVERLAP)
    size = w.end - w.start + 1
    at = np.cumsum(size) - size
    text = np.empty(int(size.sum()), np.uint8)
    mark = at + size - 1
    letters = np.ones(len(text), bool)
    letters[mark] = False
    body = TABLE[data]
    text[letters] = body[(body != SPACE) & (body != BREAK)]
    text[mark] = np.where(w.last, BREAK, SPACE)
    text = text.tobytes()
    return w.row[cut], stop - cut, [text[a:b] for a, b in zip(at[cut].tolist(), mark[to].tolist())]


def _parsed(batches):
    for batch in batches:
        lang = batch.column("lang")
        for a, b in slices(utf8_views(batch.column("text"))[1], PIECE // 4, PIECE):
            row, own, chunk = parse(*closed(batch.column("text").slice(a, b - a)))
            made = pa.array(chunk, pa.binary())
            yield pa.RecordBatch.from_arrays([
                lang.slice(a, b - a).take(pa.array(row)), pa.StringArray.from_buffers(len(made), made.buffers()[1], made.buffers()[2]), pa.array(own)], names=["lang", "chunk", "own"])


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, chunk, own, times): the distinct chunks of (lang, text) and how often each was parsed."""
    made = docs.mapInArrow(_parsed, "lang string, chunk string, own long")
    return made.groupBy("lang", "chunk", "own").agg(F.count("*").alias("times"))


class Chunks:
    """Chunks of the dictionary, and their phrases."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = closed(batch.column("chunk"))
        self.w = w = Words(data, offsets)
        lang = batch.column("lang").dictionary_encode()
        self.langs = lang.dictionary
        self.lang = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[w.row]
        self.lang_code = np.array([hash_of(x) for x in self.langs.to_pylist()], U)
        own = batch.column("own").to_numpy(zero_copy_only=False)
        times = batch.column("times").to_numpy(zero_copy_only=False)
        begin = np.searchsorted(w.row, np.arange(batch.num_rows))
        self.owned = np.arange(len(w.id)) - begin[w.row] < own[w.row]
        self.times = times[w.row]
        #: per length: the phrase that begins at each word, as an exact number, -1 where there is none
        ids, _, self.one = self._numbered(self.lang * max(len(w.names), 1) + w.id, np.ones(len(w.id), bool))
        self.ids, self.kinds = {1: ids}, {1: len(self.one)}
        self.places = {1: self.one}

    def _numbered(self, key: np.ndarray, there: np.ndarray):
        at = np.flatnonzero(there)
        _, first, number = np.unique(key[at], return_index=True, return_inverse=True)
        ids = np.full(len(key), -1, np.int64)
        ids[at] = number
        return ids, at, at[first]

    def extend(self, k: int, allowed: np.ndarray | None = None) -> None:
        """Number phrases of ``k`` words by those of ``k - 1`` at the same and at the next word; ``allowed`` says which of the shorter may take part."""
        short = self.ids[k - 1]
        after = np.full(len(short), -1, np.int64)
        after[:-1] = short[1:]
        there = (self.w.left >= k) & (short >= 0) & (after >= 0)
        if allowed is not None:
            allowed = np.append(allowed, False)  # for -1
            there &= allowed[short] & allowed[after]
        self.ids[k], _, self.places[k] = self._numbered(short * max(self.kinds[k - 1], 1) + after, there)
        self.kinds[k] = len(self.places[k])

    def counts(self, k: int) -> np.ndarray:
        """Occurrences of each numbered phrase: where owned, by the frequency of the chunk."""
        ids = self.ids[k]
        at = np.flatnonzero((ids >= 0) & self.owned)
        out = np.zeros(self.kinds[k], np.int64)
        np.add.at(out, ids[at], self.times[at])
        return out

    def hashes(self, k: int) -> np.ndarray:
        at = self.places[k]
        return _phrase_hash([self.lang_code[self.lang[at]] + U(k)] + [self.w.code[self.w.id[at + j]] for j in range(k)]) if len(at) else np.zeros(0, U)

    def strings(self, k: int, some: np.ndarray) -> list[str]:
        at = self.places[k][some]
        columns = [self.w.names.take(pa.array(self.w.id[at + j])).to_pylist() for j in range(k)]
        return [b" ".join(p).decode("utf-8", "surrogatepass") for p in zip(*columns)]


def hash_of(lang: str) -> int:
    data = np.frombuffer(lang.encode(), np.uint8)
    return int(rolling.Rolling(data).of(np.array([0]), np.array([len(data)]))[0])


def _bit(hashes: np.ndarray, mark: int, bits: int) -> np.ndarray:
    return rolling.mix(hashes + U(mark)) % U(bits)


class Filter:
    """A Bloom filter over 64-bit hashes, as an array of words."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes may be in it."""
        out = np.ones(len(hashes), bool)
        for m in range(MARKS):
            bit = _bit(hashes, m, len(self.words) << 6)
            out &= (self.words[(bit >> U(6)).astype(np.int64)] >> (bit & U(63)) & U(1)).astype(bool)
        return out


def _bits(bits: int):
    """Word and mask of each bit that a hash sets."""
    def mark(batches):
        for batch in batches:
            hashes = batch.column("h").to_numpy(zero_copy_only=False).view(U)
            bit = np.concatenate([_bit(hashes, m, bits) for m in range(MARKS)])
            yield pa.RecordBatch.from_arrays([pa.array((bit >> U(6)).astype(np.int64)), pa.array((U(1) << (bit & U(63))).view(np.int64))], names=["word", "mask"])

    return mark


def filter_of(hashes: DataFrame, bits: int = FILTER):
    """The filter of a column ``h``, broadcast: a table of at most bits / 64 words whatever the number of hashes."""
    words = hashes.select("h").mapInArrow(_bits(bits), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits >> 6, U)
    table[words["word"].to_numpy()] = words["mask"].to_numpy().view(U)
    return hashes.sparkSession.sparkContext.broadcast(table)


def _in_parts(batch: pa.RecordBatch):
    for a, b in slices(utf8_views(batch.column("chunk"))[1], PIECE, PIECE):
        yield batch.slice(a, b - a)


def _tell(h: np.ndarray, n: np.ndarray, k: int) -> pa.RecordBatch:
    some = n > 0
    return pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(n[some]), pa.array(np.full(int(some.sum()), k, np.int8))], names=["h", "n", "k"])


def _short(batches):
    """Counts of words and pairs by hash."""
    for batch in batches:
        for part in _in_parts(batch):
            c = Chunks(part)
            c.extend(2)
            for k in (1, 2):
                yield _tell(c.hashes(k), c.counts(k), k)


def _long(pairs):
    """Counts of phrases of three to five words all of whose pairs may be frequent."""
    def count(batches):
        known = Filter(pairs.value)
        for batch in batches:
            for part in _in_parts(batch):
                c = Chunks(part)
                c.extend(2)
                allowed = known.has(c.hashes(2))
                for k in range(3, WORDS + 1):
                    c.extend(k, allowed if k == 3 else None)
                    yield _tell(c.hashes(k), c.counts(k), k)

    return count


def _named(common):
    """Counts of phrases whose hash may be frequent, by their words."""
    def count(batches):
        known = Filter(common.value)
        for batch in batches:
            for part in _in_parts(batch):
                c = Chunks(part)
                allowed = None
                for k in range(1, WORDS + 1):
                    if k > 1:
                        c.extend(k, allowed)
                    allowed = known.has(c.hashes(k))
                    n = c.counts(k)
                    some = np.flatnonzero(allowed & (n > 0))
                    yield pa.RecordBatch.from_arrays([
                        c.langs.take(pa.array(c.lang[c.places[k][some]])), pa.array(c.strings(k, some), pa.string()), pa.array(n[some]), pa.array(np.full(len(some), k, np.int8))],
                        names=["lang", "phrase", "n", "k"])

    return count


def phrase_counts(chunks: DataFrame, least: int = COMMON, bits: int = FILTER) -> DataFrame:
    """(lang, phrase, k, f) of all phrases of one to five words with at least ``least`` occurrences."""
    by_hash = "h long, n long, k byte"
    frequent = lambda df: written(df.groupBy("h", "k").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h", "k"), "phrases-hashes")
    cols = chunks.select("lang", "chunk", "own", "times")
    short = frequent(cols.mapInArrow(_short, by_hash))
    pairs = filter_of(short.filter("k = 2"), bits)
    long = frequent(cols.mapInArrow(_long(pairs), by_hash))
    common = filter_of(short.unionByName(long), bits)
    named = cols.mapInArrow(_named(common), "lang string, phrase string, n long, k byte")
    found = written(named.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), "phrases-counts")
    pairs.unpersist()
    common.unpersist()
    return found


def _part(words: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = COMMON, most: int = LISTED, bits: int = FILTER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    ``a`` is the count of a phrase, ``n`` that of all words; cut after its first words it has parts with counts ``l`` and ``r`` and the score floor(1000 a n / (l r)). The cut with
    the least score counts, the first of equals. A candidate is dropped if a longer candidate that contains its words has as many occurrences.
    """
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunks = written(dictionary(docs), "phrases-chunks")
    totals = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))
    counts = phrase_counts(chunks, least, bits)
    words = counts.filter("k > 1").withColumn("w", F.split("phrase", " "))
    # every shorter phrase inside a longer candidate, with the longer one's count
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k").cast("int") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k").cast("int") - m + 1), lambda i: _part(F.col("w"), i, m))))
    inner = words.filter("k > 2").select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    kept = words.join(inner, ["lang", "phrase"], "left").filter("within is null or within < f").select("lang", "phrase", "k", "w", F.col("f").alias("a"))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("k").cast("int") - 1), lambda c: F.struct(
        c.alias("cut"), _part(F.col("w"), 1, c).alias("left"), _part(F.col("w"), c + 1, F.size("w") - c).alias("right")))).alias("c")).select("lang", "phrase", "a", "c.*")
    side = lambda of, name: counts.select("lang", F.col("phrase").alias(of), F.col("f").alias(name))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", (whole("a") * F.lit(1000).cast("decimal(4,0)") * whole("n")).cast("decimal(38,0)"), (whole("l") * whole("r")).cast("decimal(38,0)"))
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return lowest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB.
SQL = r"""
WITH p AS (SELECT row_number() OVER () AS id, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang,
   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents) x),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
 tot AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
 f AS MATERIALIZED (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM w, unnest(range(1, 6)) a(k), unnest(range(1, len(ws) - k + 2)) b(i) GROUP BY ALL HAVING count(*) >= 100),
 c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
 ins AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS within FROM c, unnest(range(2, k)) s(m), unnest(range(1, k - m + 2)) b(i) GROUP BY ALL),
 kept AS (SELECT c.* FROM c LEFT JOIN ins ON ins.lang = c.lang AND ins.phrase = c.phrase WHERE within IS NULL OR 100 * within < 100 * a),
 cut AS (SELECT kept.lang, kept.phrase, a, cut, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM kept, unnest(range(1, k)) z(cut)
   JOIN f l ON l.lang = kept.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN f r ON r.lang = kept.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ') JOIN tot ON tot.lang = kept.lang),
 best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score FROM best
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
