"""SimHash near-dedup: Golay-code fuzzy hashing of fingerprints, joined and verified.

The terms of a text are its four-word shingles, repeats included; each one's XXH64 votes on 64 bits, and a bit stands
where more than half of the votes set it. Two documents are linked if their fingerprints differ in at most four bits.

A fingerprint is cut into four segments of 16 bits, each read as the low end of a word of the binary Golay code [23, 12, 7]. The code is
perfect: every word has one codeword within three bits, and a word that lies exactly three away has five more at distance four.
So if two segments differ in one bit, the codeword nearest to the one is among the at most six within four bits of the other: one entry
meets at most six probes. Four errors are dealt to four segments in one of three ways, and each has its tables:

* two segments are whole: six tables keyed by two segments;
* one segment is whole and of any two others one has exactly one error: eight tables keyed by the whole segment, the codeword and the parity
  of the other, which one error turns over;
* each segment has exactly one error: one table keyed by the codewords of two segments and the parities of all four.

Equal fingerprints are one entry, so copies are never paired. First each member of a key is held against the first and the one before it
in order of value, which joins dense groups in linear work. Only keys whose members then lie in different components are searched for further
links, by an equi-join that gives out verified links only. (Within such a key the search is over pairs of different fingerprints.)

Null text is empty text. A text without words has fingerprint zero, which is linked like any other; one of fewer than four words
has the whole sequence as its one shingle. Repeated rows and ties get equal results, rows that share a doc_id are placed each by its own text. A null
doc_id never names a component unless all its ids are null; then the component is null. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from snapspan.llm import rolling
from snapspan.llm.common import slices, utf8_views, written
from snapspan.llm.graph import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fixed value: a generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0xAE3
SEGMENTS, BITS = 4, 16
ENTRY, PROBE = 1, 2
#: Shingles whose bits are counted at once.
VOTES = 100_000
#: Parts of a join back to documents, so that copies of one text are spread.
SALTS = 8


def remainder(words: np.ndarray) -> np.ndarray:
    """The syndrome of 23-bit words."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


@cache
def codewords() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each value of a segment: its parity, how many codewords lie within four bits, and their indices, the nearest first."""
    errors = np.array([sum(1 << b for b in c) for w in range(4) for c in combinations(range(23), w)])
    leader = np.zeros(2048, np.int64)
    leader[remainder(errors)] = errors
    every = np.arange(4096) << 11
    every |= remainder(every)
    light = every[np.bitwise_count(every) == 7]
    values = np.arange(1 << BITS)
    off = leader[remainder(values)]
    near = values ^ off
    lists = np.zeros((1 << BITS, 6), np.int64)
    lists[:, 0] = near >> 11
    count = np.where(np.bitwise_count(off) == 3, 6, 1)
    for error in np.unique(off[count == 6]):
        # the five codewords of weight seven over these three positions lead to the others at distance four
        over = light[(light & error) == error]
        at = np.flatnonzero(off == error)
        lists[at, 1:] = (near[at, None] ^ over) >> 11
    return (np.bitwise_count(values) & 1).astype(np.int64), count, lists[:, 0].copy(), lists


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each element of ragged lists with ``count`` elements."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def keys(prints: np.ndarray, probes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and role (entry, probe or both) of the keys of fingerprints; entries only unless ``probes``."""
    parity, count, nearest, lists = codewords()
    part = [(prints >> np.uint64(BITS * j)).astype(np.int64) & ((1 << BITS) - 1) for j in range(SEGMENTS)]
    here = np.arange(len(prints))
    out = []

    def add(table: int, row: np.ndarray, key: np.ndarray, role: int) -> None:
        out.append((row, key | np.int64(table << 58), np.full(len(row), role, np.int8)))

    table = 0
    for i, j in combinations(range(SEGMENTS), 2):
        add(table, here, part[i] << BITS | part[j], ENTRY | PROBE)
        table += 1
    for i in range(SEGMENTS):
        for j in ((i + 1) % SEGMENTS, (i + 2) % SEGMENTS):
            whole, other = part[i] << 13, parity[part[j]]
            add(table, here, whole | nearest[part[j]] << 1 | other, ENTRY)
            if probes:
                row, k = _spread(count[part[j]])
                add(table, row, whole[row] | lists[part[j][row], k] << 1 | (1 - other[row]), PROBE)
            table += 1
    odd = sum(parity[p] << j for j, p in enumerate(part))
    add(table, here, nearest[part[0]] << 16 | nearest[part[1]] << 4 | odd, ENTRY)
    if probes:
        row, k = _spread(count[part[0]])
        again, m = _spread(count[part[1][row]])
        row, k = row[again], k[again]
        add(table, row, lists[part[0][row], k] << 16 | lists[part[1][row], m] << 4 | (odd[row] ^ 15), PROBE)
    return tuple(np.concatenate(c) for c in zip(*out))


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of a buffer of UTF-8."""
    rows = len(offsets) - 1
    data = rolling.lower_ascii(data)
    start, end, row = rolling.words(data, offsets)
    ones, total = np.zeros((rows, 64), np.int64), np.zeros(rows, np.int64)
    if len(start):
        # words again, one space after each
        size = end - start + 1
        at = np.cumsum(size) - size
        joined = np.full(int(size.sum()), 32, np.uint8)
        joined[np.arange(len(joined)) - np.repeat(at, size) < np.repeat(size - 1, size)] = data[_inside(start, end)]
        joined = joined.tobytes()
        n = np.bincount(row, minlength=rows)
        last = np.cumsum(n)[row] - 1
        first = np.arange(len(row)) == (np.cumsum(n) - n)[row]
        keep = np.flatnonzero((np.arange(len(row)) + SHINGLE - 1 <= last) | first)
        stop = np.minimum(keep + SHINGLE - 1, last[keep])
        stop = at[stop] + size[stop] - 1
        hash_of = xxhash.xxh64_intdigest
        for a in range(0, len(keep), VOTES):
            k = keep[a : a + VOTES]
            h = np.array([hash_of(joined[b:e], SEED) for b, e in zip(at[k].tolist(), stop[a : a + VOTES].tolist())], np.uint64)
            owner = row[k]
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[owner[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
            total += np.bincount(owner, minlength=rows)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _inside(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The positions in words, in order."""
    row, k = _spread(end - start)
    return start[row] + k


def _print_column(batches):
    for batch in batches:
        data, offsets = utf8_views(batch.column("text"))
        for a, b in slices(offsets):
            made = fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(made.view(np.int64))], names=["doc_id", "print"])


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print) of each row."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_print_column, "doc_id long, print long")


def _key_rows(probes: bool):
    def make(batches):
        for batch in batches:
            prints = batch.column("print").to_numpy(zero_copy_only=False)
            for a in range(0, len(prints), 5000):
                some = prints[a : a + 5000]
                row, key, role = keys(some.view(np.uint64), probes)
                lead = batch.column("lead").to_numpy(zero_copy_only=False)[a : a + 5000]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[row]), pa.array(lead[row]), pa.array(role)], names=["key", "print", "lead", "role"])

    return make


def _keyed(prints: DataFrame, probes: bool) -> DataFrame:
    return prints.select("print", "lead").mapInArrow(_key_rows(probes), "key long, print long, lead long, role byte")


def apart(a: Column | str, b: Column | str) -> Column:
    """In how many bits two fingerprints differ."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def groups(prints: DataFrame) -> DataFrame:
    """(print, lead): a common value for all distinct fingerprints that links connect."""
    prints = prints.select("print", F.col("print").alias("lead"))
    inside = Window.partitionBy("key").orderBy("print")
    met = _keyed(prints, False).select("print", F.first("print").over(inside).alias("top"), F.lag("print").over(inside).alias("before"))
    near = lambda c: F.when((F.col(c) != F.col("print")) & (apart(c, "print") <= RADIUS), F.struct(F.col(c).alias("a"), F.col("print").alias("b")))
    edges = met.select(F.explode(F.filter(F.array(near("top"), near("before")), lambda e: e.isNotNull())).alias("e")).select("e.a", "e.b").distinct()
    led = _leads(prints, components(written(edges, "golay-near")))
    whole = Window.partitionBy("key")
    # keys whose members are all together have nothing to add
    open_ = _keyed(led, True).withColumns({"low": F.min("lead").over(whole), "high": F.max("lead").over(whole)}).filter("low <> high").drop("low", "high")
    open_ = written(open_, "golay-open")
    e = open_.filter(F.col("role").bitwiseAND(F.lit(ENTRY)) > 0).select("key", F.col("print").alias("p"), F.col("lead").alias("a"))
    q = open_.filter(F.col("role").bitwiseAND(F.lit(PROBE)) > 0).select(F.col("key").alias("k"), F.col("print").alias("q"), F.col("lead").alias("b"))
    far = e.join(q, (F.col("key") == F.col("k")) & (F.col("a") != F.col("b")) & (apart("p", "q") <= RADIUS)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = components(written(far.distinct(), "golay-far"))
    return led.join(roots, F.col("lead") == F.col("node"), "left").select("print", F.coalesce("component", "lead").alias("lead"))


def _leads(prints: DataFrame, found: DataFrame) -> DataFrame:
    return written(prints.join(found, F.col("print") == F.col("node"), "left").select("print", F.coalesce("component", "lead").alias("lead")), "golay-leads")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row."""
    rows = written(with_fingerprints(docs, doc_id, text), "golay-prints")
    classes = written(rows.groupBy("print").agg(F.min("doc_id").alias("low")), "golay-classes")
    led = written(groups(classes.select("print")), "golay-groups").withColumnRenamed("print", "p")
    placed = classes.join(led, F.col("print") == F.col("p")).select("print", "low", "lead")
    low = placed.groupBy("lead").agg(F.min("low").alias("component_id")).withColumnRenamed("lead", "l")
    placed = placed.join(low, F.col("lead") == F.col("l")).select(F.col("print").alias("p"), "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(placed, (F.col("print") == F.col("p")) & (F.col("salt") == F.col("s")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component_id").cast(LongType()).alias("component_id"))
