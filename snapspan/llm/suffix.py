"""Suffix-array dedup: bytes covered by a string of 200 bytes that starts anywhere else are removed.

*Grouping.* Each window of 200 bytes is owned by one 32-byte gram in it (the least hash, the leftmost of equals), so equal windows
have equal grams at equal places. Windows in a row with one gram are a block. Gram hashes are counted over
all documents; blocks of grams that occur once end here, and blocks that are equal as a whole become one context with a count.

*Sorting.* The contexts of a gram are cut into cells of 20 bytes counted from the gram. The first whole cell of a window and the eight
after it lie in the window, so equal windows start in suffixes that share nine cells. Suffixes
of the cell strings are sorted by `lyndon.suffix_order`, a chunk of grams at a time; neighbours that share nine
cells form classes, and within a class the at most 20 windows of each suffix are compared by their own hash. A
gram with very many contexts is dealt out by suffix, keyed by a hash of the nine cells; equal pieces become one with a summed count.
Nine cells that still have very many pieces, as at the edges of a passage in very many texts, are not sorted in one place: their
windows are counted by hash in Spark, which sums in part before the shuffle. So no more than ``WIDE`` contexts are held at once for a key.

*Removal.* Windows found become stretches by text (hash of text and length), are joined to every document of that text and cut out.

Null text is empty text; a document under 200 bytes loses nothing. Rows that repeat count as other occurrences of each
other, so their text goes whole. All is judged on the input. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from snapspan.llm import lyndon, rolling
from snapspan.llm.common import utf8_views, written
from snapspan.llm.rolling import U, Rolling

SIZE, GRAM, CELL = 200, 32, 20
#: Whole cells in each window; the window of most bytes before its first whole cell has 19 of them.
CELLS = (SIZE - CELL + 1) // CELL
SPAN = SIZE - GRAM + 1
POSITION = 28
#: A gram with more contexts is dealt out by suffix; nine cells with more pieces are counted by window.
WIDE = 256
#: Cells sorted at once, and bytes compared at once.
CHUNK = 60_000


def blocks(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gram hash, block hash, first window, number of windows and gram position of each block of one text."""
    if len(data) < SIZE:
        none = np.zeros(0, np.int64)
        return none.view(U), none.view(U), none, none, none
    own = Rolling(data)
    gram = own.every(GRAM)
    # the least hash, then the leftmost; the place fills the low bits
    low = (gram >> U(POSITION) << U(POSITION)) | (np.arange(len(gram), dtype=U) & U((1 << POSITION) - 1))
    size = 1
    while 2 * size <= SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < SPAN:
        low = np.minimum(low[: len(low) - (SPAN - size)], low[SPAN - size :])
    cut = np.flatnonzero(low[1:] != low[:-1]) + 1
    start, end = np.append(0, cut), np.append(cut, len(low))
    at = (low[start] & U((1 << POSITION) - 1)).astype(np.int64)
    at += (start - at) >> POSITION << POSITION  # texts of over 2**28 bytes
    at += (at < start) * (1 << POSITION)
    return gram[at], rolling.mix(own.of(start, end - 1 + SIZE) ^ (end - start).astype(U) ^ ((at - start).astype(U) << U(16))), start, end - start, at


BLOCK = "gram long, block long, text_id long, start int, many int, lead int"


def _texts(batch: pa.RecordBatch):
    """Row and bytes of each text long enough."""
    data, offsets = utf8_views(batch.column("text"))
    for i in np.flatnonzero(np.diff(offsets) >= SIZE):
        yield int(i), data[offsets[i] : offsets[i + 1]]


def _count_grams(batches):
    for batch in batches:
        grams = [blocks(x)[0] for _, x in _texts(batch)]
        gram, n = np.unique(np.concatenate(grams) if grams else np.zeros(0, U), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])


def _list_blocks(batches):
    for batch in batches:
        ids = batch.column("text_id").to_numpy()
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        size = 0

        def put():
            cols = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]
            types = [pa.int64()] * 3 + [pa.int32()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)).cast(t) for c, t in zip(cols, types)], names=["gram", "block", "text_id", "start", "many", "lead"])

        for i, x in _texts(batch):
            gram, block, start, many, at = blocks(x)
            for p, c in zip(parts, (gram, block, np.full(len(start), ids[i]), start, many, at - start)):
                p.append(c)
            size += len(start)
            if size > 200_000:
                yield put()
                parts, size = [[] for _ in range(6)], 0
        yield put()


CONTEXT = "gram long, part int, block long, lead int, shift int, many int, n long, bytes binary"


def _cut_contexts(batches):
    """The bytes of each wanted block; for wide grams those of each suffix in it."""
    for batch in batches:
        data, offsets = utf8_views(batch.column("text"))
        out: list[tuple] = []
        for i, wanted in enumerate(batch.column("wanted").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            for w in wanted:
                s, many, lead = w["start"], w["many"], w["lead"]
                if not w["wide"]:
                    out.append((w["gram"], 0, w["block"], lead, 0, many, w["n"], text[s : s + many - 1 + SIZE].tobytes()))
                    continue
                done = 0
                while done < many:
                    first = done + (lead - done) % CELL  # the first cell at or after this window
                    upto = min(first + 1, many)
                    cells = text[s + first : s + first + CELLS * CELL].tobytes()
                    part = 1 + int.from_bytes(hashlib.blake2b(cells, digest_size=3).digest(), "little")
                    out.append((w["gram"], part, w["block"], lead - done, done, upto - done, w["n"], text[s + done : s + upto - 1 + SIZE].tobytes()))
                    done = upto
                if len(out) > 20_000:
                    yield _context_batch(out)
                    out = []
        yield _context_batch(out)


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    cols = list(zip(*rows)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["gram", "part", "block", "lead", "shift", "many", "n", "bytes"])


def repeated_windows(contexts: list[tuple]) -> list[np.ndarray]:
    """For each context (lead, number of windows, count, bytes) which of its windows occur twice or more in all.

    The cells of all contexts are one string with an end of its own after each; its sorted suffixes are split into
    classes that share nine cells, and the windows that start in one class are compared.
    """
    sizes = np.array([len(c[3]) for c in contexts], np.int64)
    base = np.cumsum(sizes) - sizes
    own = Rolling(np.frombuffer(b"".join(c[3] for c in contexts), np.uint8))
    starts, owner = [], []
    for k, (lead, many, _, text) in enumerate(contexts):
        first = lead % CELL
        at = np.arange(first, len(text) - CELL + 1, CELL)
        starts += [base[k] + at, [-1 - k]]
        owner.append(np.full(len(at) + 1, k))
    starts, owner = np.concatenate(starts).astype(np.int64), np.concatenate(owner)
    symbols = np.empty(len(starts), np.int64)
    real = starts >= 0
    _, rank = np.unique(own.of(starts[real], starts[real] + CELL), return_inverse=True)
    symbols[real] = rank + len(contexts)
    symbols[~real] = np.arange(len(contexts))
    order = lyndon.suffix_order(symbols)

    # suffixes of nine cells and more, in order; a class ends where the nine cells change
    at, who = starts[order], owner[order]
    whole = (at >= 0) & (at + CELLS * CELL <= (base + sizes)[who])
    at, who = at[whole], who[whole]
    out = [np.full(c[1], c[2] > 1) for c in contexts]
    if not len(at):
        return out
    nine = own.of(at, at + CELLS * CELL)
    label = np.cumsum(np.append(0, nine[1:] != nine[:-1]))
    members = np.bincount(label)
    shared = members[label] > 1
    at, who, label = at[shared], who[shared], label[shared]
    # the windows whose first whole cell is this one
    back = np.arange(CELL)
    window = at[:, None] - back
    many = np.array([c[1] for c in contexts], np.int64)
    good = (window >= base[who][:, None]) & (window < (base + many)[who][:, None])
    window, who, label = window[good], np.repeat(who, good.sum(1)), np.repeat(label, good.sum(1))
    code = rolling.mix(own.of(window, window + SIZE) ^ label.astype(U) * U(0x9E3779B97F4A7C15))
    _, kind = np.unique(code, return_inverse=True)
    weight = np.bincount(kind, np.array([c[2] for c in contexts], float)[who])
    twice = weight[kind] > 1
    for k, w in zip(who[twice].tolist(), (window - base[who])[twice].tolist()):
        out[k][w] = True
    return out


def _sort_contexts(batches):
    """Runs of repeated windows of each context, a chunk of whole grams at a time."""
    held, cells = [], 0
    last = None

    def solve(rows):
        runs: list[tuple] = []
        for row, twice in zip(rows, repeated_windows([(r[3], r[5], r[6], r[7]) for r in rows]) if rows else []):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], twice.astype(np.int8), [0]))))
            runs += [(row[0], row[2], int(a) + row[4], int(b) + row[4]) for a, b in zip(edge[::2], edge[1::2])]
        cols = list(zip(*runs)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])], names=["gram", "block", "low", "high"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if cells > CHUNK and row[:2] != last:
                yield solve(held)
                held, cells = [], 0
            held.append(row)
            cells += len(row[7]) // CELL + 1
            last = row[:2]
    yield solve(held)


def _hash_windows(batches):
    """The hashes of the windows of each piece, in order."""
    for batch in batches:
        own, many = batch.column("bytes").to_pylist(), batch.column("many").to_numpy().astype(np.int64)
        base = np.cumsum([0, *map(len, own)])[:-1]
        start = np.repeat(base - np.cumsum(many) + many, many) + np.arange(many.sum())
        code = Rolling(np.frombuffer(b"".join(own), np.uint8)).of(start, start + SIZE)
        offsets = pa.array(np.append(0, np.cumsum(many)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("gram", "block", "n")), pa.ListArray.from_arrays(offsets, pa.array(code.view(np.int64)))], names=["gram", "block", "n", "codes"])


def _counted(pieces: DataFrame) -> DataFrame:
    """(gram, block, low, high) of the windows of ``pieces`` whose hash occurs twice or more in all."""
    each = pieces.mapInArrow(_hash_windows, "gram long, block long, n long, codes array<long>").select("gram", "block", "n", F.posexplode("codes").alias("low", "code"))
    twice = each.groupBy("gram", "code").agg(F.sum("n").alias("n")).filter("n > 1").select("gram", "code")
    return each.join(twice, ["gram", "code"], "left_semi").select("gram", "block", "low", (F.col("low") + 1).alias("high"))


def _sorted(contexts: DataFrame) -> DataFrame:
    """(gram, block, low, high) by sorting the contexts of each gram and part."""
    dealt = contexts.select("gram", "part", "block", "lead", "shift", "many", "n", "bytes").repartition("gram", "part").sortWithinPartitions("gram", "part", "block", "shift")
    return dealt.mapInArrow(_sort_contexts, "gram long, block long, low int, high int")


def _wide_runs(cut: DataFrame) -> DataFrame:
    """(gram, block, low, high) for the pieces of wide grams."""
    cut = written(cut.withColumn("piece", F.xxhash64("part", "lead", "many", "bytes")), "suffix-pieces")
    merged = cut.groupBy("gram", "part", "piece").agg(F.sum("n").alias("n"), F.min("lead").alias("lead"), F.min("many").alias("many"), F.min("bytes").alias("bytes"))
    merged = written(merged.withColumnRenamed("piece", "block").withColumn("shift", F.lit(0)), "suffix-merged")
    merged = merged.join(merged.groupBy("gram", "part").agg(F.count("*").alias("pieces")), ["gram", "part"])
    alone = merged.filter("pieces = 1 and n > 1").select("gram", "block", F.lit(0).alias("low"), F.col("many").alias("high"))
    runs = _sorted(merged.filter(f"pieces between 2 and {WIDE}")).unionAll(_counted(merged.filter(f"pieces > {WIDE}"))).unionAll(alone)
    runs = runs.withColumnRenamed("block", "piece")
    return cut.join(runs, ["gram", "piece"]).select("gram", "block", (F.col("shift") + F.col("low")).alias("low"), (F.col("shift") + F.col("high")).alias("high"))


def _cut(text: bytes, stretches) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal stretches."""
    out, at, n, until = [], 0, 0, -1
    for a, b in sorted((s["low"], s["high"]) for s in (() if stretches is None else stretches)):
        if a > until:
            out.append(text[at:a])
            n += 1
        until = max(until, b)
        at = until
    return b"".join(out) + text[at:], n


def repeated_stretches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text_id, stretches): for each text with repeated windows the byte stretches they cover, as array<struct<low, high>>."""
    texts = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.filter(F.octet_length("text") >= SIZE).withColumn("text_id", _text_id())
    grams = texts.select("text").mapInArrow(_count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram")
    found = written(texts.select("text_id", "text").mapInArrow(_list_blocks, BLOCK).join(grams, "gram"), "suffix-blocks")
    # equal blocks are one context; the sample is the smallest place, so that it is the same on a second run
    contexts = found.groupBy("gram", "block").agg(F.count("*").alias("n"), F.min(F.struct("text_id", "start", "many", "lead")).alias("at"))
    contexts = written(contexts.select("gram", "block", "n", "at.*"), "suffix-contexts")
    kinds = contexts.groupBy("gram").agg(F.count("*").alias("kinds"))
    contexts = contexts.join(kinds, "gram")
    alone = contexts.filter("kinds = 1 and n > 1").select("gram", "block", F.lit(0).alias("low"), F.col("many").alias("high"))
    # of a text's copies the one with the smallest id is read, so a text with very many copies is dealt by id
    firsts = texts.groupBy("text_id").agg(F.min("row_id").alias("row_id"))

    def cut(some: str) -> DataFrame:
        wanted = contexts.filter(some).groupBy("text_id").agg(
            F.collect_list(F.struct("gram", "block", "n", "start", "many", "lead", (F.col("kinds") > WIDE).alias("wide"))).alias("wanted")).join(firsts, "text_id")
        copy = F.row_number().over(Window.partitionBy("text_id", "row_id").orderBy("text_id"))
        return texts.join(wanted, ["text_id", "row_id"]).withColumn("copy", copy).filter("copy = 1").select("text", "wanted").mapInArrow(_cut_contexts, CONTEXT)

    runs = _merged(_sorted(cut(f"kinds between 2 and {WIDE}")).unionAll(_wide_runs(cut(f"kinds > {WIDE}"))).unionAll(alone))
    places = found.join(written(runs, "suffix-runs"), ["gram", "block"])
    cover = F.transform("runs", lambda r: F.struct((F.col("start") + r["low"]).alias("low"), (F.col("start") + r["high"] - 1 + SIZE).alias("high")))
    return places.select("text_id", cover.alias("cover")).groupBy("text_id").agg(F.flatten(F.collect_set("cover")).alias("stretches"))


def _merged(runs: DataFrame) -> DataFrame:
    """(gram, block, runs): the runs of a block, which has no more than ``SPAN`` windows, in order; those that touch are one."""
    def add(done, run):
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["low"].alias("low"), F.greatest(last["high"], run["high"]).alias("high"))
        return F.when((F.size(done) > 0) & (run["low"] <= last["high"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(run)))

    each = runs.groupBy("gram", "block").agg(F.array_sort(F.collect_list(F.struct(F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high")))).alias("runs"))
    return each.select("gram", "block", F.aggregate("runs", F.array().cast("array<struct<low:int,high:int>>"), add).alias("runs"))


def _text_id(text: str = "text"):
    return F.xxhash64(F.col(text), F.octet_length(text))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with ``text`` replaced by what is left.

    A character of which any byte goes, goes whole. ``n_chars`` follows where there is such a column. Null stays null.
    """
    stretches = written(repeated_stretches(docs, doc_id, text), "suffix-stretches").withColumnsRenamed({"text_id": "_text_id", "stretches": "_stretches"})

    @F.arrow_udf(StringType())
    def left(texts: pa.Array, spans: pa.Array) -> pa.Array:
        # where no stretch is cut the text is not looked at
        return pa.array([None if t is None or s is None else _cut(t.encode(), s)[0].decode("utf-8", "ignore") for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    out = docs.join(stretches, _text_id(text) == F.col("_text_id"), "left")
    out = out.withColumn(text, F.when(F.col("_stretches").isNull(), F.col(text)).otherwise(left(F.col(text), F.col("_stretches")))).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.coalesce(F.length(text), F.lit(0)).cast("long")) if "n_chars" in docs.columns else out


def _describe(batches):
    for batch in batches:
        data, offsets = utf8_views(batch.column("text"))
        rows = []
        for i, spans in enumerate(batch.column("stretches").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            kept, n = _cut(text, spans)
            rows.append((len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()]))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its bytes, those removed, the maximal stretches removed and a digest of what is left."""
    stretches = written(repeated_stretches(docs, doc_id, text), "suffix-stretches")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_id", _text_id())
    return rows.join(stretches, "text_id", "left").select("doc_id", "text", "stretches").mapInArrow(
        _describe, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
