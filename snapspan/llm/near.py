"""Near copies: HyperMinHash registers are banded, candidates estimated, links confirmed on whole shingle sets.

A document is the set of its distinct five-word shingles. Two are linked from ``percent`` of 100 of their union on, 85 unless
given. One hash of each shingle picks one of 128
buckets and the smallest of a bucket is kept as a register: its leading zeros and ten bits
of mantissa. Bands of registers (five at 85, four at 80) are the keys under which documents of over 100 shingles meet. Documents
of up to 118 shingles (125 at 80) meet by prefix filtering instead, which is exact: of each set in the order of rarity as many shingles as
could be missing from a partner, and one. (A partner of a larger set has over 100, so each pair is seen by one of the two.)

Equal sets are one class, represented by its smallest doc_id, so copies are never paired. Under a key no pairs are
expanded at first: each member is confirmed against one leader, first the smallest id, then the member with most links
so far. Only members that are still in different components are compared with all others of their key, by the collision-corrected
estimate of 512 registers and then, where it allows a link, in full. A pair at the threshold shares no band with a chance
under one in a million (about 4e-7 at 85, 5e-8 at 80), for which the registers of a band are chosen.

Null text is empty text; a document without words has an empty set and is linked with nothing. Repeated rows
get equal results. Rows that share a doc_id but not a set are placed each by its own set; where both lead a class, what
one is linked with, the other is. A null doc_id never leads; such a row is alone unless its set has another id. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapspan.llm import rolling
from snapspan.llm.common import slices, utf8_views, written
from snapspan.llm.graph import components
from snapspan.llm.rolling import U

#: Bits of the bucket, for bands and for estimates; bits of mantissa.
BANDED, ESTIMATED, MANTISSA = 7, 9, 10
#: Shingles from which a set has bands.
LONG = 101
#: The threshold unless given, in hundredths.
PERCENT = 85
#: Chance that a pair at the threshold may share no band.
MISSED = 1e-6
#: Chance that two unequal minima of a bucket share leading zeros and mantissa.
COLLISION = 2.0**-MANTISSA / 3
#: The estimate may fall short of the threshold by so many standard errors, and by so much at least.
ERRORS, SLACK = 6, 0.02
#: Members of a key that are compared at once.
BLOCK = 400
SIGNATURE = "doc_id long, n long, d1 long, d2 long, bands array<long>, shingles array<long>, registers array<smallint>"


def registers(row: np.ndarray, code: np.ndarray, rows: int, bits: int = ESTIMATED) -> np.ndarray:
    """One line of 2**bits registers a row, 0 where a bucket is empty; ``code`` is sorted within each row."""
    out = np.zeros((rows, 1 << bits), np.uint16)
    if not len(row):
        return out
    bucket = (code >> U(64 - bits)).astype(np.int64)
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
    value = code[first] << U(bits)
    zeros = np.minimum(64 - np.frexp((value >> U(11)).astype(np.float64))[1] - 11, 60)
    mantissa = (value << np.minimum(zeros + 1, 63).astype(U)) >> U(64 - MANTISSA)
    out[row[first], bucket[first]] = 1 + (zeros.astype(np.int64) << MANTISSA) + mantissa.astype(np.int64)
    return out


def short_to(percent: int) -> int:
    """Shingles up to which a set has prefixes: a partner of any larger one has ``LONG`` at least."""
    return -(-100 * (LONG - 1) // percent)


def band_rows(percent: int) -> int:
    """The most registers a band may have so that a pair at the threshold shares none with a chance of at most ``MISSED``."""
    return max((r for r in range(2, 17) if (1 - (percent / 100) ** r) ** ((1 << BANDED) // r) <= MISSED), default=2)


def bands(regs: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and validity of each band of ``rows`` registers; one with under two filled registers says too little."""
    n = regs.shape[1] // rows
    part = regs[:, : n * rows].reshape(len(regs), n, rows).astype(U)
    key = np.zeros(part.shape[:2], U)
    for k in range(rows):
        key = rolling.mix(key ^ part[:, :, k] + U(k << 20))
    return rolling.mix(key + np.arange(n, dtype=U)), (part > 0).sum(2) >= 2


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard likeness of a line of registers with each of others, chance collisions taken out, and how many buckets either fills."""
    some = a != 0
    filled = np.maximum((some | (b != 0)).sum(-1), 1)
    share = ((a == b) & some).sum(-1) / filled
    return np.maximum(0.0, (share - COLLISION) / (1 - COLLISION)), filled


def may_link(a: np.ndarray, b: np.ndarray, n: int, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether the estimate allows the threshold. Buckets sample the union, so the error shrinks as they hold all of it."""
    likeness, filled = estimate(a, b)
    t = percent / 100
    part = np.minimum(filled / np.maximum((n + m) / (1 + t), 1), 1)
    error = np.sqrt(t * (1 - t) / filled * (1 - part))
    return likeness >= t - np.maximum(SLACK, ERRORS * error)


def _lists(row: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    offsets = np.zeros(rows + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=rows), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _signatures(percent: int):
    short_most, band = short_to(percent), band_rows(percent)

    def sign(batches):
        for batch in batches:
            data, offsets = utf8_views(batch.column("text"))
            for a, b in slices(offsets):
                rows = b - a
                row, code = rolling.shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.bincount(row, minlength=rows)
                total = np.zeros((2, rows), U)
                for k in range(2):
                    sums = np.concatenate((np.zeros(1, U), np.cumsum(rolling.mix(code + U(k * 77 + 1)))))
                    ends = np.cumsum(n)
                    total[k] = sums[ends] - sums[ends - n]
                regs = registers(row, code, rows)
                key, good = bands(registers(row, code, rows, BANDED), band)
                good &= (n >= LONG)[:, None]
                short = n[row] <= short_most
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, rows).cast(pa.int64()), pa.array(n), pa.array(total[0].view(np.int64)), pa.array(total[1].view(np.int64)),
                    _lists(np.nonzero(good)[0], key[good], rows), _lists(row[short], code[short], rows),
                    pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) << ESTIMATED), pa.array(regs.reshape(-1).view(np.int16)))],
                    names=["doc_id", "n", "d1", "d2", "bands", "shingles", "registers"])

    return sign


def _fits(n: str, m: str, percent: int) -> str:
    """Sizes that allow the threshold."""
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"


def _prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """(id, n, key) of short classes: in the order of rarity, as many shingles as a partner may lack, and one."""
    one = classes.filter(F.col("n").between(1, short_to(percent))).select("id", "n", F.explode("shingles").alias("key"))
    rarity = one.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = one.join(rarity, "key", "left").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "key")))
    return ranked.filter(f"r <= n - ceil({percent} * n / 100) + 1").filter("df is not null").select("id", "n", "key")


def _linked(own: np.ndarray, mine: np.ndarray, percent: int) -> bool:
    """Whether two sets, the first in order, reach the threshold."""
    if not len(own) or not len(mine):
        return False
    at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
    both = int((own[at] == mine).sum())
    return 100 * both >= percent * (len(own) + len(mine) - both)


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) the pairs whose whole sets reach the threshold.

    The texts that meet one leader are dealt over as many groups as they need; each group streams past the leader's set.
    """
    dealt = pairs.groupBy("a").agg(F.count("*").alias("size"))
    dealt = pairs.join(dealt, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / 64)).alias("part"))
    left = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("id")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    right = dealt.join(texts, F.col("b") == F.col("id")).select("a", "part", "b", "text")

    def stream(batches):
        leader, own = None, []
        for batch in batches:
            data, offsets = utf8_views(batch.column("text"))
            a, b, part = (batch.column(c).to_pylist() for c in ("a", "b", "part"))
            links = []
            for lo, hi in slices(offsets):
                row, code = rolling.shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                for i in range(lo, hi):
                    mine = code[cut[i - lo] : cut[i - lo + 1]]
                    if b[i] is None:
                        own = own if leader == (a[i], part[i]) else []
                        leader = (a[i], part[i])
                        own.append(np.sort(mine))
                    elif leader == (a[i], part[i]) and any(_linked(x, mine, percent) for x in own):
                        links.append((a[i], b[i]))
            yield _pairs(links)

    together = left.unionAll(right).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return together.mapInArrow(stream, "a long, b long")


def _likely(rest: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members of a key that are in different components and may reach the threshold.

    The members of a key are dealt into blocks of bounded size and each two blocks meet in a group of their own. A pair
    that shares several keys is told under the first of them only.
    """
    shared = rest.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    rest = rest.join(shared, "id")
    many = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rest.join(many, "key").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "n", "component", "registers", "keys")

    def compare(group: list[tuple], key: int) -> list[tuple]:
        own, ids, n, component = (np.array([r[k] for r in group]) for k in range(4))
        regs = np.stack([r[4] for r in group])
        out = []
        for i in range(len(group)):
            low, high = np.minimum(n, n[i]), np.maximum(n, n[i])
            ok = (ids > ids[i]) & (component != component[i]) & (100 * low >= percent * high)
            if group[0][5]:  # two blocks: only across
                ok &= own != own[i]
            j = np.flatnonzero(ok)
            if len(j):
                j = j[may_link(regs[i], regs[j], int(n[i]), n[j], percent)]
                own_keys = set(group[i][6])
                out += [(int(ids[i]), int(ids[x])) for x in j if next(k for k in group[x][6] if k in own_keys) == key]
        return out

    def stream(batches):
        at, group, pairs = None, [], []
        for batch in batches:
            regs = batch.column("registers").flatten().to_numpy().reshape(-1, 1 << ESTIMATED)
            key, low, high, own, ids, n, component, keys = (batch.column(c).to_pylist() for c in ("key", "low", "high", "own", "id", "n", "component", "keys"))
            for i in range(batch.num_rows):
                if (key[i], low[i], high[i]) != at:
                    pairs += compare(group, at[0]) if len(group) > 1 else []
                    at, group = (key[i], low[i], high[i]), []
                group.append((own[i], ids[i], n[i], component[i], regs[i], low[i] != high[i], keys[i]))
            yield _pairs(pairs)
            pairs = []
        yield _pairs(compare(group, at[0]) if len(group) > 1 else [])

    return dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(stream, "a long, b long")


def _pairs(pairs: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``; sets are linked from ``percent`` of 100 on."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(docs.mapInArrow(_signatures(percent), SIGNATURE), "near-signatures")
    leads = signed.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"))
    # one row a class: the representative's; rows that share its doc_id and set are equal
    classes = written(
        signed.filter("n > 0").join(leads.filter("id is not null").withColumnRenamed("d1", "e1").withColumnRenamed("d2", "e2"),
                                    (F.col("doc_id") == F.col("id")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
        .dropDuplicates(["id", "d1", "d2"]).select("id", "n", "bands", "shingles", "registers"), "near-classes")
    keys = classes.select("id", "n", F.explode("bands").alias("key")).unionAll(_prefixes(classes, percent))
    met = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    keys = written(keys.join(met, "key"), "near-keys")

    first = keys.groupBy("key").agg(F.min("id").alias("a"))
    stars = keys.join(first, "key").filter("id <> a").groupBy("id").agg(F.min("a").alias("a"))
    sizes = classes.select("id", "n")
    stars = written(_sized(stars.select("a", F.col("id").alias("b")), sizes, percent), "near-stars")
    texts = written(docs.join(keys.select("id").distinct(), F.col("doc_id") == F.col("id")).select("id", "text").dropDuplicates(["id", "text"]), "near-texts")
    links = written(_confirm(stars, texts, percent), "near-links")
    tried = stars

    # members that found no link yet meet the member of their key with most links
    open_keys = _still_open(keys, links)
    degree = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.count("*").alias("degree"))
    hubs = open_keys.join(degree, F.col("id") == F.col("a"), "left").groupBy("key").agg(
        F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), (-F.col("id")).alias("minus"), "component")).alias("hub"))
    more = (open_keys.join(hubs, "key").filter("component <> hub.component").groupBy("id")
            .agg(F.max("hub").alias("hub")).select((-F.col("hub.minus")).alias("a"), F.col("id").alias("b")))
    more = written(_sized(more, sizes, percent).join(tried, ["a", "b"], "left_anti"), "near-hubs")
    links = written(links.unionAll(_confirm(more, texts, percent)), "near-links")
    tried = tried.unionAll(more)

    # what is still apart under a key is compared by registers, and what these allow in full
    rest = _still_open(keys, links).join(classes.select("id", "registers"), "id")
    pairs = _likely(rest, percent).distinct()
    back = tried.unionAll(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = written(pairs.join(back, ["a", "b"], "left_anti"), "near-pairs")
    links = written(links.unionAll(_confirm(pairs, texts, percent)), "near-links")

    # classes that share a doc_id are one node, so ids carry the components
    found = components(links)
    named = signed.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2").join(leads, ["d1", "d2"], "left")
    named = named.join(found, F.col("id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "id", "doc_id")).alias("component_id"))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _sized(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the threshold."""
    n = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    return n.filter(_fits("na", "nb", percent)).select("a", "b").distinct()


def _still_open(keys: DataFrame, links: DataFrame) -> DataFrame:
    """Keys under which members of different components meet, with the components."""
    found = components(links)
    named = written(keys.join(found, F.col("id") == F.col("node"), "left").select("key", "id", "n", F.coalesce("component", "id").alias("component")), "near-named")
    apart = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    return named.join(apart, "key")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest doc_id of each group of near copies, columns as they are."""
    kept = near_copies(docs, percent=percent).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    # rows of equal doc_id stay together; a null doc_id is a row of its own and stays
    return docs.join(kept, docs["doc_id"].cast("long") == kept["_kept_id"], "left_semi").unionAll(docs.filter(docs["doc_id"].isNull()))
