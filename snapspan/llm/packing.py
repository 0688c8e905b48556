"""Best-fit packing: pieces of documents into sequences of fixed length, each into the tightest bin that is compatible.

A document longer than a sequence is cut into pieces; whole sequences are bins of their own. The rest are packed
longest first. Open bins stand in the order of what is left in them; the search starts at the least residual that
fits and goes on to the successor until a bin is compatible, else a new one is opened. A bin carries a bitmap of
duplicate clusters, and four of sources: a document never joins one of its own cluster, and a source has at most
four documents in a bin. Bitmaps have 256 bits by hash, so a clash of hashes may part two documents that could have met; never the reverse.

Bins are filled within shards of about ``shard`` pieces, dealt by a hash of the document, whose number grows with the table. So
a shard is bounded, also if one source or cluster has most rows, and shards are packed side by side. What a shard leaves open is under one
part in a hundred of its bins.

Null text is empty text; an empty document is one piece of length 0. Ties go to the lower doc_id. Rows that repeat are packed each. A null
source or cluster conflicts with nothing. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SHARD = 4096
PLANES = 4
BITS = 256
PIECE = "doc_id long, piece int, bin string, slot int, start long, length long, residual long"


class Bins:
    """Open bins by residual, with the bitmaps of what they hold."""

    def __init__(self, capacity: int, planes: int = PLANES):
        self.capacity, self.planes = capacity, planes
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.held: list[int] = []

    def put(self, length: int, source: int | None, cluster: int | None) -> tuple[int, int, int, int]:
        """Bin, slot, start and residual for a piece; ``source`` and ``cluster`` are bit numbers."""
        s, c = 0 if source is None else 1 << source, 0 if cluster is None else 1 << cluster
        for k in range(bisect.bisect_left(self.order, (length, -1)), len(self.order)):
            left, b = self.order[k]
            if not self.clusters[b] & c and not self.sources[b][-1] & s:
                del self.order[k]
                break
        else:
            b, left = len(self.held), self.capacity
            self.clusters.append(0)
            self.sources.append([0] * self.planes)
            self.held.append(0)
        self.clusters[b] |= c
        for p, plane in enumerate(self.sources[b]):  # the first plane without the source takes it
            if not plane & s:
                self.sources[b][p] |= s
                break
        self.held[b] += 1
        if left > length:
            bisect.insort(self.order, (left - length, b))
        return b, self.held[b] - 1, self.capacity - left, left - length


def _pack(capacity: int):
    def run(batches):
        shard, bins, last_full = None, None, 0
        for batch in batches:
            out = []
            for doc_id, piece, length, source, cluster, home in zip(*(c.to_pylist() for c in batch.columns)):
                if home != shard:
                    shard, bins, last_full = home, Bins(capacity), 0
                if length == capacity:
                    out.append((doc_id, piece, f"{home}-f{last_full}", 0, 0, length, 0))
                    last_full += 1
                    continue
                b, slot, start, left = bins.put(length, source, cluster)
                out.append((doc_id, piece, f"{home}-{b}", slot, start, length, left))
            cols = list(zip(*out)) or [()] * 7
            types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[f.split()[0] for f in PIECE.split(", ")])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Items (doc_id, length, source, cluster) to pieces with their bin, slot, start in the bin and what was left after them."""
    whole = F.greatest(F.ceil(F.coalesce("length", F.lit(0)) / capacity), F.lit(1)).cast("int")
    bit = lambda c, seed: F.when(F.col(c).isNotNull(), F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(BITS)).cast("int"))
    pieces = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("length", F.lit(0)).alias("all"), bit("source", 1).alias("source"), bit("cluster", 2).alias("cluster"),
                          F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.col("all") - F.col("piece") * F.lit(capacity), F.lit(capacity)).cast("long").alias("length"), "source", "cluster")
    shards = max(1, -(-items.count() // shard))
    pieces = pieces.withColumn("home", F.pmod(F.xxhash64("doc_id", "length", "source", "cluster"), F.lit(shards)))
    return pieces.repartition("home").sortWithinPartitions("home", F.desc("length"), "doc_id", "piece").mapInArrow(_pack(capacity), PIECE)


def words(text: Column | str) -> Column:
    """The number of words, 0 for null."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def cluster(text: str = "text") -> Column:
    """Texts that are equal but for case and spaces are one duplicate cluster; empty ones are none."""
    flat = F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " "))
    return F.when(F.length(flat) > 0, F.xxhash64(flat))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY) -> DataFrame:
    """Where each piece of each document lies in the packed sequences, lengths in words."""
    return pack(docs.select(F.col(doc_id).alias("doc_id"), words(text).alias("length"), F.col(source).alias("source"), cluster(text).alias("cluster")), capacity)
