"""Document fingerprints: SimHash, and search by permuted block tables. DataFrame functions only.

The terms of a text are its pairs of neighbouring words in lower case (and its last word), weighted by their letters.
Each term's hash votes on 64 signed bits with its weight; the fingerprint has the bits with a positive sum. Two votes are summed in
one long, the lower and the upper half of the hash each in 32 bits, so 32 sums make a fingerprint.

For the search a fingerprint is cut into six blocks. Two that differ in at most three bits agree in three whole blocks, so
twenty tables, each keyed by three blocks moved to the front, find every one; a pair counts in the first table it agrees in.
Fingerprints that are equal are one entry with a count. Queries are the documents whose id is divisible by 20.

The edited text of a document ends with the beginning of the next document's text (descending doc_id, then hash of the text; after the last comes the
first). Null text is empty; an empty text has no votes and fingerprint 0. Rows with equal id and text are one
document in that order, and each gets its result. A null id comes last. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapspan.llm.common import written

RADIUS = 3
#: Lengths of the six blocks of 64 bits; three stay whole within the radius.
BLOCKS = [11, 11, 11, 11, 10, 10]
LANES = 32
#: Stands for a null id in joins: the smallest of all, so it comes last.
NO_ID = -(1 << 63)
PAIR_OF_BITS = (1 << 32) | 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks() -> list[int]:
    """The bits that each permuted table is keyed by."""
    at, blocks = 0, []
    for n in BLOCKS:
        blocks.append(((1 << n) - 1) << at)
        at += n
    return [_signed(sum(c)) for c in combinations(blocks, len(BLOCKS) - RADIUS)]


def words(text: Column | str) -> Column:
    """The words of a text in lower case."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def terms(words: str) -> Column:
    """array<struct<h, w>>: hash and weight of each pair of neighbouring words of a column of words.

    The words are a column of their own, so that they are split once a row and not once a word.
    """
    after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(words, after, lambda x, y: F.struct(F.xxhash64(x, y).alias("h"), (F.length(x) + F.coalesce(F.length(y), F.lit(0))).cast("long").alias("w")))


def votes(h: str = "h", w: str = "w") -> list[Column]:
    """The 32 sums of two lanes each, and the sum of weights."""
    lanes = [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(PAIR_OF_BITS)) * F.col(w)).alias(f"v{j}") for j in range(LANES)]
    return [*lanes, F.sum(w).alias("weight")]


def fingerprint() -> Column:
    """The bits that more than half of the weight voted for."""
    bits = F.lit(0).cast("long")
    for j in range(LANES):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"v{j}", 32)
        bits = bits.bitwiseOR(F.when(2 * low > F.col("weight"), F.lit(1 << j)).otherwise(F.lit(0)).cast("long"))
        bits = bits.bitwiseOR(F.when(2 * high > F.col("weight"), F.lit(_signed(1 << (j + 32)))).otherwise(F.lit(0)).cast("long"))
    return F.coalesce(bits, F.lit(0).cast("long"))


def likeness(a: str, b: str) -> Column:
    """The share of equal bits."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def successors(docs: DataFrame) -> DataFrame:
    """(id, code, n, next_id, next_code, prev_id, prev_code, prev_n) of each document in descending order.

    Range partitions are ordered each by itself; the ends meet through one row a partition.
    """
    order = [F.col("id").desc(), F.col("code").desc()]
    own = written(docs.select("id", "code", "n").distinct().repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "simhash-order")
    inside = Window.partitionBy("slice").orderBy(*order)
    me = F.struct("id", "code", "n")
    rows = own.withColumns({"before": F.lag(me).over(inside), "after": F.lead(me).over(inside), "rank": F.row_number().over(inside)})
    rows = written(rows, "simhash-neighbours")
    # one row a slice: its first and its last document
    ends = rows.groupBy("slice").agg(F.min(F.when(F.col("before").isNull(), me)).alias("first"), F.max(F.when(F.col("after").isNull(), me)).alias("last"))
    over = Window.orderBy("slice")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("slice", F.coalesce(F.lead("first").over(over), F.first("first").over(whole)).alias("to"),
                       F.coalesce(F.lag("last").over(over), F.last("last").over(whole)).alias("from"))
    rows = rows.join(ends, "slice").withColumns({"after": F.coalesce("after", "to"), "before": F.coalesce("before", "from")})
    return rows.select("id", "code", "n", F.col("after.id").alias("next_id"), F.col("after.code").alias("next_code"),
                       F.col("before.id").alias("prev_id"), F.col("before.code").alias("prev_code"), F.col("before.n").alias("prev_n"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, code, n, edited_sha256, own, edited, next_id, next_code) of each distinct document."""
    near = written(successors(docs), "simhash-successors")
    once = docs.withColumn("copy", F.row_number().over(Window.partitionBy("id", "code").orderBy("id"))).filter("copy = 1").drop("copy", "n")
    here = once.join(near, ["id", "code"])
    lent = here.select(F.col("prev_id").alias("id"), F.col("prev_code").alias("code"), F.expr("substring(text, 1, int(prev_n div 2))").alias("lent"))
    both = here.join(lent, ["id", "code"]).withColumn("edited", F.expr("concat(substring(text, 1, int(n - n div 2)), lent)"))
    sides = both.select("id", "code", "n", "next_id", "next_code", F.sha2("edited", 256).alias("edited_sha256"),
                        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("s"))
    keys = ["id", "code", "n", "next_id", "next_code", "edited_sha256"]
    one = sides.select(*keys, "s.side", words(F.col("s.t")).alias("words")).select(*keys, "side", F.inline_outer(terms("words"))).groupBy(*keys, "side").agg(*votes()).select(*keys, "side", fingerprint().alias("f"))
    return one.groupBy(*keys).agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("own"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("edited"))


def within(counts: DataFrame, queries: DataFrame) -> DataFrame:
    """(own, others): for each fingerprint of ``queries`` the number of rows of ``counts`` (own, rows) with another one in the radius."""
    tables = masks()
    keyed = lambda df: df.select("*", F.explode(F.array(*[F.struct(F.lit(t).alias("table"), F.col("own").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(tables)])).alias("at")).select("*", "at.*").drop("at")
    q, c = keyed(queries.select("own").distinct()), keyed(counts).withColumnRenamed("own", "found")
    gap = F.col("own").bitwiseXOR(F.col("found"))
    first = F.coalesce(*[F.when(gap.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(tables)])
    met = q.join(c.withColumnsRenamed({"table": "t", "key": "k"}), (F.col("table") == F.col("t")) & (F.col("key") == F.col("k"))
                 & (gap != 0) & (F.bit_count(gap) <= RADIUS) & (first == F.col("table")))
    return met.groupBy("own").agg(F.sum("rows").alias("others"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the fingerprints of its text and its edited text, their likeness, and for queries the documents in the radius."""
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.select("id", "text", F.xxhash64("text").alias("code"), F.length("text").cast("long").alias("n"))
    made = written(fingerprints(docs), "simhash-fingerprints")
    rows = docs.select("id", "code").groupBy("id", "code").agg(F.count("*").alias("copies"))
    out = made.join(rows, ["id", "code"])
    after = made.select(F.col("id").alias("next_id"), F.col("code").alias("next_code"), F.col("own").alias("next_own"))
    out = written(out.join(after, ["next_id", "next_code"]), "simhash-rows")
    counts = out.groupBy("own").agg(F.sum("copies").alias("rows"))
    asked = out.filter(f"id % 20 = 0 and id <> {NO_ID}").select("own").distinct()
    near = asked.join(counts, "own").join(within(counts, asked), "own", "left").select("own", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_within"))
    text_of = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    out = out.join(near.withColumnRenamed("own", "o"), F.col("own") == F.col("o"), "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", text_of("own").alias("fingerprint"), text_of("edited").alias("edited_fingerprint"),
                      likeness("own", "edited").alias("near_edited"), likeness("own", "next_own").alias("near_next"),
                      F.when((F.col("id") % 20 == 0) & (F.col("id") != NO_ID), F.col("n_within")).alias("n_within"))
