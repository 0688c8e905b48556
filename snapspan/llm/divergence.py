"""Source divergence audit: how the words of each source differ from those of the other sources and of its language.

Terms are runs of ASCII letters and code points from U+0080 on, with A-Z lowered. A language keeps the V terms that stand in at least 30
of its documents. With N occurrences of kept terms in a group, a term's share is p = 1 + floor(10^9 (count + 5) / (N + 5 V)). Part ``pair`` sums
|p - q| of two sources over all kept terms, part ``term`` lists the up to 50 terms whose share in a source exceeds the one in its language most.

Strings come late. First only digests of 64 bits are shuffled, with the documents they stand in. Terms whose digest is common are then counted by source,
by digest again; beside the counts each task writes down, once, which strings it met. The least and the greatest string behind a digest tell whether several terms share
it: these, and only these, are counted again by string and judged one by one. All later steps go by digest (and the string where it had to be split), and text is
joined back for the listed terms alone, whose ties it decides.

Null text, language and source are ''. Texts without terms count for their group all the same: every language and source
that occurs has its rows, also where V is 0 (all pairs are 0 then). Repeated rows count each. Extra columns are ignored. An empty table gives an empty result.
Each source pair of a language is a row of the result; within a language, blocks of terms hold one number a source and term.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapspan.llm import rolling
from snapspan.llm.common import slices, utf8_views, written
from snapspan.llm.phrases import BREAK, Filter, Words, closed, filter_of
from snapspan.llm.rolling import U

#: Documents of a language a term must stand in; terms listed a source.
COMMON, LISTED = 30, 50
SCALE, EXTRA = 1_000_000_000, 5
#: Counts that a task adds up before it tells; bytes of texts read at once; terms of a block; bits of the filter of common digests.
HELD, PIECE, BLOCK, FILTER = 1_000_000, 500_000, 512, 1 << 23
#: Letters with A-Z lowered, all else a break.
PLAIN = np.full(256, BREAK, np.uint8)
PLAIN[97:123] = PLAIN[65:91] = np.arange(97, 123)
PLAIN[128:] = np.arange(128, 256)
GROUP, TERM_KEY = ["lang", "source"], ["digest", "split"]


def _strings(values: list[bytes]) -> pa.Array:
    made = pa.array(values, pa.binary())
    return pa.StringArray.from_buffers(len(made), made.buffers()[1], made.buffers()[2])


def _digests(names: pa.Array, bits: int) -> np.ndarray:
    """A digest of each term."""
    data, at = utf8_views(names)
    made = rolling.Rolling(data).of(at[:-1], at[1:]) if len(at) > 1 else np.zeros(0, U)
    return made & U((1 << bits) - 1)


class Slice:
    """The terms of a slice of texts, each by an exact number, with the row it stands in."""

    def __init__(self, texts: pa.Array):
        data, offsets = closed(texts)
        words = Words(PLAIN[data], offsets)
        self.row, self.id, self.names = words.row, words.id, words.names


def _slices(batch: pa.RecordBatch):
    for a, b in slices(utf8_views(batch.column("text"))[1], PIECE, PIECE):
        part = batch.slice(a, b - a)
        yield part, Slice(part.column("text"))


def _coded(batch: pa.RecordBatch, *columns: str) -> tuple[np.ndarray, list[tuple]]:
    """A number for each row's values, and the values."""
    kinds: dict[tuple, int] = {}
    rows = zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in columns))
    return np.fromiter((kinds.setdefault(r, len(kinds)) for r in rows), np.int64, batch.num_rows), list(kinds)


class Sums:
    """Counts by a group and a digest, added up in arrays and told when there are many."""

    def __init__(self, columns: list[str]):
        self.columns, self.kinds, self.parts, self.size = columns, {}, [], 0

    def add(self, kinds: list[tuple], group: np.ndarray, digest: np.ndarray, n: np.ndarray):
        own = np.array([self.kinds.setdefault(k, len(self.kinds)) for k in kinds], np.int64)
        self.parts.append((own[group], digest, n))
        self.size += len(digest)
        if self.size >= HELD:
            self._join()
            if self.size >= HELD // 2:
                yield from self.tell()

    def _join(self) -> None:
        if not self.parts:
            return
        group, digest, n = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((digest, group))
        group, digest, n = group[order], digest[order], n[order]
        first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (digest[1:] != digest[:-1])]) if len(group) else np.zeros(0, np.int64)
        self.parts = [(group[first], digest[first], np.add.reduceat(n, first) if len(first) else n)]
        self.size = len(first)

    def tell(self):
        self._join()
        for group, digest, n in self.parts:
            names = list(self.kinds)
            for a in range(0, len(digest), 100_000):
                some = slice(a, a + 100_000)
                held = [_strings([names[g][c] for g in group[some].tolist()]) for c in range(len(self.columns))]
                yield held, pa.array(digest[some].view(np.int64)), pa.array(n[some])
        self.kinds, self.parts, self.size = {}, [], 0


def _documents(bits: int):
    """(lang, digest, docs): in how many documents of a language each term stands, as far as a task has seen."""
    def shaped(told):
        for held, digest, n in told:
            yield pa.RecordBatch.from_arrays([*held, digest, n], names=["lang", "digest", "docs"])

    def count(batches):
        sums = Sums(["lang"])
        for batch in batches:
            for part, s in _slices(batch):
                lang, kinds = _coded(part, "lang")
                v = max(len(s.names), 1)
                once = np.unique(s.row * v + s.id)
                key, docs = np.unique(lang[once // v] * v + once % v, return_counts=True)
                yield from shaped(sums.add(kinds, key // v, _digests(s.names, bits)[key % v], docs.astype(np.int64)))
        yield from shaped(sums.tell())

    return count


def _sources(bits: int, common):
    """(lang, source, digest, n) of terms whose digest may be common, and once a task (lang, digest, term) of each."""
    def shaped(told):
        for held, digest, n in told:
            yield pa.RecordBatch.from_arrays([*held, digest, n, pa.nulls(len(n), pa.string())], names=["lang", "source", "digest", "n", "term"])

    def named(lang: bytes, fresh: list[bytes], digest: np.ndarray):
        yield pa.RecordBatch.from_arrays([_strings([lang] * len(fresh)), pa.nulls(len(fresh), pa.string()), pa.array(digest.view(np.int64)), pa.nulls(len(fresh), pa.int64()), _strings(fresh)],
                                         names=["lang", "source", "digest", "n", "term"])

    def count(batches):
        known = Filter(common.value)
        sums, seen = Sums(["lang", "source"]), set()
        for batch in batches:
            for part, s in _slices(batch):
                group, kinds = _coded(part, "lang", "source")
                digests, v = _digests(s.names, bits), max(len(s.names), 1)
                key, n = np.unique(group[s.row] * v + s.id, return_counts=True)
                at, term = key // v, key % v
                keep = np.zeros(len(key), bool)
                for lang in {k[0] for k in kinds}:
                    own = np.array([k[0] == lang for k in kinds])
                    here = np.flatnonzero(own[at])
                    words = np.unique(term[here])
                    may = np.zeros(v, bool)
                    may[words] = known.has(_key(digests[words], lang))
                    keep[here] = may[term[here]]
                    words = words[may[words]]
                    names = s.names.take(pa.array(words)).to_pylist()
                    new = [i for i, name in enumerate(names) if (lang, name) not in seen]
                    if new:
                        seen.update((lang, names[i]) for i in new)
                        yield from named(lang, [names[i] for i in new], digests[words[new]])
                yield from shaped(sums.add(kinds, at[keep], digests[term[keep]], n[keep].astype(np.int64)))
                if len(seen) >= HELD:
                    seen = set()
        yield from shaped(sums.tell())

    return count


def _apart(bits: int, shared):
    """(lang, source, digest, split, n, docs) by string, of terms that may share their digest with another."""
    def count(batches):
        known = Filter(shared.value)
        for batch in batches:
            for part, s in _slices(batch):
                group, kinds = _coded(part, "lang", "source")
                digests, v = _digests(s.names, bits), max(len(s.names), 1)
                row, n = np.unique(s.row * v + s.id, return_counts=True)
                at, term = group[row // v], row % v
                keep = np.zeros(len(row), bool)
                for g, (lang, _) in enumerate(kinds):
                    here = np.flatnonzero(at == g)
                    keep[here] = known.has(_key(digests[term[here]], lang))
                at, term, n = at[keep], term[keep], n[keep]
                yield pa.RecordBatch.from_arrays([
                    _strings([kinds[g][0] for g in at.tolist()]), _strings([kinds[g][1] for g in at.tolist()]), pa.array(digests[term].view(np.int64)),
                    _strings(s.names.take(pa.array(term)).to_pylist()), pa.array(n.astype(np.int64))], names=["lang", "source", "digest", "split", "n"])

    return count


def _key(digests: np.ndarray, lang: bytes) -> np.ndarray:
    data = np.frombuffer(lang, np.uint8)
    return rolling.mix(digests ^ rolling.Rolling(data).of(np.array([0]), np.array([len(data)]))[0])


def _keys(batches):
    for batch in batches:
        h = np.zeros(batch.num_rows, U)
        lang, kinds = _coded(batch, "lang")
        digests = batch.column("digest").to_numpy(zero_copy_only=False).view(U)
        for i, (name,) in enumerate(kinds):
            h[lang == i] = _key(digests[lang == i], name)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


def _known(pairs: DataFrame):
    """A filter of a fixed size over (lang, digest)."""
    return filter_of(pairs.select("lang", "digest").mapInArrow(_keys, "h long"), FILTER)


def kept_terms(docs: DataFrame, least: int = COMMON, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The counts (lang, source, digest, split, n) of kept terms, and their names (lang, digest, split, term).

    ``split`` is empty but for terms that share their digest with another. ``bits`` shortens the digest. The documents are read twice: for the digests that
    are common, then for the counts of these; and a third time only if two terms share one.
    """
    said = docs.select("lang", "text").mapInArrow(_documents(bits), "lang string, digest long, docs long")
    common = written(said.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "digest"), "divergence-common")
    parts = written(docs.mapInArrow(_sources(bits, _known(common)), "lang string, source string, digest long, n long, term string"), "divergence-terms")
    found = parts.filter("term is not null").select("lang", "digest", "term").join(common, ["lang", "digest"], "left_semi")
    ends = written(found.groupBy("lang", "digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "divergence-ends")
    clear, shared = ends.filter("low = high").select("lang", "digest", "low"), ends.filter("low <> high").select("lang", "digest")
    counts = parts.filter("term is null").groupBy(*GROUP, "digest").agg(F.sum("n").alias("n"))
    kept = counts.join(clear.select("lang", "digest"), ["lang", "digest"], "left_semi").select(*GROUP, "digest", F.lit("").alias("split"), "n")
    names = clear.select("lang", "digest", F.lit("").alias("split"), F.col("low").alias("term"))
    if not shared.isEmpty():
        again = docs.mapInArrow(_apart(bits, _known(shared)), "lang string, source string, digest long, split string, n long").join(shared, ["lang", "digest"], "left_semi")
        again = written(again.groupBy(*GROUP, *TERM_KEY).agg(F.sum("n").alias("n"), F.count("*").alias("docs")), "divergence-split")
        common = again.groupBy("lang", *TERM_KEY).agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", *TERM_KEY)
        kept = kept.unionByName(again.join(common, ["lang", *TERM_KEY], "left_semi").select(*GROUP, *TERM_KEY, "n"))
        names = names.unionByName(common.withColumn("term", F.col("split")))
    return written(kept, "divergence-counts"), written(names, "divergence-names")


def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 v)), exact for counts of any length."""
    wide = "decimal(27,0)"
    part = (count + F.lit(EXTRA)).cast(wide) * F.lit(SCALE).cast("decimal(10,0)")
    return (F.lit(1) + F.call_function("div", part, (total + EXTRA * v).cast(wide))).cast("long")


def _between(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| over the terms of a block for all ordered pairs of sources; rows without a digest give a source's share of terms it lacks."""
    own = pdf[pdf["digest"].isna()].drop_duplicates("source").sort_values("source")
    names = own["source"].to_numpy()
    at = pd.Series(np.arange(len(names)), names)
    said = pdf[pdf["digest"].notna()]
    term = said.groupby(TERM_KEY, sort=False).ngroup().to_numpy()
    table = np.tile(own["p"].to_numpy(np.int64), (int(term.max()) + 1 if len(term) else 0, 1))
    table[term, at.loc[said["source"]].to_numpy()] = said["p"].to_numpy(np.int64)
    gaps = np.stack([np.abs(table - table[:, [i]]).sum(0) for i in range(len(names))])
    i, j = np.nonzero(~np.eye(len(names), dtype=bool))
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "source": names[i], "item": names[j], "value": gaps[i, j]})


def pairs(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language; ``groups`` has lang, source, total, v."""
    blocks = F.greatest(F.ceil(F.col("v") / BLOCK), F.lit(1))
    dealt = counts.join(groups, GROUP).select("lang", F.pmod(F.xxhash64(*TERM_KEY), blocks).alias("block"), "source", *TERM_KEY, share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    every = groups.filter("v > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "source", F.lit(None).cast("long").alias("digest"),
                                          F.lit("").alias("split"), share(F.lit(0).cast("long"), F.col("total"), F.col("v")).alias("p"))
    gaps = dealt.unionByName(every).groupBy("lang", "block").applyInPandas(_between, "lang string, source string, item string, value long")
    gaps = gaps.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"))
    both = groups.select(*GROUP).join(other, "lang").filter("source <> item")
    return both.join(gaps, [*GROUP, "item"], "left").select(*GROUP, "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def leading(groups: DataFrame, counts: DataFrame, names: DataFrame, most: int = LISTED) -> DataFrame:
    """(lang, source, item, value, rank) of the terms a source has above its language."""
    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    said = counts.groupBy("lang", *TERM_KEY).agg(F.sum("n").alias("everywhere"))
    over = counts.join(said, ["lang", *TERM_KEY]).join(groups, GROUP).join(whole, "lang").filter("n > 0")
    over = over.withColumn("value", share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("everywhere"), F.col("all"), F.col("v"))).filter("value > 0")
    best = over.withColumn("rank", F.rank().over(Window.partitionBy(*GROUP).orderBy(F.desc("value")))).filter(F.col("rank") <= most)
    named = best.join(names, ["lang", *TERM_KEY]).select(*GROUP, F.col("term").alias("item"), "value")
    return named.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= most)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = COMMON, most: int = LISTED, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank), parts ``pair`` and ``term``."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source), ("text", text))])
    counts, names = kept_terms(docs, least, bits)
    totals = counts.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    sizes = names.groupBy("lang").agg(F.count("*").alias("v"))
    none = F.lit(0).cast("long")
    groups = docs.select(*GROUP).distinct().join(totals, GROUP, "left").join(sizes, "lang", "left").select(*GROUP, F.coalesce("total", none).alias("total"), F.coalesce("v", none).alias("v"))
    groups = written(groups, "divergence-groups")
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    between = pairs(groups, counts).withColumn("rank", F.row_number().over(order))
    lines = [df.select(*GROUP, F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for part, df in (("pair", between), ("term", leading(groups, counts, names, most)))]
    return lines[0].unionByName(lines[1])


#: The same in DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
 c AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(ws) AS term FROM d) t GROUP BY ALL),
 kept AS MATERIALIZED (SELECT lang, term FROM c GROUP BY ALL HAVING count(*) >= 30),
 said AS (SELECT lang, source, term, sum(n)::BIGINT AS n FROM c SEMI JOIN kept USING (lang, term) GROUP BY ALL),
 g AS (SELECT d.lang, d.source, coalesce(any_value(s.total), 0) AS total, coalesce(any_value(v.v), 0) AS v FROM d
   LEFT JOIN (SELECT lang, source, sum(n) AS total FROM said GROUP BY ALL) s ON s.lang = d.lang AND s.source = d.source
   LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY ALL) v ON v.lang = d.lang GROUP BY d.lang, d.source),
 m AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(s.n, 0) + 5)) // (g.total + 5 * g.v) AS p
   FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN said s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
 q AS (SELECT m.lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(t.total) + 5 * any_value(t.v)) AS q FROM m
   JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM g GROUP BY lang) t ON t.lang = m.lang GROUP BY m.lang, term),
 gap AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(gap.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
   LEFT JOIN gap ON gap.lang = a.lang AND gap.source = a.source AND gap.item = b.source),
 term AS (SELECT m.lang, source, m.term AS item, (p - q)::BIGINT AS value FROM m JOIN q ON q.lang = m.lang AND q.term = m.term WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM term) z WHERE rank <= 50"""
