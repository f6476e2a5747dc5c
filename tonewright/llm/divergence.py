"""How the sources of a language differ in their words, term by term and pair by pair, with count-level bitmaps.

Every group (a language and one of its sources) gives each kept term of the language a smoothed share p in whole
billionths. Terms are numbered by falling frequency, so that terms of a block of WIDTH are about as frequent, and a group's
terms of a block are stored as one bitmap for each count that occurs in it. Terms that the group hasn't got are the
complement of the others within the block. For a pair of groups the joint cell of two counts is the AND of two bitmaps; its
popcount is the number of terms there, each of which adds the same |p - q|. Rare terms, by far the most, share a few counts,
so a block costs a few ANDs where comparing term by term would cost WIDTH rows.

Words are counted in the map tasks and leave them as one row for each group and term. All later tables are by term or by
block, so neither a hot source nor a hot word meets in one task; numbering is by range partitions, without a window.

Defined results
* null text, language and source count as empty;
* a group without terms, or a language without kept ones, has its rows of the part `pair`, with value 0 where no term is kept;
* rows that repeat are documents of their own, an empty table gives an empty result;
* a text of any length is counted whole; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, recorded, release, stored, text_of

MIN_DOCS = 30
#: Added to every count, and the unit of shares.
PRIOR = 5
UNIT = 1_000_000_000
TOP = 50
#: Terms of a block, at most the bits of a long.
WIDTH = 32
#: Terms that a map task holds before it passes their counts on.
HELD = 400_000

#: A-Z to lower case, all other ASCII but a-z to blanks; bytes of longer characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents); each group has a row with an empty term too."""
    t = packed(docs, _lang=text_of(lang_col), _source=text_of(source_col), _text=text_of(text_col)).drop("_row")

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def flush():
            for (lang, source), (n, d) in held.items():
                terms = pa.array([b"", *n], pa.binary()).view(pa.string())
                same = lambda x: pa.DictionaryArray.from_arrays(pa.repeat(pa.scalar(0, pa.int32()), len(n) + 1), pa.array([x], pa.string())).cast(pa.string())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(lang), same(source), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *(d[x] for x in n)], pa.int64())], names=["lang", "source", "term", "n", "d"])
            held.clear()

        size = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                terms = text.as_py().translate(_FOLD).split()
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(terms)
                d.update(set(terms))
                size += len(n)
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    found = t.mapInArrow(run, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), exact."""
    return F.expr(f"1 + CAST({UNIT} AS DECIMAL(10,0)) * (CAST({count} AS DECIMAL(19,0)) + {PRIOR}) div (CAST({total} AS DECIMAL(19,0)) + {PRIOR} * CAST({terms} AS DECIMAL(15,0)))")


def _bits(slot: str) -> Column:
    return F.expr(f"shiftleft(1L, CAST({slot} % {WIDTH} AS INT))")


def levels(counts: DataFrame, terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, block, source, p and bits: a bitmap for each count that a group has in a block, 0 included."""
    block = F.floor(F.col("slot") / WIDTH).cast("long").alias("block")
    have = counts.groupBy("lang", "source", block, "n").agg(F.bit_or(_bits("slot")).alias("bits"))
    seen = have.groupBy("lang", "source", "block").agg(F.bit_or("bits").alias("seen"))
    masks = terms.groupBy("lang", block).agg(F.bit_or(_bits("slot")).alias("mask"))
    none = groups.select("lang", "source").join(masks, "lang").join(seen, ["lang", "source", "block"], "left")
    none = none.select("lang", "source", "block", F.lit(0).cast("long").alias("n"), F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0)))).alias("bits"))
    both = have.unionByName(none.filter("bits != 0")).join(groups, ["lang", "source"])
    return both.select("lang", "block", "source", share("n", "total", "terms").alias("p"), "bits")


def pair_distances(level: DataFrame) -> DataFrame:
    """lang, source, item (another source) and value, for each pair once: joint cells times the difference of their shares."""
    other = level.select("lang", "block", F.col("source").alias("item"), F.col("p").alias("q"), F.col("bits").alias("with"))
    met = level.join(other, ["lang", "block"]).filter("source < item")
    cell = F.bit_count(F.col("bits").bitwiseAND(F.col("with"))).cast("long")
    return met.groupBy("lang", "source", "item").agg(F.sum(cell * F.abs(F.col("p") - F.col("q"))).alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank."""
    with recorded() as made:
        out = stored(_audit(docs, text_col, lang_col, source_col, min_docs, top), "divergence")
        release(docs.sparkSession, made, out)
    return out


def _audit(docs: DataFrame, text_col: str, lang_col: str, source_col: str, min_docs: int, top: int) -> DataFrame:
    every = stored(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    kept = every.filter("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("d").alias("d")).filter(F.col("d") >= min_docs)
    kept = stored(kept.select("lang", "term", "all"), "kept-terms")
    # Consecutive within a partition, so blocks are of neighbours; a block with the end of one language and the start of the next is two.
    terms = stored(kept.orderBy("lang", F.desc("all"), "term").withColumn("slot", F.monotonically_increasing_id()), "terms")
    counts = stored(every.filter("term != ''").join(terms, ["lang", "term"]).select("lang", "source", "term", "slot", "n", "all"), "counts")

    by_lang = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total"))
    by_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = every.filter("term = ''").select("lang", "source").join(by_lang, "lang", "left").join(by_group, ["lang", "source"], "left")
    groups = stored(groups.fillna(0, ["terms", "lang_total", "total"]), "groups")

    one_way = pair_distances(stored(levels(counts, terms, groups), "levels"))
    met = stored(one_way, "pairs")
    met = met.unionByName(met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source != item")
    pairs = others.join(met, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    more = counts.join(groups, ["lang", "source"]).withColumn("value", share("n", "total", "terms") - share("all", "lang_total", "terms"))
    more = more.filter("n > 0 and value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("value").cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(more.withColumn("rank", rank).filter(F.col("rank") <= top))


QUERY = "op13_source_divergence"

SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT k, lang, source, unnest(ws) AS term FROM d),
t AS (SELECT lang, term, count(*) AS a FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
l AS (SELECT lang, count(*) AS v, sum(a) AS n FROM t GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN t USING (lang, term) GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS ln, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) s USING (lang, source)),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (g.n + 5 * g.v) AS p, 1 + (1000000000::HUGEINT * (t.a + 5)) // (g.ln + 5 * g.v) AS q
  FROM g JOIN t USING (lang) LEFT JOIN c USING (lang, source, term)),
o AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(o.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN o ON o.lang = a.lang AND o.source = a.source AND o.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE c > 0 AND p > q),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM n WHERE part = 'pair' OR rank <= 50
"""
