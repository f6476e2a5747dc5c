"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Each rule bounds one measure of a text; a text is kept when every measure is within its bounds. The measures are
column expressions over arrays of words and lines, so the whole rule set is one pass without a shuffle or a user function.
Windows of three words are compared through a 64-bit hash within one text.

Defined results
* null text counts as empty: no words, base_failed, not kept;
* ratios of an empty text are 0;
* repeated rows are judged one by one, an empty table gives an empty result;
* extra columns of any name pass through filter_documents() unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, packed, text_of, unpacked

#: Frequent function words of the languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not are this or from at an which a have has "
    "le la les de des du un une et en que qui dans pour par sur au aux est il elle ne pas se ce "
    "der die das und ist von zu den mit dem des ein eine nicht sich auf für im als auch es "
    "el los las del y que se con por una para no lo al como su más o"
).split()


@dataclass(frozen=True)
class Rule:
    """low <= measure <= high; None leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        x, ok = F.col(self.measure), F.lit(True)
        if self.low is not None:
            ok = ok & (x >= F.lit(self.low))
        if self.high is not None:
            ok = ok & (x <= F.lit(self.high))
        return ok


#: The production table.
RULES = (
    Rule("n_words", low=50),
    Rule("mean_word_chars", low=2.0, high=15.0),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_ratio", low=0.02),
    Rule("letter_word_ratio", low=0.7),
    Rule("dup_line_ratio", high=0.5),
    Rule("repeat_word_ratio", high=0.5),
)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _row and the measures of each text."""
    t = packed(docs, _id=id_col, _text=text_of(text_col))
    t = t.withColumns({"_words": F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), "_lines": F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    t = t.withColumn("_n", F.size("_words"))

    def window(i: Column) -> Column:
        w = F.col("_words")
        return F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))

    none = F.expr("cast(array() as array<struct<h: bigint, i: int>>)")
    t = t.withColumn("_win", F.when(F.col("_n") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.col("_n") - 3, F.lit(0))), window))).otherwise(none))

    def twice(x: Column, k: Column) -> Column:
        win, last = F.col("_win"), F.size("_win") - 1
        return F.when(((k > 0) & (win[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < last) & (win[F.least(k + 1, last)]["h"] == x["h"])), x["i"])

    t = t.withColumn("_again", F.filter(F.transform("_win", twice), lambda x: x.isNotNull()))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_again", lambda i: F.array(i, i + 1, i + 2)))))
    stop, letters = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))]), r"\p{L}"
    # Given out by a generator, so that a filter on a measure stays above: moved below, it would write out the expressions, which
    # use each other many times, in full.
    t = t.select("_id", "_row", F.inline(F.array(F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: F.array_contains(stop, F.lower(F.rtrim(w, F.lit(".,;:!?")))))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_words", lambda w: w.rlike(letters))).cast("long").alias("n_letter_words"),
    ))))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return t.withColumns({
        "mean_word_chars": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"), "stop_ratio": per("n_stop_words", "n_words"),
        "letter_word_ratio": per("n_letter_words", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "repeat_word_ratio": per("n_repeat_words", "n_words"),
    })


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measured() with base_failed, kept and failed (the measures out of bounds)."""
    t = measured(docs, id_col, text_col)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~r.holds(), F.lit(r.measure)) for r in rules]), lambda x: x.isNotNull())
    t = t.withColumns({"base_failed": base, "failed": failed})
    return t.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def filter_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that every rule keeps, its columns as they were."""
    return unpacked(judged(docs, rules, id_col, text_col).filter("kept"), docs.columns)


QUERY = "op4_quality_rules"
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def _sql() -> str:
    """The same rules for DuckDB."""
    words = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    bounds = [f"{r.measure} {op} {v}" for r in RULES for op, v in ((">=", r.low), ("<=", r.high)) if v is not None]
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
  len(list_filter(ws, lambda w: list_contains([{words}], lower(rtrim(w, '.,;:!?'))))) AS n_stop, len(list_filter(ws, lambda w: regexp_matches(w, '\p{{L}}'))) AS n_letter
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbol_ratio,
  CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0.0 END AS stop_ratio, CASE WHEN n_words > 0 THEN n_letter / n_words ELSE 0.0 END AS letter_word_ratio,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_word_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(bounds)} AS kept FROM r
"""


SQL = _sql()
