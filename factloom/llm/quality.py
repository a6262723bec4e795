"""Quality rules as one compiled projection.

A table of thresholds (a measure, its lowest and its highest passing value) over ratios of length, symbols, stop
words and lines is turned into one boolean expression. Everything is built from SQL functions on the row itself: no
user function, no shuffle, and a text of any length is read once as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is was that for it with as be on by at this from or an are not "
    "le la les de des et un une du en que qui dans pour sur avec est au "
    "der die das und ein eine ist mit von den zu nicht auf im sich dem "
    "el los las y una por con para se su es lo del"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` is SQL over the counted columns; a document passes if low <= measure <= high (None: no bound)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Ratios are compared as products, so that no division rounds: the measure is numerator minus bound times denominator.
RULES = (
    Rule("word length, at least 2 code points on average", "word_chars - 2 * n_words", low=0),
    Rule("word length, at most 14 code points on average", "word_chars - 14 * n_words", high=0),
    Rule("symbols, at most 1 in 10 words", "10 * n_symbols - n_words", high=0),
    Rule("exclamation and question marks, at most 3 in 10 words", "10 * n_marks - 3 * n_words", high=0),
    Rule("stop words, at least 1 in 50 words", "50 * n_stop_words - n_words", low=0),
    Rule("repeated lines, at most half of the lines", "2 * n_dup_lines - n_lines", high=0),
    Rule("lines ending in an ellipsis, at most half of the lines", "2 * n_ellipsis_lines - n_lines", high=0),
)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id with the counts that the rules use, of the whole text (null: no text)."""
    words_in = lambda name: F.regexp_extract_all(name, F.lit(WORD), F.lit(0))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__t"))
    base = base.select("doc_id", "__t", words_in("__t").alias("__w"), F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(WORD)).alias("__l"))
    chars = lambda pattern: (F.length("__t") - F.length(F.regexp_replace("__t", pattern, ""))).cast("long")
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    out = base.select(
        "doc_id",
        "__w",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("__t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        chars(r"[#*$%&|<>]+").alias("n_symbols"),
        chars(r"[!?]+").alias("n_marks"),
        F.expr(f"cast(size(filter(__w, w -> lower(w) IN ({stops}))) as bigint)").alias("n_stop_words"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.expr(r"cast(size(filter(__l, x -> x rlike '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')) as bigint)").alias("n_ellipsis_lines"),
    )
    return out.withColumn("n_repeat_words", repeated_words("__w")).drop("__w")


def repeated_words(words: str) -> Column:
    """How many words lie in 5-word windows that occur twice or more in the array, the first occurrence included.

    Windows are compared by 64 bits of xxHash within one text. The windows are sorted, neighbours with one hash are
    repeats, and the union of the repeats' spans is measured in order of position: n log n for any text.
    """
    marks = f"""array_sort(transform(sequence(0, size({words}) - 5), i -> struct(
        xxhash64({words}[i], {words}[i + 1], {words}[i + 2], {words}[i + 3], {words}[i + 4]) as h, i as p)))"""
    # array(marks) with one element makes the sorted windows a variable that is computed once a row.
    spans = f"""flatten(transform(array({marks}), m -> array_sort(filter(
        transform(m, (x, i) -> if(x.h <=> get(m, i - 1).h or x.h <=> get(m, i + 1).h, x.p, null)), p -> p is not null))))"""
    covered = f"""aggregate({spans}, named_struct('prev', -5, 'total', 0L),
        (a, p) -> named_struct('prev', p, 'total', a.total + least(5, p - a.prev)), a -> a.total)"""
    return F.expr(f"if(size({words}) < 5, 0L, {covered})")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table of thresholds as one boolean expression."""
    out = F.lit(True)
    for rule in rules:
        measure = F.expr(rule.measure)
        if rule.low is not None:
            out = out & (measure >= rule.low)
        if rule.high is not None:
            out = out & (measure <= rule.high)
    return out


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row.

    A null or empty text has no words and fails the base rule. Texts are judged whole, however long: what a row
    takes grows with its text. Repeated rows are judged alike, each on its own; other columns of ``docs``, whatever their
    names, are left out; an empty table gives an empty table.
    """
    out = counted(docs).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


OP6_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality counts and the verdict for every document."""
    return quality(table(spark, sf_dir, "documents")).select(*OP6_COLUMNS)


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM rep WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
        (length(t) - length(regexp_replace(t, '[!?]+', '', 'g')))::BIGINT AS n_marks,
        len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})))::BIGINT AS n_stop_words,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 14 * n_words AND 10 * n_symbols <= n_words
  AND 10 * n_marks <= 3 * n_words AND 50 * n_stop_words >= n_words AND 2 * n_dup_lines <= n_lines
  AND 2 * n_ellipsis_lines <= n_lines AS kept
FROM b
"""

QUERIES: dict[str, Callable] = {"op6_quality_rules": op6_quality_rules}
SQL: dict[str, str] = {"op6_quality_rules": OP6_SQL}
