"""Column functions over text: tokens, aliases, sentences, numbers, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import GENERIC_SUBJECTS, STOP_WORDS


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokenize(c: Column | str) -> Column:
    """STR1: lower-case runs of ASCII letters and digits, with inner - and /, without stop words and single characters."""
    words = F.regexp_extract_all(F.replace(F.lower(text_of(c)), F.lit("–"), F.lit("-")), F.lit("[a-z0-9]+(?:[-/][a-z0-9]+)*"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def norm_alias(c: Column | str) -> Column:
    """STR2: the key under which names are compared."""
    t = F.regexp_replace(F.lower(text_of(c)), "[–—]", "-")
    for pattern, to in (("[^a-z0-9/ \\-]+", " "), (" *- *", "-"), (" +", " ")):
        t = F.regexp_replace(t, pattern, to)
    t = F.trim(t)
    return F.when((F.length(t) > 4) & ~t.endswith("ss"), F.regexp_replace(t, "s$", "")).otherwise(t)


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(text_of(c), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))


def token_estimate(c: Column | str) -> Column:
    """STR4: 1.3 tokens a word, rounded down."""
    return F.floor(F.size(words(c)) * 13 / 10).cast("long")


def sentences(c: Column | str) -> Column:
    """STR6: cut after .!?; before a capital or bracket, and at line feeds; at least three characters."""
    return F.filter(F.transform(F.split(text_of(c), "(?<=[.!?;])\\s+(?=[A-Z(\\[])|\\n+"), lambda s: F.trim(s)), lambda s: F.length(s) >= 3)


def last_sentences(c: Column | str, n: int = 2) -> Column:
    """STR5: the last n sentences, for bridging chunks."""
    parts = F.split(F.trim(text_of(c)), "(?<=[.!?])\\s+")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), n), " ")


def leading_number(c: Column | str) -> Column:
    """STR13: the number that a value starts with, after an optional comparator; thousands commas are dropped."""
    head = F.regexp_extract(F.trim(text_of(c)), "^[<>≤≥~±]?[ ]*([+-]?[0-9][0-9,]*(?:[.][0-9]+)?)", 1)
    return F.when(head != "", F.replace(head, F.lit(","), F.lit("")).cast("double"))


def context_key(*parts: Column | str) -> Column:
    """STR14: what two claims must share to be comparable. Missing parts are empty, not left out."""
    return F.concat_ws("|", *[F.lower(F.trim(text_of(p))) for p in parts])


def uid(c: Column) -> Column:
    """STR12: the first 16 hex digits of an MD5."""
    return F.substring(F.md5(c), 1, 16)


def entity_uid(tag: Column | str) -> Column:
    return uid(F.lower(F.trim(text_of(tag))))


def scoped_uid(name: Column | str, document: Column | str) -> Column:
    return uid(F.concat(F.lower(F.trim(text_of(name))), F.lit("|"), text_of(document)))


def content_hash(c: Column | str) -> Column:
    """The key of repeated content: white space collapsed, lower case."""
    return uid(F.lower(F.trim(F.regexp_replace(text_of(c), "[\\x20\\x09-\\x0D]+", " "))))


def numbers(c: Column | str) -> Column:
    """The distinct numbers of a text, as doubles: '14' equals '14.0'."""
    found = F.regexp_extract_all(text_of(c), F.lit("[0-9]+(?:[.][0-9]+)?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: x.cast("double")))


def is_numeric_like(c: Column | str) -> Column:
    return text_of(c).rlike("^[<>≤≥~±]?[ ]*[+-]?[0-9][0-9., /%+-]*$")


def is_non_entity_name(c: Column | str) -> Column:
    """FLT10: a number, a distillation point or a table label, not a thing."""
    t = F.trim(text_of(c))
    plain = F.trim(F.regexp_replace(F.lower(t), "[^a-z]+", " "))
    return (t == "") | is_numeric_like(t) | t.rlike("^(?i:IBP|FBP|EP|[0-9]{1,3} ?(?:%|vol ?%))$") | plain.isin(*GENERIC_SUBJECTS)


def title_case(c: Column | str) -> Column:
    """EXT13: every run of letters with a capital first and small letters after, null as null."""
    col = F.col(c) if isinstance(c, str) else c
    runs = F.regexp_extract_all(col, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))), "")


def display_name(c: Column | str, acronyms: tuple[str, ...]) -> Column:
    """EXT13: a name all in capitals or all in small letters in title case, its words of ``acronyms`` in capitals again."""
    col = F.col(c) if isinstance(c, str) else c
    cased = F.lower(col) != F.upper(col)
    shown = F.when(cased & ((col == F.upper(col)) | (col == F.lower(col))), title_case(col)).otherwise(col)
    parts = F.regexp_extract_all(shown, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.isin(*acronyms), F.upper(x)).otherwise(x)), "")
