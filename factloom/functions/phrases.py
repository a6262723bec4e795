"""Column functions over phrases: aliases, values with units, labels, excerpts, arithmetic, JSON."""

from __future__ import annotations

import ast
import json
import operator
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from .text import text_of, tokenize

# The words of instrument letters.
FIRST_LETTERS = {"F": "flow", "L": "level", "P": "pressure", "T": "temperature", "A": "analyser", "H": "hand", "S": "speed", "V": "vibration"}
NEXT_LETTERS = {"I": "indicator", "C": "controller", "R": "recorder", "T": "transmitter", "V": "valve", "A": "alarm", "S": "switch", "E": "element", "G": "gauge", "H": "high", "L": "low"}


def clean_alias_phrase(c: Column | str, cut_words: list[str]) -> Column:
    """STR3: what follows the last cut word; trailing cut words go first."""
    words = F.split(F.regexp_replace(F.regexp_replace(text_of(c), "’", "'"), r"^[\s\-:,;.()]+|[\s\-:,;.()]+$", ""), r"\s+")
    last = F.array_max(F.transform(F.filter(F.transform(words, lambda w, i: F.when(F.lower(w).isin(cut_words), i + 1)), lambda x: x.isNotNull()), lambda x: x))
    return F.array_join(F.slice(words, F.coalesce(last, F.lit(0)) + 1, F.size(words)), " ")


@F.pandas_udf(BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() >= 0.8 for x, y in zip(a, b)])


def supported(needle: Column | str, hay: Column | str) -> Column:
    """STR7: contained, or four fifths of its words are, or nearly the same; only what the first two leave open reaches Python."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(text_of(c)), r"\s+", " "))
    n, h = plain(needle), plain(hay)
    words = F.filter(F.split(n, " "), lambda w: F.length(w) > 1)
    sure = h.contains(n) | ((F.size(words) > 0) & (F.size(F.filter(words, lambda w: F.contains(h, w))) * 10 >= F.size(words) * 8))
    return sure | (~sure & _alike(F.when(~sure, n), F.when(~sure, h)))


def split_value_unit(c: Column | str) -> Column:
    """STR15: struct(value, unit, condition): '9.0 cst @ 20°C' gives 9.0, cst, @ 20°C; footnote marks and a trailing bracket go."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text_of(c)), r"[*†‡]+$", ""), r"\s*\([^)]*\)$", "")
    pattern = r"^([<>≤≥~±]?\s*[+-]?\d[\d,]*(?:\.\d+)?(?:\s*-\s*\d+(?:\.\d+)?)?)\s*([^@\d\s][^@]*?)?\s*(@.*)?$"
    part = lambda k: F.regexp_extract(t, pattern, k)
    return F.when(t.rlike(pattern), F.struct(F.trim(part(1)).alias("value"), F.trim(part(2)).alias("unit"), F.trim(part(3)).alias("condition"))).otherwise(F.struct(t.alias("value"), F.lit("").alias("unit"), F.lit("").alias("condition")))


def ordered_distinct(parts: Column) -> Column:
    """STR24: parts joined by ' / ', each once whatever its case, empty ones left out."""
    first = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when((F.trim(x) == "") | F.array_contains(F.transform(a, F.lower), F.lower(F.trim(x))), a).otherwise(F.concat(a, F.array(F.trim(x)))))
    return F.array_join(first, " / ")


def describe_instrument(tag: Column | str) -> Column:
    """STR27: 'PIC' as 'pressure indicator controller'; null for letters without meaning."""
    letters = F.filter(F.split(F.upper(F.regexp_extract(text_of(tag), r"(?:^|-)([A-Za-z]{2,4})-?\d", 1)), ""), lambda x: x != "")
    table = lambda d: F.create_map(*[F.lit(x) for p in d.items() for x in p])
    words = F.transform(letters, lambda x, i: F.when(i == 0, F.try_element_at(table(FIRST_LETTERS), x)).otherwise(F.try_element_at(table(NEXT_LETTERS), x)))
    return F.when((F.size(letters) >= 2) & ~F.exists(words, lambda w: w.isNull()), F.array_join(words, " "))


def excerpt(c: Column | str, keywords: Column, width: int = 200) -> Column:
    """STR29: a window about the first keyword found, or the start, cut at a space."""
    t = text_of(c)
    at = F.array_min(F.filter(F.transform(keywords, lambda k: F.position(F.lower(k), F.lower(t))), lambda p: p > 0))
    start = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - width // 2)
    piece = F.substr(t, start, F.lit(width))
    return F.trim(F.when(F.length(t) > start + width, F.regexp_replace(piece, r"\s+\S*\z", "")).otherwise(piece))


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}


def _value(node: ast.AST) -> float:
    if isinstance(node, ast.Expression):
        return _value(node.body)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return float(node.value)
    if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
        a, b = _value(node.left), _value(node.right)
        if isinstance(node.op, ast.Pow) and (abs(b) > 64 or abs(a) > 1e6):
            raise ValueError
        return _OPS[type(node.op)](a, b)
    if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
        return _OPS[type(node.op)](_value(node.operand))
    raise ValueError


@F.pandas_udf(DoubleType())
def evaluate(expression: pd.Series) -> pd.Series:
    """STR31: plain arithmetic; null for anything else."""

    def one(e):
        try:
            return _value(ast.parse(e or "", mode="eval")) if len(e or "") <= 500 else None
        except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, TypeError):
            return None

    return expression.map(one)


@F.pandas_udf(StringType())
def salvage_json(raw: pd.Series) -> pd.Series:
    """STR35: the JSON object in an answer: fences, trailing commas and control characters go, open brackets are closed; null if hopeless."""

    def one(s):
        s = re.sub(r"```(?:json)?", "", s or "")
        s = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", s[s.find("{") :] if "{" in s else "")
        for cut in range(0, min(len(s), 500)):
            t = re.sub(r",\s*([}\]])", r"\1", s[: len(s) - cut].rstrip().rstrip(","))
            opened = []
            quoted = skip = False
            for ch in t:
                if skip:
                    skip = False
                elif ch == "\\":
                    skip = quoted
                elif ch == '"':
                    quoted = not quoted
                elif not quoted and ch in "{[":
                    opened.append("}" if ch == "{" else "]")
                elif not quoted and ch in "}]" and opened:
                    opened.pop()
            try:
                return json.dumps(json.loads(t + '"' * quoted + "".join(reversed(opened))), sort_keys=True)
            except ValueError:
                continue
        return None

    return raw.map(one)


def canonical_json(m: Column) -> Column:
    """STR38: a string map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def contents_title(c: Column | str) -> Column:
    """STR32: a contents line without leaders and page number."""
    return F.trim(F.regexp_replace(text_of(c), r"\s*\.{3,}\s*\d*\s*$", ""))


def ip_class(c: Column | str) -> Column:
    """STR36: loopback, unspecified, private, external; invalid for what is no IPv4 address."""
    octets = F.transform(F.split(text_of(c), r"\."), lambda x: F.when(x.rlike(r"^\d{1,3}$"), x.cast("int")))
    a, b = F.get(octets, F.lit(0)), F.get(octets, F.lit(1))
    valid = (F.size(octets) == 4) & F.forall(octets, lambda x: F.coalesce(x.between(0, 255), F.lit(False)))
    private = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    return F.when(~valid, "invalid").when(a == 127, "loopback").when(F.forall(octets, lambda x: x == 0), "unspecified").when(private, "private").otherwise("external")


def json_number(c: Column | str, name: str) -> Column:
    """STR35: a number out of a JSON object, by its parser; null where there is none."""
    return F.get_json_object(text_of(c), f"$.{name}").cast("int")


#: A fixed value: standards as texts write them.
REFERENCE = r"\b(?:ISO|API|ASTM|IS)[ -]?\d+"


def real_reference(c: Column | str) -> Column:
    """FLT18: the first standard whose prefix is written in capitals; 'is 482' in prose is none."""
    found = F.regexp_extract(text_of(c), REFERENCE, 0)
    return F.when(found != "", found)


def shared_tokens(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_intersect(tokenize(a), tokenize(b)))
