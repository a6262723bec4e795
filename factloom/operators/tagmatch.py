"""Sloppy tags: taking them apart, scoring candidates, suggesting and adopting."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions.text import text_of

# Class letters of one family of equipment, and the letter that a type carries.
FAMILIES = {"P": ("P", "PM", "PT", "PMP"), "E": ("E", "EX", "HE"), "C": ("C", "COL", "T"), "F": ("F", "H", "FUR"), "V": ("V", "D", "VES"), "J": ("J", "EJ"), "T": ("T", "TK")}
TYPE_CLASS = {"Pump": "P", "Exchanger": "E", "Column": "C", "Stripper": "C", "Heater": "F", "Vessel": "V", "Drum": "V", "Tank": "T", "Desalter": "V"}
# Scores from which a candidate is offered, accepted, clear, and the margin before the next.
OFFER, ACCEPT, CLEAR, MARGIN = 0.45, 0.72, 0.85, 0.08
BARE = r"(?i)^\s*([A-Z]{2,4})\s*[-–]\s*(\d{2,5})([A-Z])?\b"
FULL = r"(?i)\b(\d{1,3})(?:\s*[-–/ ]\s*(?!(?:TO|AND|OR|AT|IN|OF|BY|ON|PER|VS|THRU|UPTO)\b)([A-Z]{1,4}|\d{1,2})\s*[-–/ ]\s*|(?!(?:TO|AND|OR|AT|IN|OF|BY|ON|PER|VS|THRU|UPTO)\d)([A-Z]{1,4}))(\d{1,5})\s*([A-Z](?:\s*/\s*[A-Z])*)?\b"


def take_apart(c: Column | str) -> Column:
    """STR25: struct(unit, cls, number, train) of the first tag-like token, null without one. Loop tags are read first."""
    t = text_of(c)
    bare, full = (lambda k: F.upper(F.regexp_extract(t, BARE, k))), (lambda k: F.upper(F.regexp_extract(t, FULL, k)))
    make = lambda unit, cls, number, train: F.struct(unit.alias("unit"), cls.alias("cls"), number.alias("number"), train.alias("train"))
    return F.when(t.rlike(BARE), make(F.lit(""), bare(1), bare(2), bare(3))).when(t.rlike(FULL), make(full(1), F.concat(full(2), full(3)), full(4), F.regexp_replace(full(5), r"\s", "")))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def _near(a: Column, b: Column, weight: float, near: float) -> tuple[Column, Column]:
    known = (a != "") & (b != "")
    gap = F.abs(F.try_to_number(a, F.lit("99999")).cast("int") - F.try_to_number(b, F.lit("99999")).cast("int"))
    return F.when(known, weight).otherwise(0.0), F.when(gap == 0, 1.0).when(gap <= 1, near).otherwise(0.0)


def score(mention: Column, candidate: Column, expect_type: Column, entity_type: Column) -> Column:
    """STR26: similarity of two tags taken apart, by unit, number, class and spelling, with a nudge by type."""
    unit_w, unit_s = _near(mention["unit"], candidate["unit"], 0.30, 0.45)
    unit_s = F.when(mention["unit"] == candidate["unit"], 1.0).otherwise(unit_s)
    number_w, number_s = _near(mention["number"], candidate["number"], 0.35, 0.35)
    a, b = mention["cls"], candidate["cls"]
    family = F.lit(False)
    for members in FAMILIES.values():
        family = family | (a.isin(*members) & b.isin(*members))
    cls = F.when((a == "") | (b == ""), 0.10).when(a == b, 1.0).when(family, 0.85).when(~a.rlike("^[A-Z]+$"), 0.45).when(F.substring(a, 1, 1) == F.substring(b, 1, 1), 0.6).otherwise(_ratio(a, b) * 0.5)
    spelled = lambda p: F.concat_ws("-", p["unit"], p["cls"], p["number"])
    base = (unit_w * unit_s + number_w * number_s + cls * 0.25 + _ratio(spelled(mention), spelled(candidate)) * 0.10) / (unit_w + number_w + 0.35)
    carried = F.try_element_at(F.create_map(*[F.lit(x) for p in TYPE_CLASS.items() for x in p]), expect_type)
    nudged = F.when(expect_type == entity_type, base + (1 - base) * 0.35).when(entity_type.isNotNull() & carried.isNotNull() & (carried != b), base * 0.90).otherwise(base)
    return F.round(nudged, 3)


def suggest(mentions: DataFrame, entities: DataFrame, limit: int = 4) -> DataFrame:
    """WIN10: (request_id, canonical_tag, score, rank, adopted) for mentions (request_id, mention, expect_type).

    Candidates share the number, or one next to it, or unit and class, with the mention: an equi-join, no cross product.
    Trains of one item count once; ``adopted`` marks a best one that needs no asking.
    """
    asked = mentions.withColumn("m", take_apart("mention")).where("m is not null")
    known = entities.withColumn("c", take_apart("canonical_tag")).where("c is not null")
    number = lambda p: F.regexp_replace(p["number"], "^0+(?=.)", "").cast("int")
    keys = lambda p, near: F.array_distinct(F.concat(F.transform(F.sequence(number(p) - near, number(p) + near), lambda n: F.concat(F.lit("n"), n)), F.array(F.concat(F.lit("u"), p["unit"], F.lit("-"), p["cls"]))))
    met = asked.withColumn("key", F.explode(keys(F.col("m"), 1))).join(known.withColumn("key", F.explode(keys(F.col("c"), 0))), "key").drop("key").dropDuplicates(["request_id", "canonical_tag"])
    scored = met.withColumn("score", score(F.col("m"), F.col("c"), F.col("expect_type"), F.col("entity_type"))).where(F.col("score") >= OFFER)
    base = F.concat_ws("-", "c.unit", "c.cls", number(F.col("c")).cast("string"))
    order = [F.desc("score"), F.desc("mention_count"), "canonical_tag"]
    first = scored.withColumn("__b", F.row_number().over(Window.partitionBy("request_id", base).orderBy(*order))).where("__b = 1")
    w = Window.partitionBy("request_id").orderBy(*order)
    nxt, many = F.lead("score").over(w), F.lead("mention_count").over(w)
    sure = (F.col("score") >= ACCEPT) & (nxt.isNull() | (F.round(F.col("score") - nxt, 3) >= MARGIN) | ((F.col("score") >= 0.995) & (nxt < 0.995)) | ((F.col("score") >= CLEAR) & (F.col("mention_count") >= 2 * many + 1)))
    ranked = first.withColumn("rank", F.row_number().over(w)).withColumn("adopted", (F.row_number().over(w) == 1) & sure)
    return ranked.where(F.col("rank") <= limit).select("request_id", "canonical_tag", "score", "rank", "adopted")
