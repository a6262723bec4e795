"""Claims and relations out of tables and prose."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.claim_rules import GENERIC_PROPERTY, PROPERTY_PRESSURE
from ..functions.tags import find_tags
from ..functions.vocabulary import GENERIC_SUBJECTS
from .folds import ordered_fold

# Words that say which value of a parameter a cell gives, and the property words with predicate and default unit.
CONDITIONS = (
    (r"mech\w*\.?\s*design", "mechanical_design"), (r"\bdesign\b", "design"), (r"\bmin(?:imum)?\b", "minimum"), (r"\bmax(?:imum)?\b", "maximum"), (r"\bnormal\b", "normal"),
    (r"\brated\b", "rated"), (r"\boperating\b", "operating"), (r"\btrip\b", "trip"), (r"\balarm\b", "alarm"), (r"\brelief\b", "relief"), (r"\btest\b", "test"),
)
PROPERTIES = (
    (PROPERTY_PRESSURE, "generic_property", ""), (r"cut\s*range", "cut_range", ""), (r"sp(?:ecific)?\.?\s*gr(?:avity)?", "specific_gravity", ""), (r"viscosity", "viscosity", ""), (r"density", "density", ""), (r"yield", "yield", "%"),
    (r"flash\s*point", "flash_point", "°C"), (r"pour\s*point", "pour_point", "°C"), (r"temp(?:erature)?", "temperature", "°C"), (r"press(?:ure)?", "pressure", ""), (r"\bkg\s*/\s*hr?\b", "mass_flow_rate", "kg/h"),
    (r"\bm3\s*/\s*hr?\b", "volumetric_flow_rate", "m3/h"), (r"flow|capacity", "flow_rate", ""), (r"power", "power", ""), (r"speed", "speed", ""), (r"material|moc", "material", ""), (GENERIC_PROPERTY, "generic_property", ""),
)
UNITS = ((r"kg\s*/\s*cm\s*[2²]", "kg/cm2"), (r"°\s*c|deg\s*c", "°C"), (r"kg\s*/\s*hr?\b", "kg/h"), (r"m3\s*/\s*hr?\b", "m3/h"), (r"\bbar\b", "bar"), (r"\bmm\b", "mm"), (r"\bkw\b", "kW"), (r"\brpm\b", "rpm"), (r"%", "%"))
NUMBER = re.compile(r"^[<>≤≥~]?\s*[+-]?\d[\d,]*(?:\.\d+)?")
TAG = re.compile(r"^\d{1,3}-[A-Z]{1,4}-\d{1,5}[A-Z]?$")
RANGE = re.compile(r"^[<>≤≥~]?\s*[+-]?\d[\d,]*(?:\.\d+)?(?:\s*-\s*\d[\d,]*(?:\.\d+)?)?")
CLAIMS = "table_id string, subject string, predicate string, value string, unit string, parameter_role string, qualifier string, layout string"


def _finder(rules: tuple) -> Callable:
    """What the first rule that a text meets says. Headings recur from table to table, so the last few thousand answers are kept."""
    compiled = [(re.compile(r[0], re.I), r[1:] if len(r) > 2 else r[1]) for r in rules]
    return lru_cache(4096)(lambda s: next((said for pattern, said in compiled if pattern.search(s)), None))


_condition, _property, _unit = map(_finder, (CONDITIONS, PROPERTIES, UNITS))


def _plain(s: str) -> str:
    return re.sub(r"[^a-z]+", " ", s.lower()).strip()


def _subject(hint: str) -> str:
    """What a label above a table names: its tag, else its words without number and colon."""
    tag = re.search(r"\b\d{1,3}-[A-Z]{1,4}-\d{1,5}[A-Z]?\b", hint)
    return tag[0] if tag else re.sub(r"^\s*\d+(?:\.\d+)*\.?\s+", "", hint).strip().rstrip(":")


def _cells_of(grid: list[list[str]], hint: str) -> list[tuple]:
    """(subject, predicate, value, unit, role, qualifier, layout) of one table: rows are subjects (B), properties by condition (A) or properties by subject (C)."""
    if len(grid) < 2:
        return []
    hint = _subject(hint)
    width = max(map(len, grid))
    rows = [[c.strip() for c in r] + [""] * (width - len(r)) for r in grid]
    n = 0 if width > 1 and _property(rows[0][0]) and NUMBER.match(rows[0][1]) else 1  # a list of properties may have no header
    while n and n < len(rows) - 1 and n < 3 and not any(NUMBER.match(c) for c in rows[n][1:]) and not TAG.match(rows[n][0]):
        n += 1
    heads = [" ".join(dict.fromkeys(r[k] for r in rows[:n] if r[k])) for k in range(width)]
    generic = [_plain(h) in GENERIC_SUBJECTS or not h for h in heads]
    body = rows[n:]
    props = [_property(h) for h in heads]
    out = []

    def add(subject, prop, value, where, role, qualifier, layout):
        if subject and prop and (NUMBER.match(value) or prop[0] in ("cut_range", "material")) and len(value) <= 40 and value.lower() not in ("nil", "-", "na"):
            role = role or ""
            stated = {"mechanical_design": "design", "rated": "operating", "": "operating"}.get(role, role)
            name = f"{stated}_{prop[0]}" if prop[0] in ("pressure", "temperature") and stated in ("minimum", "normal", "maximum", "design", "operating", "test", "relief") else prop[0]
            if prop[0] not in ("cut_range", "material"):
                value = re.sub(r"\s+", "", RANGE.match(value)[0])
            if prop[0] == "generic_property" and not qualifier:
                qualifier = re.sub(r"\s*\([^)]*\)\s*$", "", where).strip()
            out.append((subject, name, value, _unit(where) or prop[1], role, qualifier, layout))

    tags = sum(bool(TAG.match(r[0])) for r in body)
    named = [k for k in range(1, width) if props[k]]
    conditions = [k for k in range(1, width) if _condition(heads[k])]
    by_row = sum(_property(r[0]) is not None for r in body)
    if named and (re.search(r"\btag\b|product|equipment|item", heads[0], re.I) or tags * 2 >= len(body)):
        for r in body:
            for k in named:
                for part in r[k].split(",") if props[k][0] == "temperature" and re.match(r"^[\d.]+\s*,\s*[\d.]+", r[k]) else [r[k]]:
                    add(r[0], props[k], part.strip(), heads[k], _condition(heads[k]), " / ".join(x for x in re.findall(r"\b(?:PG|BH)\b", heads[k])), "B")
    elif conditions and by_row:
        for r in body:
            for k in conditions:
                add(hint, _property(r[0]), r[k], r[0], _condition(heads[k]), "", "A")
    elif by_row:
        for r in body:
            for k in range(1, width):
                at = re.search(r"@\s*\S.*$", r[0])
                subject, role = (hint, _condition(r[0])) if generic[k] else (heads[k], "")
                add(subject, _property(r[0]), r[k], re.sub(r"@.*$", "", r[0]), role, at[0] if at else "", "C")
    return out


def table_claims(tables: DataFrame) -> DataFrame:
    """EXT1: claims of tables (table_id, hint, row, cells array<string>): a table's rows in order make one list, and tables are read a batch at a time."""
    out = [c.split()[0] for c in CLAIMS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for table, rows in zip(batch.column("table_id").to_pylist(), batch.column("rows").to_pylist()):
                rows.sort(key=lambda r: (r["row"] is None, r["row"] or 0))
                found += [(table, *f) for f in _cells_of([[c or "" for c in r["cells"]] for r in rows], rows[0]["hint"] or "")]
            columns = zip(*found) if found else [()] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], out)

    lists = tables.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row", "hint", "cells"))).alias("rows"))
    return lists.mapInArrow(run, CLAIMS)


def spec_pairs(elements: DataFrame) -> DataFrame:
    """EXT2: (document_id, label, value, reading_order): ``Label: value`` lines, and runs of labels followed by as many values, paired in order.

    Runs are islands of one kind; a label run and the value run that comes next are one group, in which the value is the row after its
    label by position. So elements are ordered once, and only labels and values go on.
    """
    c = F.trim(F.col("content"))
    inline = F.regexp_extract(c, r"^([A-Za-z][^:]{1,60}):\s*(\S.*)$", 1)
    one = elements.where(inline != "").select("document_id", F.trim(inline).alias("label"), F.regexp_extract(c, r"^([A-Za-z][^:]{1,60}):\s*(\S.*)$", 2).alias("value"), "reading_order")
    kind = F.when(c.rlike(r"^[A-Za-z][^:]{1,60}:$"), "label").when(c.rlike(r"^[<>≤≥~]?\s*[+-]?\d"), "value").otherwise("other")
    w = Window.partitionBy("document_id").orderBy("reading_order")
    marked = elements.withColumn("kind", kind).withColumn("starts", F.coalesce((F.lag("kind").over(w) != F.col("kind")).cast("int"), F.lit(1)))
    place = F.row_number().over(w)
    islands = marked.where("document_id is not null").withColumn("run", F.sum("starts").over(w)).withColumn("place", place).withColumn("at", F.col("place") - F.max(F.when(F.col("starts") == 1, F.col("place"))).over(w)).where("kind <> 'other'")
    paired = islands.select("document_id", (F.col("run") + F.when(F.col("kind") == "label", 1).otherwise(0)).alias("pair"), "at", "kind", c.alias("said"), "reading_order").repartition("document_id", "pair")
    group = Window.partitionBy("document_id", "pair")
    of = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).over(group)
    met = paired.withColumn("value", F.lead("said").over(group.orderBy("at", "kind"))).withColumn("even", of("label") == of("value")).where("kind = 'label' and even")
    return one.unionByName(met.select("document_id", F.regexp_replace("said", ":$", "").alias("label"), "value", "reading_order"))


def prose_claims(sentences: DataFrame) -> DataFrame:
    """EXT4: (chunk_id, pos, subject, label, value, unit) of sentences (chunk_id, pos, sentence): ``the pump`` stands for the last tag of the chunk."""
    s = F.col("sentence")
    own = F.get(find_tags(s), F.lit(0))
    carried = F.last(own, True).over(Window.partitionBy("chunk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    pattern = r"(?i)\b(?:(design|normal|maximum|minimum|operating|rated)\s+)?(pressure|temperature|flow(?:\s+rate)?|capacity|speed|power)\s+(?:is|of|at|should be|shall be|=)\s+(?:about\s+)?(-?\d[\d,]*(?:\.\d+)?)\s*(kg/cm2|bar|°c|m3/hr?|kg/hr?|rpm|kw|%)?"
    at = lambda k: F.regexp_extract_all(s, F.lit(pattern), F.lit(k))
    found = F.explode(F.arrays_zip(at(1).alias("role"), at(2).alias("label"), at(3).alias("value"), at(4).alias("unit")))
    rows = sentences.withColumn("subject", F.coalesce(own, F.when(s.rlike(r"(?i)\b(?:the|this)\s+(?:pump|column|exchanger|vessel|heater|unit)\b"), carried))).where("subject is not null")
    rows = rows.select("chunk_id", "pos", "subject", found.alias("x"))
    label = F.lower(F.trim(F.concat_ws(" ", F.when(F.col("x.role") != "", F.col("x.role")), F.col("x.label"))))
    return rows.select("chunk_id", "pos", "subject", label.alias("label"), "x.value", "x.unit").dropDuplicates(["chunk_id", "subject", "label", "value", "unit"])


def rule_relations(sentences: DataFrame, names: DataFrame) -> DataFrame:
    """EXT5: (chunk_id, subject, rel_type, object, confidence): sentence patterns between names; both known 0.75, one 0.6, none dropped.

    ``names`` (name): known names, joined by their normalised form. A name may hold a number of any length, unlike a tag.
    """
    item = r"((?:\d{1,3}-)?[A-Z]{1,4}-\d+[A-Z]?|(?:[a-z]+ ){0,3}[a-z]+)"
    rules = (
        (rf"{item} (?:feeds|flows to|is routed to|goes to) (?:the )?{item}", "FEEDS"), (rf"{item} (?:receives feed from|is fed from|is fed by) (?:the )?{item}", "RECEIVES_FROM"),
        (rf"{item} (?:discharges to|delivers to) (?:the )?{item}", "DISCHARGES_TO"), (rf"{item} takes suction from (?:the )?{item}", "SUCTION_FROM"),
        (rf"{item} is protected by (?:the )?{item}", "PROTECTED_BY"), (rf"{item} is controlled by (?:the )?{item}", "CONTROLLED_BY"), (rf"{item} is part of (?:the )?{item}", "PART_OF"),
        (rf"{item} is (?:located )?upstream of (?:the )?{item}", "UPSTREAM_OF"), (rf"{item} is (?:located )?downstream of (?:the )?{item}", "DOWNSTREAM_OF"),
    )
    strip = lambda c: F.trim(F.regexp_replace(c, r"(?i)^(?:the|a|an)\s+", ""))
    parts = None
    for pattern, kind in rules:
        at = lambda k, p=pattern: F.regexp_extract_all("sentence", F.lit(p), F.lit(k))
        rows = sentences.select("chunk_id", F.explode(F.arrays_zip(at(1).alias("a"), at(2).alias("b"))).alias("x")).select("chunk_id", strip(F.col("x.a")).alias("subject"), F.lit(kind).alias("rel_type"), strip(F.col("x.b")).alias("object"))
        parts = rows if parts is None else parts.unionByName(rows)
    known = names.select(text.norm_alias("name").alias("k")).distinct()
    a, b = known.select(F.col("k").alias("ka"), F.lit(1).alias("ia")), known.select(F.col("k").alias("kb"), F.lit(1).alias("ib"))
    joined = parts.where(F.lower("subject") != F.lower("object")).join(a, text.norm_alias("subject") == F.col("ka"), "left").join(b, text.norm_alias("object") == F.col("kb"), "left")
    count = F.coalesce("ia", F.lit(0)) + F.coalesce("ib", F.lit(0))
    return joined.where(count > 0).select("chunk_id", "subject", "rel_type", "object", F.when(count == 2, 0.75).otherwise(0.6).alias("confidence")).dropDuplicates(["chunk_id", "subject", "rel_type", "object"])


def table_labels(elements: DataFrame) -> DataFrame:
    """STC14: (document_id, table_id, label): label lines wait in a queue; each table takes the oldest, a heading empties it. A document streams through one task."""

    def step(state: dict, part: pd.DataFrame) -> pd.DataFrame:
        queue, out = state["queue"], []
        for r in part.itertuples():
            content = (r.content or "").strip()
            if r.element_type == "heading":
                queue.clear()
            elif r.element_type == "table":
                out.append((r.document_id, r.table_id, queue.popleft() if queue else ""))
            elif r.element_type == "text" and content and len(r.content) <= 120 and len(content.split()) <= 18:
                queue.append(content.rstrip(":"))
        return pd.DataFrame(out, columns=["document_id", "table_id", "label"])

    return ordered_fold(elements, "document_id", ["reading_order"], "", lambda: {"queue": deque()}, step, "document_id string, table_id string, label string")
