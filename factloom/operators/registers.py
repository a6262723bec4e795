"""Registers, profiles and the graph of documents: what is read off headings, tables and references for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.vocabulary import DOCUMENT_TYPES
from .index import first_items

# Numbers of standing instructions, the chapter that took one in, words of field labels, tags by kind of equipment.
INSTRUCTION = r"(?i)[A-Z]{2,5}(?:\s*/\s*[A-Z&]{2,6}(?:\s[A-Z]{1,2})?){0,3}\s*/\s*SI\s*/\s*\d{1,4}"
IN_CHAPTER = r"(?i)chapter\s*[-–:.]*\s*(\d{1,3})"
FIELD_LABEL = r"(?i)\b(page|rev|chapter|plant|doc|document)\b"
PLANT_LABEL = r"(?i)plant\s*(no|name)|unit\s*(no|name)?"
EQUIPMENT_TAG = r"\b[PEVCTFRKDH]-\d{2,4}[A-Z]?\b"


def plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(text.text_of(c), r"\s+", " "))


def reference_number(c: Column) -> Column:
    """STR32: a register number in capitals, nothing around dashes and slashes, no spaces at all in numbers of standing instructions."""
    tight = F.upper(F.regexp_replace(plain(c), r"\s*([-/])\s*", "$1"))
    return F.when(tight.contains("/SI/"), F.regexp_replace(tight, r"\s+", "")).otherwise(tight)


def standing_instructions(rows: DataFrame) -> DataFrame:
    """STC9: (document_id, number, title, issue_date, status, chapter, remark, page) of register tables.

    ``rows``: document_id, place (order of the table in its document), row (from 0), cells (array of text), page. A table whose first
    row speaks of a standing instruction sets the columns; a table after it without such a row goes on with them if its first row
    holds a number. Tables of fewer than three columns and rows without a number are passed over. The first row of a number
    wins. Only first rows are ordered within a document; all others meet their table's columns by its key. Null cells are empty.
    A number is looked for where a slash is, once a cell, columns only where a first row sets them, and only cells of the rows that win are
    made plain.
    """
    given = rows.select("document_id", "place", "row", "page", F.transform(F.coalesce("cells", F.array().cast("array<string>")), text.text_of).alias("cells"))
    numbers = F.filter(F.transform(F.filter("cells", lambda x: x.contains("/")), lambda x: F.regexp_extract(plain(x), INSTRUCTION, 0)), lambda x: x != "")
    listed = given.select("*", F.explode_outer(F.slice(numbers, 1, 1)).alias("found")).where("found is not null")
    says = lambda x, *words: x.contains(words[0]) if len(words) == 1 else x.contains(words[0]) | says(x, *words[1:])
    at = lambda default, *words: F.when(F.col("headed"), F.coalesce(F.nullif(F.array_position(F.transform("cells", lambda x: says(F.lower(x), *words)), True).cast("int"), F.lit(0)) - 1, default))
    headed, numbered = F.exists("cells", lambda x: F.lower(x).contains("standing instruction")), F.exists("cells", lambda x: x.contains("/") & x.rlike(INSTRUCTION))
    first = given.where("row = 0").where(F.size("cells") >= 3).select("document_id", "place", "cells", headed.alias("headed"), numbered.alias("numbered")).where("headed or numbered")
    placed = first.select("document_id", "place", "headed", "numbered", at(F.lit(2), "title").alias("title"), at(F.lit(3), "date").alias("date"), at(F.size("cells") - 1, "expired", "incorporated", "status").alias("status"))
    heads = placed.dropDuplicates(["document_id", "place"]).select("document_id", "place", "headed", "numbered", F.struct("title", "date", "status").alias("own"))
    w = Window.partitionBy("document_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    used = heads.withColumn("at", F.last(F.when(F.col("headed"), F.col("own")), True).over(w)).where("headed or (numbered and at is not null)").select("document_id", "place", "headed", "at")
    met = listed.join(used, ["document_id", "place"]).where("not headed or row > 0")
    cell = lambda role: F.coalesce(F.get("cells", F.col(f"at.{role}")), F.lit(""))
    read = met.select("document_id", reference_number(F.col("found")).alias("number"), F.struct("place", "row", cell("title").alias("title"), cell("date").alias("issue_date"), cell("status").alias("remark"), "page").alias("r"))
    kept = read.groupBy("document_id", "number").agg(F.min("r").alias("r"))
    kept = kept.select("document_id", "number", plain(F.col("r.title")).alias("title"), plain(F.col("r.issue_date")).alias("issue_date"), plain(F.col("r.remark")).alias("remark"), "r.page")
    remark = F.col("remark")
    status = F.when(remark.rlike("(?i)expired"), "expired").when(remark.rlike("(?i)invalid|cancel"), "cancelled").when(remark.rlike("(?i)incorporated"), "incorporated").otherwise("in_use")
    return kept.select("document_id", "number", "title", "issue_date", status.alias("status"), F.regexp_extract(remark, IN_CHAPTER, 1).alias("chapter"), "remark", "page")


def document_types(elements: DataFrame, early: int = 5, most: int = 2000) -> DataFrame:
    """STC16: (document_id, title, document_type): ``elements`` are document_id, page, reading_order, heading_level (0 or null: no heading), content.

    The title is the first heading of level 1 on the first ``early`` pages, else the first heading there, else empty. The type is the
    first of the fixed list with a word in the title or in the first ``most`` characters of those pages' text, else unknown; an
    element is kept for that text only while those before it have not filled it. Equal places are ordered by content.
    """
    front = elements.where(F.col("page") <= early).withColumn("content", text.text_of("content"))
    head = F.struct(F.coalesce(F.col("heading_level") != 1, F.lit(True)).alias("l"), F.col("reading_order").alias("o"), F.trim("content").alias("t"))
    titles = front.where("heading_level > 0").groupBy("document_id").agg(F.min(head)["t"].alias("title"))
    w = Window.partitionBy("document_id").orderBy("reading_order", "content").rowsBetween(Window.unboundedPreceding, -1)
    opening = front.withColumn("__before", F.coalesce(F.sum(F.length("content") + 1).over(w), F.lit(0))).where(F.col("__before") < most)
    texts = opening.groupBy("document_id").agg(F.lower(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__before", "reading_order", F.substring("content", 1, most).alias("c")))), lambda x: x["c"]), " "), 1, most)).alias("opening"))
    out = elements.select("document_id").distinct().join(titles, "document_id", "left").join(texts, "document_id", "left")
    out = out.select("document_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("opening", F.lit("")).alias("opening"))
    low = F.lower("title")
    kind = F.coalesce(*[F.when(F.exists(F.array(*[F.lit(x) for x in words]), lambda x: F.contains(low, x) | F.contains(F.col("opening"), x)), F.lit(name)) for name, words in DOCUMENT_TYPES], F.lit("unknown"))
    return out.select("document_id", "title", kind.alias("document_type"))


def header_votes(cells: DataFrame, least: int = 3) -> DataFrame:
    """STC16: (document_id, title, unit, n_tables) from the boxes at the head of pages: document_id, place (of the table), row, col, content.

    A cell's text votes once a table, three times from the top row; texts under three characters, with a digit or of a field's label do
    not vote. The title needs votes of half the tables. The unit is the text that most often follows a label of plant or unit in its
    row. Ties go to the first by place. Documents with fewer than ``least`` such tables are left out.
    """
    given = cells.select("document_id", "place", "row", "col", text.text_of("content").alias("content"))
    said = given.withColumn("t", plain(F.trim("content"))).where((F.length("t") >= 3) & ~F.col("t").rlike(r"\d") & ~F.col("t").rlike(FIELD_LABEL))
    once = said.groupBy("document_id", "place", "t").agg(F.min(F.struct("row", "col")).alias("at"))
    votes = once.groupBy("document_id", "t").agg(F.sum(F.when(F.col("at.row") == 0, 3).otherwise(1)).alias("n"), F.min(F.struct("place", "at")).alias("first"))
    best = votes.groupBy("document_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "t")).alias("b")).select("document_id", (-F.col("b.n")).alias("votes"), F.col("b.t").alias("t"))
    w = Window.partitionBy("document_id", "place", "row").orderBy("col")
    after = given.withColumn("next", F.lead("content").over(w)).where(F.col("content").rlike(PLANT_LABEL)).withColumn("u", plain(F.trim("next")))
    units = after.where((F.col("u") != "") & (F.lower("u") != F.lower(F.trim("content")))).groupBy("document_id", "u").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("place", "row", "col")).alias("first"))
    unit = units.groupBy("document_id").agg(F.substring(F.min(F.struct((-F.col("n")).alias("n"), "first", "u"))["u"], 1, 100).alias("unit"))
    tables = given.groupBy("document_id").agg(F.countDistinct("place").alias("n_tables")).where(F.col("n_tables") >= least)
    out = tables.join(best, "document_id", "left").join(unit, "document_id", "left")
    shown = F.when((F.col("t") == F.upper("t")) & (F.col("t") != F.lower("t")), text.title_case("t")).otherwise(F.col("t"))
    return out.select("document_id", F.when(F.col("votes") * 2 >= F.col("n_tables"), shown).alias("title"), "unit", "n_tables")


def conventions(elements: DataFrame, pages: int = 30, least: int = 2, examples: int = 5) -> DataFrame:
    """STC16: (document_id, kind, n, examples): letters of equipment tags found ``least`` times or more on the first ``pages`` pages, with the first examples by name."""
    tags = elements.where(F.col("page") <= pages).select("document_id", F.explode(F.regexp_extract_all(text.text_of("content"), F.lit(EQUIPMENT_TAG), F.lit(0))).alias("tag"))
    counted = tags.groupBy("document_id", F.substring("tag", 1, 1).alias("kind"), "tag").agg(F.count(F.lit(1)).alias("hits"))
    total = counted.groupBy("document_id", "kind").agg(F.sum("hits").alias("n")).where(F.col("n") >= least)
    some = first_items(counted.select("document_id", "kind", "tag"), ["document_id", "kind"], "tag", [], examples).select("document_id", "kind", F.col("items").alias("examples"))
    return total.join(some, ["document_id", "kind"])


def profile(elements: DataFrame, header_cells: DataFrame) -> DataFrame:
    """STC16: (document_id, title, document_type, unit): the voted title of page heads replaces an empty one and one that names a section or chapter."""
    own, voted = document_types(elements), header_votes(header_cells).select("document_id", F.col("title").alias("__voted"), "unit")
    weak = (F.col("title") == "") | F.upper("title").startswith("SECTION") | F.upper("title").startswith("CHAPTER")
    return own.join(voted, "document_id", "left").select("document_id", F.when(weak & F.col("__voted").isNotNull(), F.col("__voted")).otherwise(F.col("title")).alias("title"), "document_type", "unit")


def chapter_id(document: Column | str, number: Column | str) -> Column:
    return F.concat(document, F.lit("#ch"), F.col(number).cast("string") if isinstance(number, str) else number.cast("string"))


def step_id(sequence: str) -> Column:
    number = F.col(sequence).cast("string")
    return F.concat("procedure_id", F.lit("#s"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))


def document_edges(chapters: DataFrame, sections: DataFrame, procedures: DataFrame, steps: DataFrame, references: DataFrame, instructions: DataFrame) -> DataFrame:
    """SRC16: (source_id, edge, target_id): the edges that documents ask for, each once, whether or not their ends exist.

    ``chapters``: document_id, number. ``sections``: document_id, section_id, path, number, chapter_number, parent_section_id, place.
    ``procedures``: document_id, procedure_id, section_id. ``steps``: procedure_id, sequence. ``references``: document_id,
    source_path, target_kind, target_number. ``instructions``: document_id, number, chapter.

    A reference leaves the last section of its path; it goes to the first section of its target number in the same
    document, or, if there is none or a chapter is asked for, to the chapter that the number begins with. A path without a section gives an edge without a source.
    """
    edge = lambda df, a, name, b: df.select(a.alias("source_id"), F.lit(name).alias("edge"), b.alias("target_id"))
    c = F.col
    paths = sections.groupBy("document_id", c("path").alias("source_path")).agg(F.max(F.struct("place", "section_id"))["section_id"].alias("source_id"))
    numbers = sections.where("number <> ''").groupBy("document_id", c("number").alias("target_number")).agg(F.min(F.struct("place", "section_id"))["section_id"].alias("section"))
    asked = references.select("document_id", "source_path", "target_kind", "target_number").distinct().join(paths, ["document_id", "source_path"], "left").join(numbers, ["document_id", "target_number"], "left")
    target = F.coalesce(F.when(F.col("target_kind").eqNullSafe("chapter"), None).otherwise(F.col("section")), chapter_id("document_id", F.split_part("target_number", F.lit("."), F.lit(1))))
    step = step_id("sequence")
    chain = steps.select("procedure_id", "sequence").distinct().withColumn("next", F.lead("sequence").over(Window.partitionBy("procedure_id").orderBy("sequence")))
    item = F.concat("document_id", F.lit("#si:"), "number")
    parts = [
        edge(chapters, c("document_id"), "HAS_CHAPTER", chapter_id("document_id", "number")),
        edge(sections.where("parent_section_id is null and chapter_number is not null"), chapter_id("document_id", "chapter_number"), "HAS_SECTION", c("section_id")),
        edge(sections.where("parent_section_id is not null"), c("parent_section_id"), "HAS_SUBSECTION", c("section_id")),
        edge(procedures, c("document_id"), "HAS_PROCEDURE", c("procedure_id")), edge(procedures.where("section_id is not null"), c("procedure_id"), "IN_SECTION", c("section_id")),
        edge(steps, c("procedure_id"), "HAS_STEP", step), edge(chain.where("next is not null"), step, "NEXT", step_id("next")),
        edge(asked, c("source_id"), "REFERENCES", target),
        edge(instructions, c("document_id"), "HAS_STANDING_INSTRUCTION", item), edge(instructions.where("chapter <> ''"), item, "INCORPORATED_IN", chapter_id("document_id", "chapter")),
    ]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole.distinct()


def document_nodes(documents: DataFrame, chapters: DataFrame, sections: DataFrame, procedures: DataFrame, steps: DataFrame, instructions: DataFrame) -> DataFrame:
    """SRC16: (node_id, kind), each once."""
    node = lambda df, kind, c: df.select(c.alias("node_id"), F.lit(kind).alias("kind"))
    parts = [
        node(documents, "Document", F.col("document_id")), node(chapters, "Chapter", chapter_id("document_id", "number")), node(sections, "Section", F.col("section_id")), node(procedures, "Procedure", F.col("procedure_id")),
        node(steps, "ProcedureStep", step_id("sequence")), node(instructions, "StandingInstruction", F.concat("document_id", F.lit("#si:"), "number")),
    ]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole.where("node_id is not null").distinct()


def held_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """SRC15: ``edges`` (source_id, edge, target_id) with ``held``: both ends exist, and they are not one node joined with itself by a reference. The others are dangling."""
    known = nodes.select("node_id").distinct()
    ends = edges.join(known.select(F.col("node_id").alias("source_id"), F.lit(True).alias("__s")), "source_id", "left").join(known.select(F.col("node_id").alias("target_id"), F.lit(True).alias("__t")), "target_id", "left")
    loop = (F.col("edge") == "REFERENCES") & (F.col("source_id") == F.col("target_id"))
    return ends.select("source_id", "edge", "target_id", (F.col("__s").isNotNull() & F.col("__t").isNotNull() & ~F.coalesce(loop, F.lit(False))).alias("held"))
