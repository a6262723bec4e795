"""Tables and chunks: signatures, repeated tables and rows, column types, kinds of content."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.tags import is_tag, parse_tag
from .elements import APPROVAL
from .folds import ordered_fold
from .graph import settle
from .joins import few

# Content types of element types; openings that override them.
CONTENT_TYPES = {"heading": "heading", "text": "paragraph", "list_item": "list_item", "table": "table", "equation": "equation", "caption": "figure_caption", "figure": "figure_caption"}
OPENINGS = (("WARNING:", "warning"), ("WARNING -", "warning"), ("⚠", "warning"), ("CAUTION:", "caution"), ("CAUTION -", "caution"), ("NOTE:", "note"), ("NOTE -", "note"), ("N.B.", "note"), ("SAFETY:", "safety_note"), ("SAFETY NOTE", "safety_note"))
# Words of a title that need no capital.
SMALL_WORDS = ("of", "for", "and", "the", "at", "in", "on", "to", "with", "without", "a", "an", "by", "from", "or", "per", "vs", "&", "/", "-", "crude", "operation", "case", "mode", "production", "feed")


def content_type(element_type: Column | str, content: Column | str) -> Column:
    """FLT2: the content type of an element; a text that opens as a warning, caution, note or safety note is that."""
    kind, t = text.text_of(element_type), F.upper(F.trim(text.text_of(content)))
    out = None
    for opening, meaning in OPENINGS:
        out = F.when(t.startswith(opening), meaning) if out is None else out.when(t.startswith(opening), meaning)
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for p in CONTENT_TYPES.items() for x in p]), kind)
    return out.otherwise(F.coalesce(mapped, F.lit("paragraph")))


def is_approval(content: Column | str, rows: Column) -> Column:
    """FLT6: a short table with two or more words of approval."""
    t = text.text_of(content)
    return (F.size(F.regexp_extract_all(t, F.lit(APPROVAL), F.lit(0))) >= 2) & (rows <= 8) & (F.length(t) < 400)


def is_label(c: Column | str) -> Column:
    """FLT9: title-like: at most 120 characters and 18 words, half of the significant words with a capital."""
    t = F.trim(text.text_of(c))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    big = F.filter(words, lambda w: ~F.lower(w).isin(*SMALL_WORDS) & w.rlike("[A-Za-z]"))
    capital = F.filter(big, lambda w: w.rlike("^[^a-z]*[A-Z]"))
    return (t != "") & (F.length(t) <= 120) & (F.size(words) <= 18) & (F.size(big) > 0) & (F.size(capital) * 2 >= F.size(big))


def signatures(tables: DataFrame) -> DataFrame:
    """STC11: ``signature`` (the sorted normal forms of the headers), ``shape_hash`` (with the shape), and ``duplicate_of``, the first table of the document's order that has the same shape hash.

    ``tables``: table_id, ord, headers array<string>, num_rows, num_cols. The first is found by an aggregate and joined, so a shape that most tables share is no sorted group.
    """
    normal = F.transform("headers", lambda h: F.regexp_replace(F.trim(F.lower(h)), r"\s+", " "))
    made = tables.withColumn("signature", F.array_join(F.array_sort(F.filter(normal, lambda h: h != "")), "|"))
    made = made.withColumn("shape_hash", F.substring(F.md5(F.concat_ws("|", F.col("num_rows").cast("string"), F.col("num_cols").cast("string"), F.array_join(F.array_sort(normal), "|"))), 1, 16))
    first = made.groupBy("shape_hash").agg(F.min(F.struct("ord", "table_id"))["table_id"].alias("__first"))
    return made.join(first, "shape_hash").withColumn("duplicate_of", F.when(F.col("__first") != F.col("table_id"), F.col("__first"))).drop("__first")


def column_types(cells: DataFrame) -> DataFrame:
    """STC13: (table_id, col, data_type) from cells (table_id, row, col, content): numeric if all samples are, tag if all filled ones are, else text; empty samples are not numeric."""
    c = F.trim(text.text_of("content"))
    tagged = c.rlike(r"^\S+$") & is_tag(c)
    flags = cells.groupBy("table_id", "col").agg(F.min(text.is_numeric_like(c)).alias("numeric"), F.min(F.when(c != "", tagged)).alias("tag"))
    return flags.select("table_id", "col", F.when(F.col("numeric"), "numeric").when(F.coalesce("tag", F.lit(True)), "tag").otherwise("text").alias("data_type"))


def drop_repeated_rows(cells: DataFrame) -> DataFrame:
    """STC13: the cells without rows that repeat an earlier row of their table, cell by cell. A row is gathered once, and its cells go with it."""
    others = [c for c in cells.columns if c not in ("table_id", "row")]
    rows = cells.where("table_id is not null and row is not null").groupBy("table_id", "row").agg(F.collect_list(F.struct(*others)).alias("__cells"))
    said = F.array_sort(F.transform("__cells", lambda x: F.concat_ws(":", x["col"].cast("string"), F.trim(text.text_of(x["content"])))))
    kept = rows.withColumn("__sig", said).withColumn("__first", F.min("row").over(Window.partitionBy("table_id", "__sig"))).where("row = __first")
    return kept.select("table_id", "row", F.explode("__cells").alias("__x")).select(*[c if c in ("table_id", "row") else F.col(f"__x.{c}").alias(c) for c in cells.columns])


def chunk_type(chunks: DataFrame) -> DataFrame:
    """STC20: ``chunk_type`` of chunks (is_engineering, tokens, procedure_tokens, table_tokens, n_spec_pairs, section_path): the first rule that holds."""
    path = F.lower(text.text_of("section_path"))
    share = lambda c: F.col(c) / F.greatest("tokens", F.lit(1))
    return chunks.withColumn("chunk_type", (
        F.when(~F.col("is_engineering"), "document_control").when(share("procedure_tokens") >= 0.4, "procedure").when(share("table_tokens") >= 0.5, "table").when(F.col("n_spec_pairs") >= 3, "specification")
        .when(path.rlike("upset|troubleshoot|deviation"), "upset").when(path.rlike("safety|hazard|emergency"), "safety").when(path.rlike("control|interlock|instrument"), "control").when(path.rlike("equipment|pump|column|heater"), "equipment").otherwise("narrative")
    ))


def overlap_bridge(chunks: DataFrame, by: str, order: str, n: int = 2) -> DataFrame:
    """STC21: ``bridge``, the last n sentences of the chunk before, and ``retrieval_text``: path, bridge and text. The chunk's own text stays as it is."""
    w = Window.partitionBy(by).orderBy(order)
    tail = F.coalesce(F.lag("__tail").over(w), F.lit(""))
    told = chunks.withColumn("__tail", text.last_sentences("text", n)).withColumn("bridge", tail).drop("__tail")
    return told.withColumn("retrieval_text", F.array_join(F.filter(F.array(text.text_of("section_path"), F.col("bridge"), text.text_of("text")), lambda x: x != ""), "\n"))


def contents(rows: DataFrame, last_page: int = 9999) -> DataFrame:
    """STC1: (document_id, number, title, page_start, page_end) from contents rows (document_id, number, title, page): the first row of a chapter, up to the page before the next one's."""
    cleaned = F.trim(F.regexp_replace("title", r"\s*\.{3,}\s*\d*\s*$", ""))
    first = rows.groupBy("document_id", "number").agg(F.min(F.struct("page", cleaned.alias("title"))).alias("x")).select("document_id", "number", "x.title", F.col("x.page").alias("page_start"))
    after = F.lead("page_start").over(Window.partitionBy("document_id").orderBy("number"))
    return first.withColumn("page_end", F.coalesce(after - 1, F.lit(last_page)))


def chapter_pages(pages: DataFrame, ranges: DataFrame, bin_size: int = 4_096, most_bins: int = 1_024) -> DataFrame:
    """STC2, JOI7: (document_id, page, chapter): of the ranges (document_id, chapter, first_page, last_page, priority) that hold a page, the one of lowest priority number, then chapter.

    An ordered pass over a document's ranges cuts it into stretches that each have one chapter; there are at most twice as
    many as ranges, and they do not overlap. Only these are listed by the bins that they touch, of ``bin_size`` pages or so wide that a
    document has ``most_bins``, and pages meet them by document and bin: neither long ranges nor many over one page add rows.
    """
    best = Window.partitionBy("document_id").orderBy("priority", "chapter")
    placed = settle(ranges.where("first_page <= last_page and document_id is not null").withColumn("__r", F.row_number().over(best)))
    opens = placed.select("document_id", F.col("first_page").cast("long").alias("at"), F.col("last_page").cast("long").alias("last"), F.col("__r").cast("long").alias("r"))
    ends = opens.groupBy("document_id").agg((F.max("last") + 1).alias("at"), (F.max("last") + 1).alias("last"), F.lit(0).cast("long").alias("r"))

    def step(s: dict, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for document, at, last, r in part[["document_id", "at", "last", "r"]].itertuples(index=False, name=None):
            while s["open"] and s["from"] < at:
                own, until = s["open"][0]
                if until < s["from"]:
                    heapq.heappop(s["open"])
                    continue
                out.append((document, s["from"], min(until, at - 1), own))
                s["from"] = out[-1][2] + 1
            s["from"] = at
            heapq.heappush(s["open"], (r, last))
        return pd.DataFrame(out, columns=["document_id", "lo", "hi", "r"])

    kind = ranges.schema["document_id"].dataType.simpleString()
    stretches = ordered_fold(opens.unionByName(ends), "document_id", ["at", "r"], "", lambda: {"open": [], "from": 0}, step, f"document_id {kind}, lo long, hi long, r long")
    whole = Window.partitionBy("document_id")
    width = F.greatest(F.lit(bin_size), F.ceil((F.max("hi").over(whole) - F.min("lo").over(whole) + 1) / most_bins))
    named = settle(stretches.join(placed.select("document_id", F.col("__r").cast("long").alias("r"), "chapter"), ["document_id", "r"]).drop("r").withColumn("__w", width))
    bins = settle(named.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("lo") / F.col("__w")), F.floor(F.col("hi") / F.col("__w"))))).drop("__w"))
    asked = pages.select("document_id", "page").distinct().join(few(named.select("document_id", "__w").distinct()), "document_id").withColumn("__bin", F.floor(F.col("page") / F.col("__w")))
    return asked.join(few(bins), ["document_id", "__bin"]).where(F.col("page").between(F.col("lo"), F.col("hi"))).select("document_id", "page", "chapter")


def section_ends(headings: DataFrame, last_page: int, deepest: int = 6) -> DataFrame:
    """STC4: ``page_end`` of sections (document_id, ord, level, page): the page before the next heading that is no deeper, never before the start; ``last_page`` without one."""
    after = Window.partitionBy("document_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)  # from the end, so a frame only grows
    out = None
    for level in range(1, deepest + 1):
        nxt = F.last(F.when(F.col("level") <= level, F.col("page")), ignorenulls=True).over(after)
        out = F.when(F.col("level") == level, nxt) if out is None else out.when(F.col("level") == level, nxt)
    return headings.withColumn("page_end", F.greatest(F.col("page"), F.coalesce(out - 1, F.lit(last_page))))


def equipment_columns(cells: DataFrame) -> DataFrame:
    """EXT9: (table_id, tag, description) of tables that list equipment: the column with most tags (at least 2, and a third of the rows) and the one named so by its header, else the most varied.

    ``cells``: table_id, row, col, content, is_header. Columns are chosen by aggregates; then both are joined by row.
    """
    c = F.trim(text.text_of("content"))
    body = cells.where("not is_header and col is not null").select("table_id", "row", "col", c.alias("c"))
    stats = body.groupBy("table_id", "col").agg(F.count(F.lit(1)).alias("n"), F.sum(parse_tag("c").isNotNull().cast("long")).alias("tags"), F.countDistinct("c").alias("kinds"), F.sum((F.length("c") >= 4).cast("long")).alias("long"))
    tag = stats.where((F.col("tags") >= 2) & (F.col("tags") * 3 >= F.col("n"))).groupBy("table_id").agg(F.max(F.struct(F.col("tags").alias("a"), (-F.col("col")).alias("b")))["b"].alias("__neg"))
    tag = tag.select("table_id", (-F.col("__neg")).alias("tag_col"))
    heads = cells.where("is_header").groupBy("table_id", "col").agg(F.max(F.lower(c).rlike("descr|service|name|equipment|item|duty|function")).alias("named"))
    rest = stats.join(tag, "table_id").where("col <> tag_col").join(heads, ["table_id", "col"], "left")
    fits = rest.where(F.coalesce("named", F.lit(False)) | (F.col("kinds") >= F.col("n") * 0.6))
    told = fits.groupBy("table_id", "tag_col").agg(F.max(F.struct(F.coalesce("named", F.lit(False)).alias("a"), F.col("kinds").alias("b"), (-F.col("col")).alias("c")))["c"].alias("__neg")).select("table_id", "tag_col", (-F.col("__neg")).alias("text_col"))
    left = body.join(told, "table_id").where("col = tag_col").select("table_id", "row", parse_tag("c")["canonical"].alias("tag")).where("tag is not null")
    right = body.join(told, "table_id").where("col = text_col").select("table_id", "row", F.col("c").alias("description"))
    return left.join(right, ["table_id", "row"]).select("table_id", "tag", "description").where("description <> ''").distinct()
