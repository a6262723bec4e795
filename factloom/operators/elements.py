"""Parsed elements and tables: what to keep, what kind of table, what they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.tags import find_tags
from .graph import settle
from .joins import BROADCAST_KEYS

# First words of instructions, and adverbs that may stand before one.
IMPERATIVE_VERBS = (
    "ensure check open close start stop take isolate drain commission charge line inform confirm switch place increase reduce maintain keep verify remove install put bring adjust "
    "monitor record observe stabilize stabilise establish cut shut trip reset purge flush vent bleed box blind deblind de-blind connect disconnect raise lower fill empty depressurize "
    "depressurise pressurize pressurise warm cool light fire back release divert route run operate engage disengage allow wait hold continue proceed collect transfer throttle crack "
    "note never do avoid use wear obtain get make replace tighten loosen follow refer carry apply prepare arrange hand provide give attend inspect test clean lubricate energize "
    "energise de-energize normalize normalise regulate set hook blow steam circulate build pull push restore resume lift position seal tag lock clear complete review watch sample "
    "analyze analyse introduce withdraw display"
).split()
LEAD_ADVERBS = "slowly gradually then first finally initially immediately now also simultaneously carefully always do don't please".split()
# Patterns of placeholders, headings, approvals, contents, steps, labels.
PLACEHOLDER = r"(?i)^\s*\[(?:figure|image|picture)\b[^\]]*\]\s*$"
NUMBERED = r"^\s*(\d+(?:\.\d+)*)\.?\s+\S"
CHAPTER = r"(?i)^\s*(?:CHAPTER|SECTION|PART|APPENDIX|ANNEXURE)\b"
APPROVAL = r"(?i)\b(?:approved\s+by|prepared\s+by|checked\s+by|reviewed\s+by|verified\s+by|certified\s+by|signature|sign\b|designation)"
CONTENTS = r"(?is)\bchapter\b.*\btitle\b.*\bpage\b|\bcontents\b.*\bpage\b"
STEP_MARKER = r"(?i)^\s*(?:\(?\d{1,2}[.)]|\(?[a-z][.)]|\(?[ivx]{1,4}[.)]|[-•▪■●○◦¾*✓✔Øø‣⁃>]|9\s)\s*"
LABEL_END = r":\s*(?:\([^)]*\))?\s*$"
PROCEDURE_WORD = r"(?i)procedure|start\s*-?\s*up|shut\s*-?\s*down|commission|change\s*-?\s*over|check\s*-?\s*list|emergency|isolation|\bsteps\b|activities|\bactions\b|precaution|preparation|sequence"
CROSS_REFERENCE = r"(?i)\b(Chapter|Section|Annexure|Appendix)\s*[-–:]?\s*(\d{1,3}(?:\.\d{1,3})*)\b(?!\s*of\s+\d)"
STANDARD = r"(?i)\b((?:IS|OISD|IBR|ASME|ANSI|NFPA)\s*[-:]?\s*(?:STD\s*[-:]?\s*)?[A-Z]?\d{2,5}(?!\d)(?:\s*-\s*\d{1,4})?|(?:ASTM|API)\s*[-:]?\s*[A-Z]?\s*-?\s*\d{2,5}(?!\d)(?:\s*-\s*\d{1,4})?)"
UNIT_WORD = r"(?i)\b(?:kg/cm2|kg/hr|kg/h|m3/hr|m3/h|°c|bar|psi|mmhg|rpm|kw|ppm|wt%|vol%)"
TAG_WORD = r"\b\d{1,3}-[A-Z]{1,4}-\d{1,5}[A-Z]?\b"


def is_imperative(c: Column | str) -> Column:
    """FLT7: whether a line, after its list marker, opens with an instruction's verb, or an adverb before one."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(F.trim(text.text_of(c)), STEP_MARKER, "")), F.lit(r"[a-z][a-z'\-]*"), F.lit(0))
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    return F.coalesce(first.isin(IMPERATIVE_VERBS) | (first.isin(LEAD_ADVERBS) & second.isin(IMPERATIVE_VERBS)), F.lit(False))


def is_procedure_label(c: Column | str) -> Column:
    """FLT8: a short line that introduces a procedure."""
    t = F.trim(text.text_of(c))
    return (t != "") & (F.length(t) <= 120) & ~t.contains(" | ") & (t.rlike(LABEL_END) | (t.rlike(PROCEDURE_WORD) & (F.size(text.words(t)) <= 14)))


def heading_level(content: Column | str, parser_level: Column | None = None) -> Column:
    """STR33: from dotted numbering (at most 6), a chapter word (1), or the parser (2 without it)."""
    t = F.trim(text.text_of(content))
    number = F.regexp_extract(t, NUMBERED, 1)
    return F.when(number != "", F.least(F.size(F.split(number, r"\.")), F.lit(6))).when(t.rlike(CHAPTER), 1).otherwise(F.coalesce(parser_level, F.lit(2)) if parser_level is not None else 2)


def repeated_hashes(elements: DataFrame, share: float = 0.6) -> DataFrame:
    """FLT3: (document_id, hash) of contents of three characters or more that are on at least ``share`` of the pages."""
    pages = elements.groupBy("document_id").agg(F.countDistinct("page").alias("pages"))
    seen = elements.where(F.length(F.trim("content")) >= 3).groupBy("document_id", text.content_hash("content").alias("hash")).agg(F.countDistinct("page").alias("on"))
    return seen.join(pages, "document_id").where(F.col("on") >= F.col("pages") * share).select("document_id", "hash")


def running_titles(elements: DataFrame, chapters: DataFrame | None = None, least: int = 3, capitals: int = 5) -> DataFrame:
    """FLT4: (document_id, key) of headings printed page after page: chapter titles on ``least`` pages, or capitals on ``capitals``.

    ``chapters``: document_id, title. A heading is a chapter's title if either holds the other's words in a row, three at least.
    """
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim("content")), r"\s+", " "), "^[ :.-]+|[ :.-]+$", "")
    heads = elements.where("element_type = 'heading'").select("document_id", "page", key.alias("key"), (F.upper("content") == F.col("content")).alias("upper"))
    seen = heads.where(F.length("key") >= 8).groupBy("document_id", "key").agg(F.countDistinct("page").alias("n"), F.min("upper").alias("upper"))
    loud = seen.where((F.col("n") >= capitals) & F.col("upper") & (F.size(F.split("key", " ")) >= 2)).select("document_id", "key")
    if chapters is None:
        return loud
    titles = chapters.select(F.col("document_id").alias("__d"), F.lower(F.trim("title")).alias("__t"))
    within = ((F.size(F.split("key", " ")) >= 3) & F.col("__t").contains(F.col("key"))) | ((F.size(F.split("__t", " ")) >= 3) & F.col("key").contains(F.col("__t"))) | (F.col("key") == F.col("__t"))
    known = seen.where(F.col("n") >= least).join(titles, (F.col("document_id") == F.col("__d")) & within, "left_semi").select("document_id", "key")
    return loud.unionByName(known).distinct()


def template_tables(cells: DataFrame, total_pages: DataFrame, page_share: float = 0.5, cell_share: float = 0.6) -> DataFrame:
    """FLT5: (document_id, table_id) of page furniture: small tables whose cells, digits as #, mostly recur on half of the pages.

    Cells are counted by table, page and token first and written once, so a document's tokens meet its common ones as counts, not cell by cell.
    """
    token = F.regexp_replace(F.regexp_replace(F.lower(F.trim("content")), "[0-9]", "#"), r"\s+", " ")
    tokens = cells.select("document_id", "table_id", "page", "row", token.alias("token")).where(F.length("token") >= 2)
    counted = settle(tokens.groupBy("document_id", "table_id", "page", "token").agg(F.count(F.lit(1)).alias("cells"), F.max("row").alias("row"))).join(total_pages.where("pages >= 4"), "document_id")
    common = counted.groupBy("document_id", "token", "pages").agg(F.countDistinct("page").alias("n")).where((F.col("n") >= F.col("pages") * page_share) & (F.col("n") >= 3)).select("document_id", "token")
    lists = common.groupBy("document_id").agg(F.collect_set("token").alias("all"), F.collect_set(F.when(F.length("token") >= 6, F.col("token"))).alias("long"))
    if common.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        lists = F.broadcast(lists)
    hit = F.array_contains("all", F.col("token")) | F.exists("long", lambda x: F.contains(F.col("token"), x))
    sized = counted.join(lists, "document_id").groupBy("document_id", "table_id").agg((F.sum(F.when(hit, F.col("cells")).otherwise(0)) / F.sum("cells")).alias("share"), (F.max("row") + 1).alias("rows"))
    return sized.where((F.col("share") >= cell_share) & (F.col("rows") <= 8)).select("document_id", "table_id")


def classify_elements(elements: DataFrame, boilerplate: list[str], repeated: DataFrame | None = None, titles: DataFrame | None = None, templates: DataFrame | None = None) -> DataFrame:
    """FLT1: ``decision`` for each element, the first rule that holds. Elements: document_id, page, element_type, content, content_layer, table_id."""
    c = F.trim(text.text_of("content"))
    out = elements
    marks = []
    for k, (table, own, key) in enumerate(((repeated, text.content_hash("content"), "hash"), (titles, F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), "^[ :.-]+|[ :.-]+$", ""), "key"), (templates, F.col("table_id"), "table_id"))):
        name = f"__m{k}"
        if table is None:
            out = out.withColumn(name, F.lit(False))
        else:
            marked = table.select(F.col("document_id").alias(f"{name}d"), F.col(key).alias(f"{name}k"), F.lit(True).alias(name)).distinct()
            out = out.withColumn(f"{name}o", own).join(marked, (F.col("document_id") == F.col(f"{name}d")) & (F.col(f"{name}o") == F.col(f"{name}k")), "left").drop(f"{name}d", f"{name}k", f"{name}o")
        marks.append(F.coalesce(F.col(name), F.lit(False)))
    kind, words = F.col("element_type"), F.size(text.words(c))
    approvals = F.size(F.regexp_extract_all(c, F.lit(APPROVAL), F.lit(0)))
    plain = F.lit(False)
    for b in boilerplate:
        plain = plain | F.lower(c).contains(b)
    return out.withColumn("decision", (
        F.when(c.rlike(PLACEHOLDER) | ((kind == "figure") & (c == "")), "figure_placeholder").when(F.length(c) < 5, "empty").when(marks[2], "repeated_header")
        .when((F.col("content_layer") == "furniture") & (kind != "table"), "repeated_header").when(kind == "page_header", "repeated_header").when(kind == "page_footer", "repeated_footer")
        .when((kind == "heading") & marks[1], "running_title").when(marks[0] & (kind != "heading"), "repeated_header").when(plain & (F.length(c) < 200) & (words <= 10), "boilerplate")
        .when((F.length(c) < 300) & (approvals > words * 0.3), "approval_block").when((kind == "text") & c.rlike(r"^.{3,80}?\.{4,}\s*\d+\s*$"), "toc").otherwise("keep")
    )).drop("__m0", "__m1", "__m2")


def classify_tables(tables: DataFrame) -> DataFrame:
    """STC10: ``classification`` of tables (header, content, num_rows, num_cols, is_repeated). A rule whose first test holds
    and whose second fails gives unknown, and no later rule is tried."""
    h, c = F.lower(text.text_of("header")), text.text_of("content")
    count = lambda p: F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    has = lambda *w: h.rlike("|".join(w))
    unknown = F.lit("unknown")
    return tables.withColumn("classification", (
        F.when(F.col("is_repeated"), "header").when(h.rlike(APPROVAL) & (F.col("num_rows") <= 5), F.when(count(APPROVAL) >= 2, "approval").otherwise(unknown))
        .when(h.rlike("chapter|title|contents") & h.contains("page"), "toc").when(has("abbreviation", "acronym", "full form", "expansion", "definition"), "abbreviation")
        .when(c.rlike(TAG_WORD), F.when(count(TAG_WORD) >= 3, F.when(h.contains("instrument"), "instrument").otherwise("equipment")).otherwise(unknown))
        .when(c.rlike(UNIT_WORD), F.when(has("stream", "product", "feed", "material"), "material_balance").when(has("limit", "range", "min", "max", "normal"), "operating_limit").when(count(UNIT_WORD) >= 3, "process_data").otherwise(unknown))
        .when(c.rlike(r"(?i)\b(hazard|safety|ppe|toxic|flammab)"), "safety").when(c.rlike(r"(?i)\b(maintenance|lubricat|overhaul)"), "maintenance").when(c.rlike(r"(?i)\b(chemical|dosing|inhibitor)"), "chemical")
        .when((F.col("num_rows") <= 1) & (F.col("num_cols") <= 2), "decorative").otherwise(unknown)
    ))


def cross_references(elements: DataFrame) -> DataFrame:
    """STC7: (section_path, kind, number, page), each once: chapters and the like that a pointing phrase within 40 characters names."""
    pointed = r"(?i)(?:\b(?:refer|see|as per|given|described|incorporated|manual)\b.{0,30}?|\b(?:detailed|covered|explained|mentioned|listed|discussed)\s+in\s+|\b(?:per|in|of|under|vide)\s+)" + CROSS_REFERENCE.removeprefix("(?i)")
    at = lambda k: F.regexp_extract_all("content", F.lit(pointed), F.lit(k))
    rows = elements.where("element_type <> 'heading'").select("section_path", "page", F.explode(F.arrays_zip(at(1).alias("kind"), at(2).alias("number"))).alias("x"))
    return rows.select("section_path", F.lower("x.kind").alias("kind"), "x.number", "page").distinct()


def standards(elements: DataFrame) -> DataFrame:
    """STC8: standards that are named, normalised, with the first place of each (document_id, reading_order). A longer number is none, nor are its first five digits."""
    rows = elements.select("document_id", "reading_order", F.explode(F.regexp_extract_all("content", F.lit(STANDARD), F.lit(1))).alias("raw"))
    number = F.upper(F.regexp_replace(F.regexp_replace(F.trim("raw"), r"\s+", " "), r"\s*([-/])\s*", "$1"))
    return rows.select("document_id", "reading_order", number.alias("number")).where(F.length("number") >= 5).groupBy("document_id", "number").agg(F.min("reading_order").alias("first_at"), F.count(F.lit(1)).alias("n"))


def glossary(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """STC17: (document_id, term, meaning, source): table entries (document_id, term, meaning) beat ``ABC (Long Form)`` in texts; first per term."""
    inline = r"\b([A-Z]{2,6})\s*\(([A-Z][a-z]+(?:[ -][A-Za-z]+){1,6})\)"
    at = lambda k: F.regexp_extract_all("content", F.lit(inline), F.lit(k))
    found = texts.select("document_id", "reading_order", F.explode(F.arrays_zip(at(1).alias("t"), at(2).alias("m"))).alias("x")).select("document_id", F.col("x.t").alias("term"), F.col("x.m").alias("meaning"), F.lit(1).alias("rank"), "reading_order")
    both = entries.select("document_id", "term", "meaning", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("reading_order")).unionByName(found.withColumn("reading_order", F.col("reading_order").cast("long")))
    w = Window.partitionBy("document_id", F.upper("term")).orderBy("rank", "reading_order", "meaning")
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("document_id", "term", "meaning", F.when(F.col("rank") == 0, "table").otherwise("inline").alias("source"))


def abbreviations(cells: DataFrame) -> DataFrame:
    """STC15: (table_id, term, meaning) from columns 0 and 1 of tables, header rows left out."""
    return cells.where("not is_header and col in (0, 1)").groupBy("table_id", "row").pivot("col", [0, 1]).agg(F.first("content")).select("table_id", F.trim(F.col("0")).alias("term"), F.trim(F.col("1")).alias("meaning")).where("term <> '' and meaning <> ''")


def mention_counts(texts: DataFrame) -> DataFrame:
    """EXT8: tags mentioned in texts (document_id, content), with how often and in how many documents."""
    return texts.select("document_id", F.explode(find_tags("content")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("document_id").alias("documents"))


def repeated_lines(texts: DataFrame, by: str, key: str, of: str, least: int = 3, percent: int = 10) -> DataFrame:
    """FLT3 over texts: (by, hash, n_docs, docs) of lines that at least ``least`` texts of a source have, and ``percent`` of them."""
    lines = texts.select(by, key, F.explode(F.split(of, "\n", -1)).alias("line")).withColumn("__k", F.lower(F.trim(F.regexp_replace("line", "[\\x20\\x09-\\x0D]+", " ")))).where(F.length("__k") >= 3)
    seen = lines.groupBy(by, text.content_hash("line").alias("hash")).agg(F.countDistinct(key).alias("n_docs"))
    sizes = texts.groupBy(by).agg(F.countDistinct(key).alias("docs"))
    return seen.join(sizes, by).where((F.col("n_docs") * 100 >= F.col("docs") * percent) & (F.col("n_docs") >= least))


def profiles(elements: DataFrame, early: int = 5) -> DataFrame:
    """STC16: (document_id, title, n_headings, n_elements): the title is the first heading of level 1 on the first ``early`` pages, else the first heading."""
    heads = F.col("heading_level") > 0
    first = lambda c: F.min(F.when(c, F.struct("reading_order", "content")))["content"]
    return elements.groupBy("document_id").agg(
        F.coalesce(first((F.col("heading_level") == 1) & (F.col("page") <= early)), first(heads)).alias("title"), F.sum(heads.cast("long")).alias("n_headings"), F.count(F.lit(1)).alias("n_elements"))


def harvest(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """EXT8: of each subject that is a known tag, its mentions, pages and name. Claims are counted before they meet the entities."""
    counted = claims.groupBy("subject").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("page").alias("pages"))
    named = entities.groupBy(F.col("canonical_tag").alias("subject")).agg(F.max("name").alias("mode_name"))
    return counted.join(named, "subject")
