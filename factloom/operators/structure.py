"""Order-dependent document structure as window expressions, and as folds where no window can say it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import ordered_fold


def html_elements(pages: DataFrame) -> DataFrame:
    """SRC3: (page_id, position, element_type, content) of headings, paragraphs and list items, in order, without furniture."""
    stripped = F.regexp_replace("html", r"(?is)<(script|style|nav|footer|aside|header)\b.*?</\1>|<!--.*?-->", " ")
    parts = F.regexp_extract_all(stripped, F.lit(r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)(?=<(?:h[1-6]|p|li|/p|/li|/h[1-6]|/ul|/ol|/body|/div)\b|$)"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(parts).alias("position", "raw"))
    return rows.select("page_id", "position", F.lower(F.regexp_extract("raw", r"^<(\w+)", 1)).alias("element_type"), F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " ")).alias("content")).where("content <> ''")


def heading_paths(elements: DataFrame, doc: str, order: str, level: str, title: str, deepest: int = 6) -> DataFrame:
    """STC3: each row's section path. A heading of level d ends all deeper ones: the title in force at depth d is the last
    of that depth since the last heading above it. One window a depth, no fold."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out, since = elements, F.lit(-1)
    for d in range(1, deepest + 1):
        at = F.when(F.col(level) == d, F.col(order))
        out = out.withColumn(f"__at{d}", F.coalesce(F.last(at, True).over(w), F.lit(-1))).withColumn(f"__t{d}", F.last(F.when(F.col(level) == d, F.col(title)), True).over(w))
        out = out.withColumn(f"__above{d}", since)
        since = F.greatest(since, F.col(f"__at{d}"))
    path = F.array_compact(F.array(*[F.when((F.col(f"__at{d}") >= 0) & (F.col(f"__at{d}") >= F.col(f"__above{d}")), F.col(f"__t{d}")) for d in range(1, deepest + 1)]))
    return out.withColumn("section_path", F.array_join(path, " > ")).drop(*[f"__{n}{d}" for d in range(1, deepest + 1) for n in ("at", "t", "above")])


def runs(rows: DataFrame, by: list[str], order: list[str], breaks) -> DataFrame:
    """STC5: gaps and islands: ``run`` numbers the stretches between rows where ``breaks`` holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("run", F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def propagate_merged(cells: DataFrame) -> DataFrame:
    """STC12: cells (table_id, row, col, rowspan, colspan, content) filled into the empty places that they span; real cells win."""
    own = cells.select("table_id", "row", "col", "content", F.lit(0).alias("copied"))
    spans = cells.where("rowspan > 1 or colspan > 1")
    spread = spans.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1))).withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)))
    filled = spread.select("table_id", F.col("r").alias("row"), F.col("c").alias("col"), "content", F.lit(1).alias("copied"))
    return own.unionByName(filled).groupBy("table_id", "row", "col").agg(F.min_by("content", F.struct("copied", "content")).alias("content"), F.min("copied").alias("copied"))


def pack(rows: DataFrame, doc: str, order: str, tokens: str, budget: int) -> DataFrame:
    """STC18: chunk numbers by greedy filling: a row that would pass the budget opens the next chunk. A document streams through one task."""

    def step(state: dict, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n in part[tokens]:
            if state["used"] and state["used"] + n > budget:
                state["chunk"], state["used"] = state["chunk"] + 1, 0
            state["used"] += n
            out.append(state["chunk"])
        return part.assign(chunk=out)

    return ordered_fold(rows, doc, [order], "chunk long", lambda: {"chunk": 0, "used": 0}, step)


def chunk_elements(elements: DataFrame, doc: str, order: str, target: int = 800, most: int = 1200) -> DataFrame:
    """STC19: ``elements`` with ``chunk`` (from 0), whether the element ``moved`` on with a procedure, and the ``chunk_heading`` and ``chunk_path`` in force at it.

    Columns used: is_heading, level (null: 2), procedure, step, table (null: none), title, path, parent_heading, tokens (null: 0). A chunk ends
    before: a heading of level 1 or 2, or a deeper one once it holds half of ``target``, unless it is made of headings alone; a
    procedure's label (step 0), or its first step without one, once it holds a quarter, a heading right before going with
    the procedure; an element that would pass ``most``, unless that cuts a table or a procedure, which are cut only beyond twice
    as much. In force is the last heading's title and path; a chunk that opens without one has its first element's path and parent heading.

    One ordered pass a document: a window tells each element whether it, and the next, starts a procedure, so nothing read
    has to be taken back; then a fold keeps the open chunk's size and last element, whatever the document's length.
    """
    w = Window.partitionBy(doc).orderBy(order)
    first_step = (F.col("step") == 1) & ~F.coalesce(F.lag("procedure").over(w) == F.col("procedure"), F.lit(False))
    starts = F.coalesce(F.col("procedure").isNotNull() & ((F.col("step") == 0) | first_step), F.lit(False))
    told = elements.withColumn("__starts", starts).withColumn("__next", F.coalesce(F.lead("__starts").over(w), F.lit(False)))
    names = ["is_heading", "level", "procedure", "table", "title", "path", "parent_heading", "tokens", "__starts", "__next"]

    def step(s: dict, part: pd.DataFrame) -> pd.DataFrame:
        clean = part[names].astype(object)
        out = []
        for heading, level, procedure, table, title, path, parent, tokens, begins, before in clean.where(clean.notna(), None).itertuples(index=False, name=None):
            tokens, heading, moved = tokens or 0, bool(heading), False
            ends = heading and s["body"] and ((level or 2) <= 2 or s["used"] >= target * 0.5)
            ends = ends or (begins and s["count"] > 0 and s["used"] >= target * 0.25 and not s["carried"])
            whole = (s["table"] is not None and s["table"] == table) or (s["procedure"] is not None and s["procedure"] == procedure)
            ends = ends or (s["count"] > 0 and s["used"] + tokens > most and (not whole or s["used"] + tokens > 2 * most))
            s["carried"] = False
            if ends:
                s.update(chunk=s["chunk"] + 1, used=0, count=0, body=False)
            if heading:
                s.update(heading=title, path=path)
                if before and s["count"] and s["used"] + tokens >= target * 0.25:
                    moved = True
                    s.update(chunk=s["chunk"] + 1, used=0, count=0, body=False, carried=True)
            elif not s["count"]:
                s.update(heading=parent or s["heading"], path=path)
            s.update(used=s["used"] + tokens, count=s["count"] + 1, body=s["body"] or not heading, table=table, procedure=procedure)
            out.append((s["chunk"], moved, s["heading"], s["path"]))
        chunk, moved, heading, path = zip(*out)
        return part.assign(chunk=chunk, moved=moved, chunk_heading=heading, chunk_path=path)

    new = lambda: {"chunk": 0, "used": 0, "count": 0, "body": False, "carried": False, "table": None, "procedure": None, "heading": "", "path": ""}
    return ordered_fold(told, doc, [order], "chunk long, moved boolean, chunk_heading string, chunk_path string", new, step).drop("__starts", "__next")


def chunks(placed: DataFrame, doc: str, order: str, page: str | None = None) -> DataFrame:
    """STC19: a row a chunk of ``chunk_elements``: its ``heading`` and ``path``, number of elements, tokens, first and last of ``page``, tables and procedures.

    A heading that moves on with a procedure has already named the chunk that it leaves.
    """
    last = F.struct(F.col(order).alias("at"), F.col("chunk_heading").alias("heading"), F.col("chunk_path").alias("path"))
    first = F.min(F.struct(F.col(order).alias("at"), "moved", F.col("title").alias("heading"), "path"))
    pages = [F.min(page).alias("page_start"), F.max(page).alias("page_end")] if page else []
    made = placed.groupBy(doc, "chunk").agg(
        F.max(last).alias("__last"), first.alias("__first"), F.count(F.lit(1)).alias("n_elements"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), *pages,
        F.array_sort(F.collect_set("table")).alias("tables"), F.array_sort(F.collect_set("procedure")).alias("procedures"))
    after = F.lead("__first").over(Window.partitionBy(doc).orderBy("chunk"))
    named = made.withColumn("__next", after).withColumn("__named", F.when(F.col("__next.moved"), F.struct(F.col("__next.heading").alias("heading"), F.col("__next.path").alias("path"))).otherwise(F.struct("__last.heading", "__last.path")))
    return named.withColumn("heading", F.col("__named.heading")).withColumn("path", F.col("__named.path")).drop("__last", "__first", "__next", "__named")


def reading_order(lines: DataFrame, page: str, ties: list[str]) -> DataFrame:
    """STR37: ``place`` of text lines (x, y, h) on a page: bands of rows a gap of max(4, 0.6 of the median height) apart, then from the left."""
    gaps = lines.groupBy(page).agg(F.greatest(F.lit(4.0), 0.6 * F.median("h")).alias("__gap"))
    w = Window.partitionBy(page).orderBy("y", "x", *ties)
    marked = lines.join(gaps, page).withColumn("__new", F.when(F.col("y") - F.lag("y").over(w) <= F.col("__gap"), 0).otherwise(1))
    banded = marked.withColumn("__band", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return banded.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("__band", "x", "y", *ties))).drop("__gap", "__new", "__band")
