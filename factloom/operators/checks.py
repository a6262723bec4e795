"""Checks of parsed documents, extractions, graphs and answers, as counts and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .elements import PLACEHOLDER


def _count_if(c: Column) -> Column:
    return F.sum(c.cast("long"))


def validation_summary(issues: DataFrame, by: list[str]) -> DataFrame:
    """VAL7: how many items of each severity (OK, WARN, ERROR) by ``by``; ``passed`` where none is an ERROR."""
    count = {s: _count_if(F.col("severity") == s).alias(s.lower()) for s in ("OK", "WARN", "ERROR")}
    return issues.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *count.values()).withColumn("passed", F.col("error") == 0)


def recall_by_source(items: DataFrame, accepted: Column, weak: Column) -> DataFrame:
    """VAL8: accepted, rejected and weakly grounded items of each source."""
    return items.groupBy("source").agg(_count_if(accepted).alias("accepted_n"), _count_if(~accepted).alias("rejected_n"), _count_if(accepted & weak).alias("weak_n"))


def parse_checks(elements: DataFrame, documents: DataFrame, least_coverage: float = 0.9, empty_run: int = 3) -> DataFrame:
    """VAL9: (document_id, check, n, ok), one row a check.

    ``elements``: document_id, page, reading_order, element_type, content. ``documents``: document_id, total_pages.
    coverage: pages with content; empty_run: the longest run of pages without; order_unique, order_monotonic: places that
    repeat or go back by page; outside: elements on no page of the document; placeholder: contents that only stand for a figure.
    """
    full = elements.where(F.trim(text.text_of("content")) != "")
    pages = full.select("document_id", "page").distinct().join(documents, "document_id").where((F.col("page") >= 1) & (F.col("page") <= F.col("total_pages")))
    by_page = Window.partitionBy("document_id").orderBy("page")
    gap = F.col("page") - F.lag("page", 1, 0).over(by_page) - 1
    seen = pages.withColumn("gap", gap).groupBy("document_id").agg(F.count(F.lit(1)).alias("covered"), F.max("gap").alias("gap"), F.max("page").alias("last"))
    run = documents.join(seen, "document_id", "left").select(
        "document_id", "total_pages", F.coalesce("covered", F.lit(0)).cast("long").alias("covered"),
        F.greatest(F.coalesce("gap", F.lit(0)), F.col("total_pages") - F.coalesce("last", F.lit(0))).cast("long").alias("run"),
    )
    placed = Window.partitionBy("document_id").orderBy("reading_order", "page")
    flagged = elements.join(documents, "document_id").withColumn("back", F.col("page") < F.lag("page").over(placed)).withColumn("again", F.col("reading_order") == F.lag("reading_order").over(placed))
    flags = flagged.groupBy("document_id").agg(
        _count_if(F.coalesce("again", F.lit(False))).alias("order_unique"), _count_if(F.coalesce("back", F.lit(False))).alias("order_monotonic"),
        _count_if((F.col("page") < 1) | (F.col("page") > F.col("total_pages"))).alias("outside"), _count_if(text.text_of("content").rlike(PLACEHOLDER)).alias("placeholder"),
    )
    both = run.join(flags, "document_id", "left")
    row = lambda name, n, ok: F.struct(F.lit(name).alias("check"), n.alias("n"), ok.alias("ok"))
    none = lambda name: row(name, F.coalesce(name, F.lit(0)).cast("long"), F.coalesce(name, F.lit(0)) == 0)
    listed = F.array(
        row("coverage", F.col("covered"), F.col("covered") >= F.col("total_pages") * least_coverage), row("empty_run", F.col("run"), F.col("run") < empty_run),
        none("order_unique"), none("order_monotonic"), none("outside"), none("placeholder"),
    )
    return both.select("document_id", F.explode(listed).alias("c")).select("document_id", "c.*")


def quality_gate(chunks: DataFrame, by: str, heading_only: int = 50, longest: int = 8000) -> DataFrame:
    """VAL11: chunks by ``by`` that are no more than a heading, too long, or hold addresses."""
    t = text.text_of("text")
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("n"), _count_if(F.length(t) < heading_only).alias("heading_only"), _count_if(F.length(t) > longest).alias("over_max"), _count_if(t.contains("@")).alias("contaminated"))


def graph_integrity(relations: DataFrame, nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """VAL12: (kind, n): relations whose target is no node (uid), triples that repeat, entities without a type."""
    orphans = relations.join(nodes.select(F.col("uid").alias("target_uid")), "target_uid", "left_anti").agg(F.lit("orphan").alias("kind"), F.count(F.lit(1)).alias("n"))
    triple = ["source_uid", "rel_type", "target_uid"]
    twice = relations.groupBy(*triple).count().where("count > 1").agg(F.lit("duplicate").alias("kind"), F.count(F.lit(1)).alias("n"))
    return orphans.unionByName(twice).unionByName(entities.where("entity_type is null").agg(F.lit("null").alias("kind"), F.count(F.lit(1)).alias("n")))


def provenance(rows: DataFrame, source: str, key: str, evidence: str) -> DataFrame:
    """VAL13: ``evidence_hash`` over source, key and evidence, and whether all are there."""
    parts = [F.col(source), F.col(key).cast("string"), F.col(evidence)]
    return rows.withColumn("evidence_hash", F.md5(F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2]))).withColumn("complete", F.col(source).isNotNull() & F.col(evidence).isNotNull())


def unsupported_numbers(statement: Column | str, evidence: Column | str) -> Column:
    """VAL14: the numbers of a statement that its evidence does not state; places such as 'p. 5', 'page 5', 'step 5' and '[5' are no claims.

    Numbers compare as numbers: 1,200.0 is 1200.
    """
    plain = lambda c: F.regexp_replace(text.text_of(c), r"(?<=\d),(?=\d{3})", "")
    claimed = F.regexp_replace(plain(statement), r"(?i)(?:\bp\.|\bpage|\bstep|\[)\s*\d+(?:\.\d+)?", " ")
    return F.array_except(text.numbers(claimed), text.numbers(plain(evidence)))


def verify_answers(statements: DataFrame, evidence: DataFrame, by: str = "answer_id") -> DataFrame:
    """VAL14: per answer, the statements checked and held up, and their share.

    ``statements``: ``by``, statement_id, text, evidence_keys. ``evidence``: evidence_key, text. A statement that cites
    nothing, or nothing that is there, does not hold.
    """
    cited = statements.select("statement_id", F.explode(F.array_distinct("evidence_keys")).alias("evidence_key")).join(evidence.select("evidence_key", F.col("text").alias("told")), "evidence_key")
    told = cited.groupBy("statement_id").agg(F.array_join(F.sort_array(F.collect_list("told")), " ").alias("told"))
    met = statements.join(told, "statement_id", "left")
    holds = F.col("told").isNotNull() & (F.size(unsupported_numbers("text", "told")) == 0)
    return met.groupBy(by).agg(F.count(F.lit(1)).alias("checked"), _count_if(holds).alias("held")).withColumn("score", F.col("held") / F.col("checked"))


def uncorroborated(claims: DataFrame, least: Column) -> DataFrame:
    """Claims that meet ``least`` and that no other claim of their subject, document and value backs."""
    w = Window.partitionBy("subject", "document_id", "numeric_value")
    return claims.withColumn("__alone", F.min("claim_id").over(w) == F.max("claim_id").over(w)).where(F.col("__alone") & least).drop("__alone")


def draft_flags(claims: DataFrame) -> DataFrame:
    """VAL17: figures of a draft that are weakly grounded, by value, unit and document, with the first claim of each."""
    return claims.where("grounding = 'weak'").groupBy("value", "unit", "document_id").agg(F.min("claim_id").alias("claim_id"), F.count(F.lit(1)).alias("n"))


def representative(tables: DataFrame, by: str, key: str, score: Column) -> DataFrame:
    """VAL10: of each kind the table that scores best, ties to the smaller key; an aggregate, not a sort of each kind."""
    return tables.groupBy(by).agg(F.min(F.struct((-score).alias("s"), F.col(key).alias("k")))["k"].alias(key))


def ground_items(items: DataFrame, chunk: str, subject: str, value: str, confidence: str = "confidence", weak_limit: float = 0.5) -> DataFrame:
    """VAL2: ``found`` and ``confidence`` of items: strong if a sentence of the chunk names the subject and states the value, weak (limited) if only the chunk states it, else none (null).

    The subject's own digits are no statement of the value.
    """
    named = F.col(subject)
    states = lambda c: F.array_contains(text.numbers(F.replace(c, named, F.lit(""))), F.col(value))
    strong = F.exists(text.sentences(chunk), lambda x: x.contains(named) & states(x))
    found = F.when(strong, "strong").when(states(F.col(chunk)), "weak").otherwise("none")
    told = items.withColumn("found", found)
    return told.withColumn(confidence, F.when(F.col("found") == "strong", F.col(confidence)).when(F.col("found") == "weak", F.least(confidence, F.lit(weak_limit))))
