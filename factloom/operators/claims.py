"""Claims: conflicts, authority, limits, filters, comparison."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, units
from ..functions.vocabulary import PREDICATE_FAMILIES, ROLE_ORDER, SOURCE_RANK, TEMPORAL_RANK

CONTEXT = ["predicate", "parameter_role", "location", "operating_mode", "scenario", "pressure_basis", "qualifier"]


def with_context_key(claims: DataFrame) -> DataFrame:
    return claims.withColumn("context_key", text.context_key(*CONTEXT))


def conflicts(claims: DataFrame) -> DataFrame:
    """AGG2: numeric claims of one subject and context from several places, whose values agree or may conflict. Units are not compared.

    Values are compared to four decimals, as whole numbers of ten-thousandths. Claims are shuffled once, each as one row: a group lies in
    one task, where the first of each place and of each value is told by order. A very large group is a long task of bounded memory.
    """
    key = ["subject", "context_key"]
    place = [F.col(c) for c in ("document_id", "page", "chunk_id")]
    value = F.round(F.col("numeric_value") * 10000).cast("long")
    rows = with_context_key(claims.where("numeric_value is not null")).select(*key, *place, "numeric_value").repartition(*key)
    new = lambda *by: (F.row_number().over(Window.partitionBy(*key, *by).orderBy(F.lit(0))) == 1).cast("long")
    whole = F.lit(True)
    for c in place:
        whole = whole & c.isNotNull()
    marked = rows.withColumn("value", value).withColumn("__place", F.when(whole, new(*place))).withColumn("__value", F.when(F.col("value").isNotNull(), new("value")))
    groups = marked.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_claims"), F.coalesce(F.sum("__place"), F.lit(0)).alias("n_places"), F.coalesce(F.sum("__value"), F.lit(0)).alias("n_values"),
        F.min("numeric_value").alias("low"), F.max("numeric_value").alias("high"),
    )
    return groups.where("n_claims >= 2 and n_places >= 2").withColumn("status", F.when(F.col("n_values") > 1, "potential_conflict").otherwise("corroborated"))


def counts_of_cube(claims: DataFrame) -> DataFrame:
    """AGG15: (predicate, location, n, subjects): claims and their distinct subjects by both, by either and in all; null stands for every value.

    A subject has one row a predicate and location, and of these the first of its predicate, of its location and of all is marked; so the
    subjects of every level are sums, and rows are not made once a level.
    """
    pairs = claims.groupBy("subject", "predicate", "location").agg(F.count(F.lit(1)).alias("n"))
    new = lambda by, *order: F.when(F.col("subject").isNotNull() & (F.row_number().over(Window.partitionBy("subject", *by).orderBy(*order)) == 1), 1).otherwise(0)
    marked = pairs.select("*", new([], "predicate", "location").alias("a"), new(["predicate"], "location").alias("p"), new(["location"], "predicate").alias("l"), F.col("subject").isNotNull().cast("int").alias("pl"))
    few = marked.groupBy("predicate", "location").agg(*[F.sum(c).alias(c) for c in ("n", "a", "p", "l", "pl")])
    level = F.grouping_id()
    subjects = F.when(level == 0, F.sum("pl")).when(level == 1, F.sum("p")).when(level == 2, F.sum("l")).otherwise(F.sum("a"))
    return few.cube("predicate", "location").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(subjects, F.lit(0)).alias("subjects"))


def linked_conflicts(claims: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """AGG3, JOI8, VAL6: per claim, how many of another page agree with it or contradict it, with the same unit, too.

    A group of n claims has n * (n - 1) / 2 pairs; they are never made: values are counted first, and a claim compares
    with the distinct values of its group.
    """
    keyed = with_context_key(claims)
    key = ["subject", "context_key", "unit"]
    counts = keyed.groupBy(*key, "numeric_value", "document_id", "page").agg(F.count(F.lit(1)).alias("n"))
    of_key, of_value = Window.partitionBy(*key), Window.partitionBy(*key, "numeric_value")
    of_page, of_both = Window.partitionBy(*key, "document_id", "page"), Window.partitionBy(*key, "numeric_value", "document_id", "page")
    sized = (
        counts.withColumn("all", F.sum("n").over(of_key)).withColumn("equal", F.sum("n").over(of_value))
        .withColumn("page_all", F.sum("n").over(of_page)).withColumn("page_equal", F.sum("n").over(of_both))
    )
    return sized.select(
        *key, "numeric_value", "document_id", "page", F.col("n").alias("n_claims"),
        (F.col("equal") - F.col("page_equal")).alias("n_corroborating"),
        ((F.col("all") - F.col("page_all")) - (F.col("equal") - F.col("page_equal"))).alias("n_conflicting"),
    )


def _rank(column: Column, ranks: dict, other: int) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(ranks.items())])
    return F.coalesce(F.try_element_at(table, F.coalesce(column, F.lit(""))), F.lit(other))


def revision_number(c: Column) -> Column:
    found = F.regexp_extract(F.coalesce(c, F.lit("")), "([0-9]+(?:[.][0-9]+)?)", 1)
    return F.when(found != "", found.cast("double")).otherwise(0.0)


def authority(claims: DataFrame, documents: DataFrame, by: list[str]) -> DataFrame:
    """WIN8: claims ranked within ``by``: time, document, revision, source, confidence, page, then claim_id. ``reason``: why the first beats the second."""
    ranked = claims.join(documents.select(F.col("document_id").alias("__d"), "authority_rank"), F.col("document_id") == F.col("__d"), "left").drop("__d")
    ranked = (
        ranked.withColumn("temporal_rank", _rank(F.col("temporal_status"), TEMPORAL_RANK, 2)).withColumn("document_rank", F.coalesce("authority_rank", F.lit(50)))
        .withColumn("revision_number", revision_number(F.col("revision"))).withColumn("source_rank", _rank(F.col("source"), SOURCE_RANK, 1))
    )
    order = [F.desc("temporal_rank"), F.desc("document_rank"), F.desc("revision_number"), F.desc("source_rank"), F.desc(F.round("confidence", 2)), F.desc(F.coalesce("page", F.lit(0))), F.asc("claim_id")]
    w = Window.partitionBy(*by).orderBy(*order)
    nxt = lambda c: F.lead(c).over(w)
    reason = (
        F.when(nxt("claim_id").isNull(), "only").when(F.col("temporal_rank") > nxt("temporal_rank"), "time").when(F.col("document_rank") > nxt("document_rank"), "document")
        .when(F.col("revision_number") > nxt("revision_number"), "revision").when(F.col("source_rank") > nxt("source_rank"), "source").otherwise("equal")
    )
    return ranked.withColumn("reason", reason).withColumn("authority", F.row_number().over(w)).drop("authority_rank")


def role_of(role: Column, predicate: Column, qualifier: Column) -> Column:
    q = F.lower(F.coalesce(qualifier, F.lit("")))
    return (
        F.when(F.coalesce(role, F.lit("")) != "", F.lower(role)).when(predicate.contains("design"), "design").when(q.contains("minimum") | (q == "min"), "minimum")
        .when(q.contains("max"), "maximum").when(q.contains("normal"), "normal").otherwise("operating")
    )


def markers(ranked: DataFrame, by: list[str], target_unit: str) -> DataFrame:
    """AGG6: one value a role, in ``target_unit``; other families are left out; the claim of best authority speaks."""
    told = ranked.where("numeric_value is not null and unit <> ''").withColumn("role", role_of(F.col("parameter_role"), F.col("predicate"), F.col("qualifier")))
    converted = units.with_converted(told, "numeric_value", "unit", target_unit, "__marker", "pressure_basis")
    usable = converted.withColumn("marker", F.when(F.lower("unit") == target_unit.lower(), F.col("numeric_value")).otherwise(F.col("__marker"))).where("marker is not null").drop("__marker")
    first = usable.groupBy(*by, "role").agg(F.min_by("marker", "authority").alias("marker"))
    return first.withColumn("role_order", F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLE_ORDER]), F.col("role")), F.lit(99)))


def envelope(marked: DataFrame, by: list[str]) -> DataFrame:
    """QRY4: the markers of a subject side by side: lo, hi, normal, design, trip."""
    pick = lambda *roles: F.coalesce(*[F.max(F.when(F.col("role") == r, F.col("marker"))) for r in roles])
    return marked.groupBy(*by).agg(
        pick("minimum").alias("lo"), pick("maximum", "rated").alias("hi"), pick("normal", "operating").alias("normal"),
        pick("design", "mechanical_design").alias("design"), pick("trip").alias("trip"))


def verdict(limits: DataFrame, value: Column) -> DataFrame:
    """QRY3: where a measured value stands in the envelope."""
    v, c = value, F.col
    known = F.coalesce("lo", "hi", "normal", "design", "trip").isNotNull()
    out = F.coalesce((v > c("hi")), F.lit(False)) | F.coalesce((v < c("lo")), F.lit(False))
    near = F.coalesce(F.abs(v - c("normal")) / F.greatest(c("normal"), F.lit(1e-9)) <= 0.05, F.lit(False))
    return limits.withColumn("verdict", (
        F.when(~known | v.isNull(), "unknown").when(v >= c("trip"), "outside_design").when(v > c("design"), "outside_design")
        .when(out, F.when(c("design").isNotNull(), "within_design").otherwise("outside_design")).when(near, "within_normal")
        .when(c("hi").isNotNull() & c("lo").isNotNull(), "within_normal").when(c("hi").isNotNull() & (v <= c("hi")), "within_normal")
        .when(c("design").isNotNull(), "within_design").otherwise("unknown")
    ))


def soft_filter(rows: DataFrame, by: list[str], condition: Column) -> DataFrame:
    """FLT15: the rows that meet ``condition``, or all of a group that has none; one window, no second query."""
    hit = F.coalesce(condition, F.lit(False))
    return rows.withColumn("__any", F.max(hit.cast("int")).over(Window.partitionBy(*by))).where(hit | (F.col("__any") == 0)).drop("__any")


def parameter_vote(claims: DataFrame, by: list[str]) -> DataFrame:
    """AGG5: the commonest unit family, and the commonest unit in it; ties by name."""
    counted = claims.withColumn("family", units.family("unit")).groupBy(*by, "family", "unit").agg(F.count(F.lit(1)).alias("n"))
    votes = counted.withColumn("family_n", F.sum("n").over(Window.partitionBy(*by, "family")))
    w = Window.partitionBy(*by).orderBy(F.desc("family_n"), "family", F.desc("n"), "unit")
    return votes.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def unit_check(claims: DataFrame) -> DataFrame:
    """VAL3: whether a claim's unit fits its predicate: pass, warn (none, unknown) or error."""
    allowed = F.try_element_at(F.create_map(*[x for k, v in PREDICATE_FAMILIES.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))]), F.col("predicate"))
    kind = units.extracted_family("unit")
    free = F.array_contains(allowed, "text") | F.array_contains(allowed, "dimensionless")
    return claims.withColumn("unit_family", kind).withColumn(
        "unit_check",
        F.when(allowed.isNull(), "pass").when(F.trim(F.coalesce("unit", F.lit(""))) == "", F.when(free, "pass").otherwise("warn")).when(kind == "unknown", "warn")
        .when(F.array_contains(allowed, kind), "pass").otherwise("error"),
    )


def compare(claims: DataFrame, subjects: list[str], documents: DataFrame) -> DataFrame:
    """AGG9, JOI12: attributes by subject, best claim each, with the number of subjects that have it and whether they differ."""
    best = authority(claims.where(F.col("subject").isin(subjects)), documents, ["subject", "context_key"]).where("authority = 1")
    wide = best.groupBy("context_key").pivot("subject", subjects).agg(F.first("value"))
    return wide.withColumn("coverage", sum((F.col(f"`{s}`").isNotNull()).cast("int") for s in subjects)).withColumn("differs", F.size(F.array_distinct(F.array_compact(F.array(*[F.col(f"`{s}`") for s in subjects])))) > 1)


def claim_filter(claims: DataFrame, predicate: str | None = None, **context: str) -> DataFrame:
    """FLT13: claims whose predicate is or contains ``predicate`` and whose context says what is asked, whatever the case; what is not asked does not filter. Each claim once."""
    out = claims
    if predicate:
        out = out.where(F.lower("predicate").contains(predicate.lower()))
    for name, value in context.items():
        out = out.where(F.lower(text.text_of(name)) == value.lower())
    return out.dropDuplicates(["claim_id"])


def search_claims(claims: DataFrame, subject: str = "", predicate: str = "", scenario: str = "", limit: int = 50) -> DataFrame:
    """FLT14: by parts of subject, predicate and scenario (or qualifier), in the order of claim_id."""
    has = lambda c, part: F.lower(text.text_of(c)).contains(part.lower())
    found = claims.where(has("subject", subject) & has("predicate", predicate) & (has("scenario", scenario) | has("qualifier", scenario)))
    return found.orderBy("claim_id", "subject", "predicate").limit(limit)


def duplicates(rows: DataFrame, of: str, key: str) -> DataFrame:
    """Texts that several rows share: their hash, how many, and the first."""
    return rows.groupBy(F.md5(of).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_doc")).where("n > 1")


def context_label() -> Column:
    """STR28: the parts of a claim's context that are filled, joined by commas; the qualifier up to 40 characters, unless said already."""
    filled = lambda c: F.when(text.text_of(c) != "", F.col(c))
    parts = F.concat_ws(", ", *[filled(c) for c in ("parameter_role", "location", "scenario", "pressure_basis")])
    short = F.substring("qualifier", 1, 40)
    return F.concat_ws(", ", F.when(parts != "", parts), F.when((text.text_of("qualifier") != "") & ~parts.contains(short), short))


def same_number(a: Column | str, b: Column) -> Column:
    """STR30: whether a written number and a value are equal, as numbers."""
    return text.leading_number(a) == b


def index_statistics(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """AGG4: of each readable document, its claims, subjects, chunks and pages."""
    return claims.join(documents.select("document_id"), "document_id", "left_semi").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_claims"), F.countDistinct("subject").alias("n_subjects"), F.countDistinct("chunk_id").alias("n_chunks"), F.countDistinct("page").alias("n_pages"))


def merge_extractions(claims: DataFrame) -> DataFrame:
    """EXT14: of equal claims of several extractors, the one of the best source, then of the smallest id; an aggregate, so hot claims are no sorted group."""
    key = ["subject", "predicate", "parameter_role", "location", "scenario", "value", "unit"]
    place = F.when(F.col("source") == "table", 0).when(F.col("source") == "specification", 1).when(F.col("source") == "rule", 2).otherwise(3)
    return claims.groupBy(*key).agg(F.min(F.struct(place.alias("p"), "claim_id", "source")).alias("b")).select("b.claim_id", "subject", "value", "unit", "b.source")


def lookup(claims: DataFrame, by: str = "subject", most: int = 24) -> DataFrame:
    """QRY1: the first ``most`` claims of each subject, by time, confidence and page."""
    rank = F.when(F.col("temporal_status") == "current", 3).when(F.col("temporal_status") == "historical", 1).when(F.col("temporal_status") == "defunct", 0).otherwise(2)
    w = Window.partitionBy(by).orderBy(F.desc(rank), F.desc("confidence"), F.desc("page"), "claim_id")
    return claims.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)


def resolve_conflicts(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """QRY6: (subject, context_key, n_claims, n_values, status, preferred, reason) of contexts with several claims.

    corroborated: one value; resolved: the best claim beats the next one of another value by time, document, revision or
    source; unresolved: nothing tells them apart. ``preferred`` is the best claim's value.
    """
    ranked = authority(with_context_key(claims), documents, ["subject", "context_key"])
    first = F.min(F.struct("authority", "value", "reason"))
    out = ranked.groupBy("subject", "context_key").agg(F.count(F.lit(1)).alias("n_claims"), F.countDistinct(F.round("numeric_value", 4)).alias("n_values"), first.alias("b")).where("n_claims > 1")
    status = F.when(F.col("n_values") <= 1, "corroborated").when(F.col("b.reason") == "equal", "unresolved").otherwise("resolved")
    return out.select("subject", "context_key", "n_claims", "n_values", status.alias("status"), F.col("b.value").alias("preferred"), F.col("b.reason").alias("reason"))


def different_context(claims: DataFrame) -> DataFrame:
    """QRY6: (subject, predicate, n_contexts): parameters whose values differ because their contexts do, which is no conflict."""
    return with_context_key(claims).groupBy("subject", "predicate").agg(F.countDistinct("context_key").alias("n_contexts")).where("n_contexts > 1")


def weighted_confidence(rows: DataFrame, by: str, weight: Column) -> DataFrame:
    """AGG10: the mean confidence by weight, in thousandths of a percent."""
    weighed = rows.withColumn("__w", weight)
    return weighed.groupBy(by).agg(F.round(F.sum(F.col("__w") * F.col("confidence") * 100) * 1000 / F.sum("__w")).cast("long").alias("weighted"))


def grounded_share(rows: DataFrame, by: str) -> DataFrame:
    """AGG11: cases by ``by`` and the share that is strongly grounded, in basis points."""
    strong = F.sum((F.col("grounding") == "strong").cast("long"))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.floor(strong * 10000 / F.count(F.lit(1))).cast("long").alias("grounded_bp"))


def calculation_steps(claims: DataFrame, by: list[str]) -> DataFrame:
    """QRY21: the steps of a margin: the least value, the largest, and the difference; one aggregate."""
    low, high = F.min("numeric_value"), F.max("numeric_value")
    steps = F.array(*[F.struct(F.lit(k).alias("step"), v.alias("v")) for k, v in ((1, low), (2, high), (3, high - low))])
    return claims.groupBy(*by).agg(steps.alias("s")).select(*by, F.explode("s").alias("x")).select(*by, "x.step", "x.v")


def side_by_side(claims: DataFrame, by: list[str], of: str, names: dict[str, str], value: str = "numeric_value") -> DataFrame:
    """QRY5, JOI12: the largest value under each of the listed contexts (value of ``of`` -> column name), one row a ``by``."""
    return claims.groupBy(*by).agg(*[F.max(F.when(F.col(of) == v, F.col(value))).alias(name) for v, name in names.items()])


def cited_sections(claims: DataFrame, least: int = 2) -> DataFrame:
    """QRY10: sections of documents with at least ``least`` claims."""
    return claims.groupBy("document_id", F.concat("document_id", F.lit(" > "), "page").alias("section")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def assemble_index(entities: DataFrame) -> DataFrame:
    """EXT13: one index entry a name: the first uid, its aliases and mentions."""
    return entities.groupBy("name").agg(F.min("entity_uid").alias("uid"), F.count(F.lit(1)).alias("n_aliases"), F.sum("mention_count").cast("long").alias("mentions"))


def claim_edges(claims: DataFrame, accepted: Column) -> DataFrame:
    """GRA9: edges from subject to document by predicate, with how many accepted claims carry them and the last one's value."""
    return claims.where(accepted).groupBy("subject", "predicate", "document_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("value", "claim_id").alias("value"))


def context_bundle(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """GRA11: (chunk_id, facet, n): what is known around a chunk: its claims and the entities that they name."""
    told = claims.groupBy("chunk_id").agg(F.lit("claim").alias("facet"), F.count(F.lit(1)).alias("n"))
    named = claims.select("chunk_id", "subject").distinct().join(entities.select(F.col("canonical_tag").alias("subject"), "entity_uid"), "subject")
    return told.unionByName(named.groupBy("chunk_id").agg(F.lit("entity").alias("facet"), F.countDistinct("entity_uid").alias("n")))


def document_graph(claims: DataFrame) -> DataFrame:
    """SRC16: the sections of a document and how many chunks hang from each."""
    return claims.groupBy(F.concat("document_id", F.lit("#"), "page").alias("section_id"), "document_id").agg(F.countDistinct("chunk_id").alias("n_chunks"))


def ordered_labels(claims: DataFrame) -> DataFrame:
    """AGG7: a subject's chunks numbered in the order of their first claims."""
    first = claims.groupBy("subject", "chunk_id").agg(F.min("claim_id").alias("first_id"))
    return first.select("subject", "chunk_id", F.dense_rank().over(Window.partitionBy("subject").orderBy("first_id")).alias("label"))


def promoted_labels(mentions: DataFrame, label: str, document: str, documents: int = 2, chunks: int = 5) -> DataFrame:
    """AGG8: labels that enough documents and chunks use."""
    return mentions.groupBy(label).agg(F.countDistinct(document).alias("n_documents"), F.count(F.lit(1)).alias("n_chunks")).where((F.col("n_documents") >= documents) & (F.col("n_chunks") >= chunks))


def best_of_chunk(claims: DataFrame, most: int = 20) -> DataFrame:
    """JOI10: the first ``most`` claims of each section, by confidence."""
    w = Window.partitionBy("chunk_id").orderBy(F.desc("confidence"), "claim_id")
    return claims.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def missing_documents(documents: DataFrame, by: str, needed: Column, priority: Column) -> DataFrame:
    """AGG13: of each kind, whether a document that is ``needed`` is there, how many there are, and its priority."""
    return documents.groupBy(by).agg(F.max(needed).alias("present"), F.count(F.lit(1)).alias("n"), F.max(priority).alias("priority"))


def spec_claims(pairs: DataFrame, headings: DataFrame) -> DataFrame:
    """EXT3: (document_id, subject, label, value, confidence) of specification pairs (document_id, reading_order, label, value).

    The subject is the tag in the nearest heading before the pair, else the heading itself unless it is generic; a pair
    without either gives none. Headings and pairs are put in one order and the last heading is carried along.
    """
    from ..functions.tags import find_tags

    named = F.coalesce(F.get(find_tags("content"), F.lit(0)), F.when(~text.is_non_entity_name("content"), F.trim(F.regexp_replace("content", r"^\s*\d+(?:\.\d+)*\.?\s+", ""))))
    heads = headings.select("document_id", "reading_order", F.lit(0).alias("kind"), named.alias("subject"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("value"))
    rows = heads.unionByName(pairs.select("document_id", "reading_order", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("subject"), "label", "value"))
    w = Window.partitionBy("document_id").orderBy("reading_order", "kind").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumn("subject", F.last("subject", ignorenulls=True).over(w)).where("kind = 1 and subject is not null")
    return told.select("document_id", "subject", "label", "value", F.lit(0.8).alias("confidence"))


def answer_confidence(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """AGG10: (request_id, base, score): how far an answer is to be trusted.

    ``results``: request_id, agent, score, ok, optional, n_missing, a row a step. ``verdicts``: request_id, verified, at most one a request; without
    one the share is 1. The base is the mean score of the steps but for verification, governance and report, an optional one at
    half weight, a failed one at three tenths of its weight; without steps it is 0.3. It is taken by 0.6 and 0.4 of the verified share, less
    0.05 for each thing missing, 0.25 at most, and kept within 0 and 1. Null scores count as 0, null flags as not optional and as ok.
    """
    counts = ~F.col("agent").isin("verification", "governance", "report") | F.col("agent").isNull()
    weight = F.when(F.coalesce("optional", F.lit(False)), 0.5).otherwise(1.0) * F.when(F.coalesce("ok", F.lit(True)), 1.0).otherwise(0.3)
    w = F.when(counts, weight)
    summed = results.groupBy("request_id").agg(F.coalesce(F.sum(w * F.coalesce("score", F.lit(0.0))) / F.sum(w), F.lit(0.3)).alias("base"), F.sum(F.coalesce("n_missing", F.lit(0))).alias("missing"))
    met = summed.join(verdicts.select("request_id", "verified"), "request_id", "left")
    score = F.col("base") * (0.6 + 0.4 * F.coalesce("verified", F.lit(1.0))) - F.least(F.lit(0.25), 0.05 * F.col("missing"))
    return met.select("request_id", F.round("base", 2).alias("base"), F.round(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9), 2).alias("score"))
