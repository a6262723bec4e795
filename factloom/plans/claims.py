"""Queries over claims."""

from pyspark.sql import functions as F

from ..operators import claims as op
from .registry import query

KEY = "concat(predicate, '|', parameter_role, '|', location, '|', operating_mode, '|', lower(scenario), '|', pressure_basis, '|', qualifier)"
K = f"WITH k AS (SELECT *, {KEY} AS context_key FROM claims_v) "

query("agg2_claim_conflicts", K + """, g AS (
  SELECT subject, context_key, count(*) AS n_claims, count(DISTINCT concat(document_id, '|', page, '|', chunk_id)) AS n_places,
    count(DISTINCT CAST(round(numeric_value * 10000) AS BIGINT)) AS n_values, min(numeric_value) AS low, max(numeric_value) AS high
  FROM k WHERE numeric_value IS NOT NULL GROUP BY subject, context_key)
SELECT *, CASE WHEN n_values > 1 THEN 'potential_conflict' ELSE 'corroborated' END AS status FROM g WHERE n_claims >= 2 AND n_places >= 2""")(lambda t: op.conflicts(t.claims_v))

query("agg3_linked_conflicts", K + """, v AS (SELECT subject, context_key, unit, numeric_value, document_id, page, count(*) AS n FROM k GROUP BY ALL)
SELECT a.subject, a.context_key, a.unit, a.numeric_value, a.document_id, a.page, a.n AS n_claims, CAST(coalesce(sum(b.n) FILTER (WHERE b.numeric_value = a.numeric_value), 0) AS BIGINT) AS n_corroborating,
  CAST(coalesce(sum(b.n) FILTER (WHERE b.numeric_value <> a.numeric_value), 0) AS BIGINT) AS n_conflicting
FROM v a LEFT JOIN v b ON a.subject = b.subject AND a.context_key = b.context_key AND a.unit = b.unit AND (a.document_id <> b.document_id OR a.page <> b.page) GROUP BY ALL""")(lambda t: op.linked_conflicts(t.claims_v))

RANKED = K + """, r AS (
  SELECT k.*, CASE temporal_status WHEN 'current' THEN 3 WHEN 'historical' THEN 1 WHEN 'defunct' THEN 0 ELSE 2 END AS temporal_rank, coalesce(d.authority_rank, 50) AS document_rank,
    CAST(regexp_extract(revision, '[0-9]+') AS DOUBLE) AS revision_number, CASE WHEN source IN ('table', 'specification') THEN 3 WHEN source IN ('rule', 'prose') THEN 2 ELSE 1 END AS source_rank
  FROM k LEFT JOIN documents_info_v d ON k.document_id = d.document_id),
a AS (SELECT *, row_number() OVER w AS authority, CASE WHEN lead(claim_id) OVER w IS NULL THEN 'only' WHEN temporal_rank > lead(temporal_rank) OVER w THEN 'time'
    WHEN document_rank > lead(document_rank) OVER w THEN 'document' WHEN revision_number > lead(revision_number) OVER w THEN 'revision'
    WHEN source_rank > lead(source_rank) OVER w THEN 'source' ELSE 'equal' END AS reason
  FROM r WINDOW w AS (PARTITION BY subject, context_key ORDER BY temporal_rank DESC, document_rank DESC, revision_number DESC, source_rank DESC, confidence DESC, page DESC, claim_id))"""
query("win8_authority", RANKED + " SELECT claim_id, subject, context_key, CAST(authority AS INT) AS authority, reason FROM a")(
    lambda t: op.authority(op.with_context_key(t.claims_v), t.documents_info_v, ["subject", "context_key"]).select("claim_id", "subject", "context_key", "authority", "reason"))


def _checked(claims):
    return op.unit_check(claims).groupBy("predicate", "unit", "unit_family", "unit_check").agg(F.count(F.lit(1)).alias("n"))


def _ranked(t):
    return op.authority(op.with_context_key(t.claims_v), t.documents_info_v, ["subject", "predicate"])


R2 = RANKED.replace("PARTITION BY subject, context_key ORDER", "PARTITION BY subject, predicate ORDER")
MARK = R2 + """, m AS (SELECT subject, predicate, parameter_role AS role, CASE unit WHEN 'bar' THEN numeric_value * 1.01972 / 1.0 WHEN 'kg/cm2' THEN numeric_value END AS marker, authority FROM a WHERE predicate = 'operating_pressure'),
  f AS (SELECT subject, role, arg_min(marker, authority) AS marker FROM m WHERE marker IS NOT NULL GROUP BY subject, role)"""
PRESSURE = lambda t: op.markers(_ranked(t).where("predicate = 'operating_pressure'"), ["subject"], "kg/cm2")
query("agg6_role_markers", MARK + " SELECT subject, role, CAST(round(marker * 1000000) AS BIGINT) AS micro, CASE role WHEN 'minimum' THEN 1 WHEN 'normal' THEN 2 WHEN 'maximum' THEN 5 WHEN 'design' THEN 6 END AS role_order FROM f")(
    lambda t: PRESSURE(t).select("subject", "role", F.round(F.col("marker") * 1000000).cast("long").alias("micro"), F.col("role_order").cast("int").alias("role_order")))
ENV = MARK + """, e AS (SELECT subject, max(marker) FILTER (WHERE role = 'minimum') AS lo, max(marker) FILTER (WHERE role = 'maximum') AS hi, max(marker) FILTER (WHERE role = 'normal') AS normal, max(marker) FILTER (WHERE role = 'design') AS design, CAST(NULL AS DOUBLE) AS trip FROM f GROUP BY subject)"""
MICRO = "CAST(round({0} * 1000000) AS BIGINT) AS {0}"
query("qry4_envelope", ENV + f" SELECT subject, {', '.join(MICRO.format(c) for c in ('lo', 'hi', 'normal', 'design'))} FROM e")(
    lambda t: op.envelope(PRESSURE(t), ["subject"]).select("subject", *[F.round(F.col(c) * 1000000).cast("long").alias(c) for c in ("lo", "hi", "normal", "design")]))
query("qry3_limit_verdict", ENV + """, v AS (SELECT e.*, CAST(length(subject) * 3 + coalesce(normal, 1) AS DOUBLE) AS v FROM e)
SELECT subject, CASE WHEN coalesce(lo, hi, normal, design) IS NULL THEN 'unknown' WHEN v > design THEN 'outside_design'
  WHEN coalesce(v > hi, false) OR coalesce(v < lo, false) THEN CASE WHEN design IS NOT NULL THEN 'within_design' ELSE 'outside_design' END
  WHEN coalesce(abs(v - normal) / greatest(normal, 1e-9) <= 0.05, false) THEN 'within_normal' WHEN hi IS NOT NULL AND lo IS NOT NULL THEN 'within_normal'
  WHEN hi IS NOT NULL AND v <= hi THEN 'within_normal' WHEN design IS NOT NULL THEN 'within_design' ELSE 'unknown' END AS verdict FROM v""")(
    lambda t: op.verdict(op.envelope(PRESSURE(t), ["subject"]), F.length("subject") * 3 + F.coalesce("normal", F.lit(1.0))).select("subject", "verdict"))

query("flt13_claim_context", """SELECT claim_id, any_value(subject) AS subject, any_value(predicate) AS predicate, 'normal' AS parameter_role, 'discharge' AS location FROM claims_v WHERE predicate LIKE '%pressure%' AND location = 'discharge' AND parameter_role = 'normal' GROUP BY claim_id""")(
    lambda t: op.claim_filter(t.claims_v, "pressure", location="discharge", parameter_role="normal").select("claim_id", "subject", "predicate", "parameter_role", "location"))
query("flt14_claim_search", "SELECT claim_id, subject, predicate, scenario FROM claims_v WHERE subject LIKE '11-P-%' AND predicate = 'flow_rate' AND scenario = 'BH' ORDER BY claim_id, subject, predicate LIMIT 50")(
    lambda t: op.search_claims(t.claims_v, "11-p-", "flow", "bh").select("claim_id", "subject", "predicate", "scenario"))
query("flt15_soft_filter", """WITH m AS (SELECT claim_id, subject, location, max(CASE WHEN location = 'suction' THEN 1 ELSE 0 END) OVER (PARTITION BY subject) AS hit FROM claims_v)
  SELECT claim_id, subject, location FROM m WHERE location = 'suction' OR hit = 0""")(lambda t: op.soft_filter(t.claims_v.select("claim_id", "subject", "location"), ["subject"], F.col("location") == "suction"))
query("agg5_parameter_vote", """WITH c AS (SELECT subject, CASE unit WHEN 'kg/h' THEN 'mass_flow' WHEN 'm3/h' THEN 'volumetric_flow' ELSE 'pressure' END AS family, unit, count(*) AS n FROM claims_v GROUP BY ALL),
  f AS (SELECT *, CAST(sum(n) OVER (PARTITION BY subject, family) AS BIGINT) AS family_n FROM c)
  SELECT subject, family, unit, n, family_n FROM f QUALIFY row_number() OVER (PARTITION BY subject ORDER BY family_n DESC, family, n DESC, unit) = 1""")(lambda t: op.parameter_vote(t.claims_v, ["subject"]))
query("val3_unit_check", """SELECT predicate, unit, CASE unit WHEN 'kg/h' THEN 'mass_flow' WHEN 'm3/h' THEN 'volumetric_flow' ELSE 'pressure' END AS unit_family, 'pass' AS unit_check, count(*) AS n FROM claims_v GROUP BY ALL
  UNION ALL SELECT predicate, 'bar', 'pressure', CASE WHEN predicate = 'flow_rate' THEN 'error' ELSE 'pass' END, count(*) FROM claims_v GROUP BY predicate""")(
    lambda t: _checked(t.claims_v.select("predicate", "unit")).unionAll(_checked(t.claims_v.select("predicate", F.lit("bar").alias("unit")))))
query("agg9_compare", RANKED + """, b AS (SELECT context_key, subject, value FROM a WHERE authority = 1 AND subject IN ('11-E-000001', '12-C-000002', '10-TIC-000003'))
  SELECT context_key, max(value) FILTER (WHERE subject = '11-E-000001') AS "11-E-000001", max(value) FILTER (WHERE subject = '12-C-000002') AS "12-C-000002", max(value) FILTER (WHERE subject = '10-TIC-000003') AS "10-TIC-000003",
    CAST(count(*) AS INT) AS coverage, count(DISTINCT value) > 1 AS differs FROM b GROUP BY context_key""")(
    lambda t: op.compare(op.with_context_key(t.claims_v), ["11-E-000001", "12-C-000002", "10-TIC-000003"], t.documents_info_v))
query("agg4_index_statistics", """SELECT c.document_id, count(*) AS n_claims, count(DISTINCT subject) AS n_subjects, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT page) AS n_pages
  FROM claims_v c JOIN documents_info_v d ON c.document_id = d.document_id WHERE d.tag <> 'SECRET' GROUP BY c.document_id""")(
    lambda t: op.index_statistics(t.claims_v, t.documents_info_v.where("tag <> 'SECRET'")))
query("ext14_merge_extractions", """SELECT claim_id, subject, value, unit, source FROM (SELECT claim_id, subject, value, unit, source, row_number() OVER (PARTITION BY subject, predicate, parameter_role, location, scenario, value, unit
  ORDER BY CASE source WHEN 'table' THEN 0 WHEN 'specification' THEN 1 WHEN 'rule' THEN 2 ELSE 3 END, claim_id) AS r FROM claims_v) AS x WHERE r = 1""")(
    lambda t: op.merge_extractions(t.claims_v))
query("qry1_lookup", """SELECT claim_id, subject, predicate, CAST(r AS INT) AS r FROM (SELECT claim_id, subject, predicate, row_number() OVER (PARTITION BY subject ORDER BY CASE temporal_status WHEN 'current' THEN 3 WHEN 'historical' THEN 1 WHEN 'defunct' THEN 0 ELSE 2 END DESC,
  confidence DESC, page DESC, claim_id) AS r FROM claims_v) AS x WHERE r <= 24""")(
    lambda t: op.lookup(t.claims_v).select("claim_id", "subject", "predicate", "r"))
query("qry6_conflict_resolution", RANKED + """ SELECT subject, context_key, count(*) AS n_claims, count(DISTINCT numeric_value) AS n_values, CASE WHEN count(DISTINCT numeric_value) <= 1 THEN 'corroborated' WHEN max(reason) FILTER (WHERE authority = 1) = 'equal' THEN 'unresolved' ELSE 'resolved' END AS status,
  max(value) FILTER (WHERE authority = 1) AS preferred, max(reason) FILTER (WHERE authority = 1) AS reason FROM a GROUP BY subject, context_key HAVING count(*) > 1""")(
    lambda t: op.resolve_conflicts(t.claims_v, t.documents_info_v))
query("agg10_verdict_confidence", """SELECT document_id, CAST(round(sum(w * confidence * 100) * 1000 / sum(w)) AS BIGINT) AS weighted FROM (SELECT document_id, confidence, CASE WHEN grounding = 'weak' THEN 3 WHEN qualifier = '' THEN 5 ELSE 10 END AS w FROM claims_v) AS x GROUP BY document_id""")(
    lambda t: op.weighted_confidence(t.claims_v, "document_id", F.when(F.col("grounding") == "weak", 3).when(F.col("qualifier") == "", 5).otherwise(10)))
query("str28_context_label", """SELECT claim_id, concat_ws(', ', CASE WHEN parameter_role <> '' THEN parameter_role END, CASE WHEN location <> '' THEN location END, CASE WHEN scenario <> '' THEN scenario END,
  CASE WHEN pressure_basis <> '' THEN pressure_basis END, CASE WHEN qualifier <> '' THEN substr(qualifier, 1, 40) END) AS label FROM claims_v""")(
    lambda t: t.claims_v.select("claim_id", op.context_label().alias("label")))
query("qry21_calculation_steps", """SELECT subject, predicate, step, CAST(round(v * 1000) AS BIGINT) AS milli FROM (
  SELECT subject, predicate, 1 AS step, min(numeric_value) AS v FROM claims_v GROUP BY subject, predicate UNION ALL SELECT subject, predicate, 2, max(numeric_value) FROM claims_v GROUP BY subject, predicate
  UNION ALL SELECT subject, predicate, 3, max(numeric_value) - min(numeric_value) FROM claims_v GROUP BY subject, predicate) AS s""")(
    lambda t: op.calculation_steps(t.claims_v, ["subject", "predicate"]).select("subject", "predicate", "step", F.round(F.col("v") * 1000).cast("long").alias("milli")))
query("agg11_benchmark_metrics", "SELECT source, count(*) AS n, count(*) FILTER (WHERE grounding = 'strong') * 10000 // count(*) AS grounded_bp FROM claims_v GROUP BY source")(
    lambda t: op.grounded_share(t.claims_v, "source"))
