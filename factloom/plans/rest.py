"""Queries of single operators that fit no other group."""

from pyspark.sql import functions as F

from ..functions import units
from ..functions import phrases
from ..operators import audit, claims, elements, extract, plans, requests, retrieval, security, structure, tagmatch
from ..sources import files
from ..streaming import progress
from .documents import BM25, PACKED
from .elements import ELEMENTS
from .registry import query
from .requests import RULES, values
from .streams import LOG

NAMED = "SELECT p_partkey, concat(CASE p_partkey % 4 WHEN 0 THEN 'see ISO ' WHEN 1 THEN 'as per API-' WHEN 2 THEN 'it is ' ELSE 'iso ' END, CAST(p_size AS STRING), ' of it') AS line FROM part"
SHEETS = "SELECT concat('d', CAST(p_partkey AS STRING)) AS document_id, CAST(k AS BIGINT) AS reading_order, CASE k WHEN 0 THEN CASE p_partkey % 3 WHEN 0 THEN concat('3.1 Pump 11-P-', CAST(p_size AS STRING)) WHEN 1 THEN concat('2.4 ', p_name) ELSE 'Details' END ELSE concat('Make: ', p_brand) END AS content FROM part LATERAL VIEW explode(sequence(0, 1)) AS k"
TASKS = f"coalesce((SELECT arg_max(task, (score, -k)) FROM (SELECT k, task, sum(w) AS score FROM {values(RULES, 'k, task, p, unless, w')} WHERE regexp_matches(trim(text), p, 'i') AND NOT regexp_matches(trim(text), unless, 'i') GROUP BY ALL)), 'lookup')"

query("flt4_running_titles", f"WITH e AS ({ELEMENTS}) SELECT DISTINCT document_id, 'plant manual copy' AS key FROM e WHERE content = 'PLANT MANUAL COPY' GROUP BY document_id HAVING count(DISTINCT page) >= 5")(
    lambda t: elements.running_titles(t.sql(ELEMENTS).withColumn("element_type", F.when(F.col("content") == "PLANT MANUAL COPY", "heading").otherwise("text"))))
query("flt16_access_filter", "SELECT c.claim_id, c.document_id FROM claims_v c JOIN documents_info_v d ON c.document_id = d.document_id WHERE d.tag IN ('PUBLIC', 'INTERNAL')")(lambda t: security.secured(t.claims_v, t.documents_info_v, "operator").select("claim_id", "document_id"))
query("flt18_real_references", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ISO ' ELSE 'API-' END || p_size AS reference FROM part WHERE p_partkey % 4 < 2")(
    lambda t: t.sql(NAMED).select("p_partkey", phrases.real_reference("line").alias("reference")).where("reference is not null"))
query("str17_unit_family", "SELECT unit, CASE unit WHEN 'kg/h' THEN 'mass_flow' WHEN 'm3/h' THEN 'volumetric_flow' ELSE 'pressure' END AS family, count(*) AS n FROM claims_v GROUP BY unit")(lambda t: t.claims_v.groupBy("unit", units.extracted_family("unit").alias("family")).agg(F.count(F.lit(1)).alias("n")))
query("str26_tag_scores")(lambda t: t.entities_v.select("partkey", tagmatch.take_apart(F.replace("canonical_tag", F.lit("-0"), F.lit("-"))).alias("c")).withColumn("m", tagmatch.take_apart(F.lit("11-PM-15"))).select("partkey", tagmatch.score(F.col("m"), F.col("c"), F.lit("Pump"), F.lit("Pump")).alias("score")))
BOXES = "SELECT l_orderkey AS page, CAST(l_partkey % 900 AS DOUBLE) AS y, CAST(l_suppkey AS DOUBLE) AS x, CAST(10 + l_linenumber AS DOUBLE) AS h, l_linenumber AS id, l_partkey, l_suppkey FROM lineitem"
query("str37_reading_order", f"""WITH b AS (SELECT DISTINCT page, y, x, h, id, l_partkey, l_suppkey FROM ({BOXES})), m AS (SELECT page, greatest(4.0, 0.6 * median(h)) AS gap FROM b GROUP BY page), s AS (SELECT b.*, CASE WHEN y - lag(y) OVER w <= gap THEN 0 ELSE 1 END AS brk FROM b JOIN m USING (page) WINDOW w AS (PARTITION BY page ORDER BY y, x, id, l_partkey, l_suppkey)),
  r AS (SELECT *, sum(brk) OVER (PARTITION BY page ORDER BY y, x, id, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS band FROM s) SELECT page, id, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY page ORDER BY band, x, y, id, l_partkey, l_suppkey) AS INT) AS place FROM r""")(lambda t: structure.reading_order(t.sql(BOXES).distinct(), "page", ["id", "l_partkey", "l_suppkey"]).select("page", "id", "l_partkey", "l_suppkey", "place"))
query("stc9_instruction_register", "SELECT user_id, event_id, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type IN ('login', 'logout', 'error')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header FROM events")(
    lambda t: progress.standing(t.events, "user_id", ["login", "logout", "error"]).select("user_id", "event_id", "header"))
WEIGHED = "SELECT CAST(l_suppkey AS BIGINT) AS table_id, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS ord, CAST(max(l_quantity) AS INT) AS tokens FROM lineitem GROUP BY l_suppkey, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey"
query("stc18_large_tables", PACKED.format(doc="table_id", order="ord", rows=WEIGHED, budget=780))(lambda t: structure.pack(t.sql(WEIGHED), "table_id", "ord", "tokens", 780))
query("stc22_hash_embedding")(lambda t: retrieval.embed(t.documents, "doc_id", "text"))
query("ext3_spec_claims", "SELECT 'd' || p_partkey AS document_id, CASE WHEN p_partkey % 3 = 0 THEN '11-P-' || p_size ELSE p_name END AS subject, 'Make' AS label, p_brand AS value, CAST(0.8 AS DOUBLE) AS confidence FROM part WHERE p_partkey % 3 < 2")(
    lambda t: claims.spec_claims(extract.spec_pairs(t.sql(SHEETS)), t.sql(SHEETS).where("content not like '%:%'")))
CONFLICT = "WITH v AS (SELECT subject, predicate, parameter_role, location, lower(scenario) AS sc, pressure_basis, qualifier, unit, numeric_value, document_id, page, count(*) AS n FROM claims_v GROUP BY ALL), k AS (SELECT DISTINCT a.* FROM v a JOIN v b ON a.subject = b.subject AND a.predicate = b.predicate AND a.parameter_role = b.parameter_role AND a.location = b.location AND a.sc = b.sc AND a.pressure_basis = b.pressure_basis AND a.qualifier = b.qualifier AND a.unit = b.unit AND (a.document_id <> b.document_id OR a.page <> b.page) AND "
query("val6_contradictions", CONFLICT + "abs(a.numeric_value - b.numeric_value) > 1e-6) SELECT subject, unit, numeric_value, document_id, page, n AS n_claims FROM k")(lambda t: claims.linked_conflicts(t.claims_v).where("n_conflicting > 0").select("subject", "unit", "numeric_value", "document_id", "page", "n_claims"))
query("joi8_corroborations", CONFLICT + "a.numeric_value = b.numeric_value) SELECT subject, unit, numeric_value, document_id, page, n AS n_claims FROM k")(lambda t: claims.linked_conflicts(t.claims_v).where("n_corroborating > 0").select("subject", "unit", "numeric_value", "document_id", "page", "n_claims"))
query("joi12_scenario_alignment", "SELECT predicate, parameter_role, max(CASE WHEN scenario = 'BH' THEN numeric_value END) AS bh, max(CASE WHEN scenario = 'PG' THEN numeric_value END) AS pg, max(CASE WHEN scenario = '' THEN numeric_value END) AS base FROM claims_v GROUP BY predicate, parameter_role")(
    lambda t: claims.side_by_side(t.claims_v, ["predicate", "parameter_role"], "scenario", {"BH": "bh", "PG": "pg", "": "base"}))
query("gra11_context_bundle", "SELECT c.chunk_id, 'claim' AS facet, count(*) AS n FROM claims_v c GROUP BY c.chunk_id UNION ALL SELECT c.chunk_id, 'entity', count(DISTINCT e.entity_uid) FROM claims_v c JOIN entities_v e ON e.canonical_tag = c.subject GROUP BY c.chunk_id")(
    lambda t: claims.context_bundle(t.claims_v, t.entities_v))
FAULTS = "SELECT p_partkey AS chunk_id, concat(CASE p_partkey % 5 WHEN 0 THEN 'The low flow is caused by a choked strainer of ' WHEN 1 THEN 'Check the suction pressure gauge of ' WHEN 2 THEN 'The valve has to be opened slowly near ' WHEN 3 THEN 'Short ' ELSE 'The column stands quietly in the yard of ' END, p_name, '. Leak in ', p_brand) AS text FROM part"
query("qry8_diagnosis", f"""SELECT chunk_id, s AS sentence, kind, CAST(1 AS INT) AS rank FROM (SELECT chunk_id, string_split(text, '. ')[1] || '.' AS s, ['cause', 'check', 'action'][chunk_id % 5 + 1] AS kind FROM ({FAULTS}) x WHERE chunk_id % 5 < 3)""")(
    lambda t: requests.diagnosis(t.sql(FAULTS), "chunk_id", "text"))
query("qry11_explanation", BM25.replace("rank <= 10", "rank <= 6"))(lambda t: retrieval.bm25(t.documents, t.benchmark.select(F.col("item_id").alias("request_id"), "text"), 6, key="doc_id").select("request_id", "doc_id", "rank"))
TASK_LIST = list(plans.TEMPLATES)
SECONDARY = ["", "procedure", "safety,cross_document,provenance", "limits", "conflict,planning", "troubleshooting,procedure,report", "provenance,cross_document", "safety,limits,planning"]
ASKED = f"""SELECT p_partkey AS request_id, CASE p_partkey % 16 {' '.join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TASK_LIST))} ELSE 'poetry' END AS task, CASE p_size % 8 {' '.join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(SECONDARY))} END AS listed,
  p_partkey % 3 = 0 AS has_entity, p_size % 5 < 2 AS has_value, p_partkey % 4 = 0 AS has_mentions, p_size % 7 = 0 AS wants_report FROM part"""
needs_text = lambda needs: ",".join(needs)
STEP_ROWS = [(t, i, s[0], s[1], needs_text(s[2]), s[3], s[4]) for t, steps in plans.TEMPLATES.items() for i, s in enumerate(steps)]
EXTRA_ROWS = [(t, key, i, s[0], s[1], needs_text(s[2]), s[3], s[4]) for i, (t, key, s) in enumerate(plans.EXTENSIONS)]
PLANNED = f"""WITH q AS ({ASKED}), t0 AS (SELECT request_id, q.task, i, step, agent, needs, mode, flags FROM q JOIN {values(STEP_ROWS, 'task, i, step, agent, needs, mode, flags')} ON r.task = CASE WHEN q.task = 'poetry' THEN 'lookup' ELSE q.task END
    WHERE (NOT contains(flags, 'e') OR has_entity) AND (NOT contains(flags, 'v') OR has_value) AND (NOT contains(flags, 'n') OR NOT has_value)),
  a AS (SELECT request_id, coalesce(arg_min(step, i) FILTER (WHERE agent IN ('lookup', 'procedure', 'diagnostic')), arg_max(step, i)) AS anchor, list(agent) AS agents FROM t0 GROUP BY request_id),
  l AS (SELECT request_id, unnest(string_split(listed, ',')) AS task, generate_subscripts(string_split(listed, ','), 1) AS pos FROM q WHERE listed <> '' AND q.task <> 'ambiguous'),
  x AS (SELECT l.request_id, pos, r.i, r.key, r.step, r.agent, replace(r.needs, '@', anchor) AS needs, r.mode, r.flags FROM l JOIN {values(EXTRA_ROWS, 'task, key, i, step, agent, needs, mode, flags')} ON r.task = l.task JOIN a ON a.request_id = l.request_id JOIN q ON q.request_id = l.request_id
    WHERE NOT list_contains(agents, r.key) AND (NOT contains(r.flags, 'e') OR q.has_entity) QUALIFY pos = min(pos) OVER (PARTITION BY l.request_id, r.key)),
  u AS (SELECT request_id, i AS o, step, agent, needs, mode, flags FROM t0 UNION ALL SELECT request_id, 100 + pos * 20 + i, step, agent, needs, mode, flags FROM x),
  m AS (SELECT * FROM u UNION ALL SELECT q.request_id, 900, 'assemble2', 'planner', (SELECT string_agg(step, ',' ORDER BY o) FROM (SELECT step, o FROM u WHERE u.request_id = q.request_id AND agent <> 'planner' ORDER BY o DESC LIMIT 6) z), 'assemble', 'o' FROM q
    WHERE q.task NOT IN ('ambiguous', 'planning') AND list_contains(string_split(listed, ','), 'planning')),
  n AS (SELECT * FROM m UNION ALL SELECT q.request_id, 901, 'report2', 'report', (SELECT string_agg(step, ',' ORDER BY o) FROM (SELECT step, o FROM m WHERE m.request_id = q.request_id AND agent <> 'report' ORDER BY o DESC LIMIT 8) z), 'assemble', 'o' FROM q
    WHERE q.task NOT IN ('ambiguous', 'report') AND (list_contains(string_split(listed, ','), 'report') OR wants_report)),
  p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY o)::INT AS place FROM n QUALIFY place <= 12), ids AS (SELECT request_id, list(step) AS ids FROM p GROUP BY request_id)
  SELECT p.request_id, place, step, agent, array_to_string(list_filter(string_split(needs, ','), lambda d: list_contains(ids, d)), ',') AS needs, mode, contains(flags, 'o') OR (agent IN ('graph', 'procedure', 'calculation') AND NOT has_entity AND NOT has_mentions) AS optional, contains(flags, 's') AS safety
  FROM p JOIN ids ON ids.request_id = p.request_id JOIN q ON q.request_id = p.request_id"""
query("qry17_plan_steps", PLANNED)(
    lambda t: plans.plan_steps(t.sql(ASKED).withColumn("secondary", F.expr("filter(split(listed, ','), x -> x <> '')"))).withColumn("needs", F.array_join("needs", ",")))
query("qry17_task_plans", f"WITH p AS (SELECT request_id, {TASKS} AS task FROM prompts_v), s AS (SELECT * FROM {values(STEP_ROWS, 'task, i, step, agent, needs, mode, flags')}) SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY i) AS INT) AS place, step, needs FROM p JOIN s ON s.task = p.task WHERE NOT contains(flags, 'e') AND NOT contains(flags, 'v')")(
    lambda t: plans.plan_steps(requests.classify_tasks(t.prompts_v).select("request_id", "task", F.lit(None).cast("array<string>").alias("secondary"), *[F.lit(False).alias(x) for x in ("has_entity", "has_value", "has_mentions", "wants_report")]))
    .select("request_id", "place", "step", F.array_join("needs", ",").alias("needs")))
query("aud5_verify_all", "SELECT count(DISTINCT user_id) AS n_logs, count(*) AS n_entries, true AS all_hold FROM events")(
    lambda t: audit.verify(audit.append(t.sql(LOG), "user_id", ["event_id"]), "user_id").agg(F.count(F.lit(1)).alias("n_logs"), F.sum("n").alias("n_entries"), F.min("holds").alias("all_hold")))
query("src12_log_appended", "SELECT event_id, event_type FROM events")(lambda t: files.appended(t.events.select("event_id", "event_type").where("event_id % 2 = 0"), t.events.select("event_id", "event_type").where("event_id % 2 = 1")))
PIECES = "SELECT CAST(l_orderkey AS STRING) AS document_id, concat(CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS chunk_id, concat(CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING)) AS element_id, l_partkey AS reading_order FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey"
GIVEN = PIECES.rsplit(" GROUP BY", 1)[0]  # repeated rows and all: a chunk takes an element once, so they need no shuffle of their own
query("src5_chunks_with_elements", f"SELECT chunk_id, count(*) AS n, string_agg(element_id, ',' ORDER BY reading_order, element_id) AS elements FROM ({PIECES}) x GROUP BY chunk_id")(
    lambda t: files.stored_chunks(t.sql(GIVEN).groupBy("document_id", "chunk_id").agg(F.collect_set("element_id").alias("element_ids")), t.sql(GIVEN).select("document_id", "element_id", "reading_order").dropDuplicates(["document_id", "element_id"]).withColumn("content", F.concat(F.lit("c"), "element_id")))
    .select("chunk_id", F.size("elements").cast("long").alias("n"), F.array_join(F.transform("elements", lambda e: e["element_id"]), ",").alias("elements")))
