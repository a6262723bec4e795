"""Queries over checks, tables and chunks."""

from pyspark.sql import functions as F

from ..operators import checks as op
from ..operators import grounding
from ..operators import tables
from .registry import query

query("val7_validation_summary", """WITH s AS (SELECT source, CASE WHEN grounding = 'weak' THEN 'WARN' WHEN numeric_value > 45 THEN 'ERROR' ELSE 'OK' END AS severity FROM claims_v)
  SELECT source, count(*) AS n, count(*) FILTER (WHERE severity = 'OK') AS ok, count(*) FILTER (WHERE severity = 'WARN') AS warn, count(*) FILTER (WHERE severity = 'ERROR') AS error, NOT bool_or(severity = 'ERROR') AS passed FROM s GROUP BY source""")(
    lambda t: op.validation_summary(t.claims_v.withColumn("severity", F.when(F.col("grounding") == "weak", "WARN").when(F.col("numeric_value") > 45, "ERROR").otherwise("OK")), ["source"]))
query("val8_recall_by_source", "SELECT source, count(*) FILTER (WHERE numeric_value <= 45) AS accepted_n, count(*) FILTER (WHERE numeric_value > 45) AS rejected_n, count(*) FILTER (WHERE grounding = 'weak' AND numeric_value <= 45) AS weak_n FROM claims_v GROUP BY source")(
    lambda t: op.recall_by_source(t.claims_v, F.col("numeric_value") <= 45, F.col("grounding") == "weak"))
PARSED = "SELECT concat('d', CAST(l_suppkey AS STRING)) AS document_id, CAST(1 + l_orderkey % 97 AS INT) AS page, CAST(l_orderkey % 97 AS BIGINT) * 100000 + l_partkey AS reading_order, 'text' AS element_type, CASE WHEN l_partkey % 40 = 0 THEN '[figure]' WHEN l_partkey % 3 = 0 THEN ' ' ELSE 'words' END AS content FROM lineitem WHERE l_quantity > 20"
PAGED = "SELECT DISTINCT concat('d', CAST(s_suppkey AS STRING)) AS document_id, CAST(90 + s_suppkey % 20 AS INT) AS total_pages FROM supplier"
query("val9_parse_checks", f"""WITH e AS ({PARSED}), d AS ({PAGED}), p AS (SELECT DISTINCT d.document_id, page, total_pages FROM e JOIN d USING (document_id) WHERE trim(content) <> '' AND page BETWEEN 1 AND total_pages),
  empty AS (SELECT document_id, i AS page FROM (SELECT document_id, unnest(range(1, total_pages + 1)) AS i FROM d) x WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.document_id = x.document_id AND p.page = x.i)),
  runs AS (SELECT document_id, count(*) AS n FROM (SELECT *, page - row_number() OVER (PARTITION BY document_id ORDER BY page) AS island FROM empty) GROUP BY document_id, island), longest AS (SELECT document_id, max(n) AS n FROM runs GROUP BY document_id),
  f AS (SELECT d.document_id, count(*) - count(DISTINCT reading_order) AS order_unique, count(*) FILTER (WHERE page > total_pages) AS outside, count(*) FILTER (WHERE content = '[figure]') AS placeholder FROM e JOIN d USING (document_id) GROUP BY d.document_id),
  k AS (SELECT d.document_id, 'coverage' AS "check", coalesce(c.n, 0) AS n, coalesce(c.n, 0) >= total_pages * 0.9 AS ok FROM d LEFT JOIN (SELECT document_id, count(*) AS n FROM p GROUP BY document_id) c USING (document_id) UNION ALL SELECT d.document_id, 'empty_run', coalesce(longest.n, 0), coalesce(longest.n, 0) < 3 FROM d LEFT JOIN longest USING (document_id)
    UNION ALL SELECT d.document_id, 'order_unique', coalesce(order_unique, 0), coalesce(order_unique, 0) = 0 FROM d LEFT JOIN f USING (document_id) UNION ALL SELECT document_id, 'order_monotonic', 0, true FROM d
    UNION ALL SELECT d.document_id, 'outside', coalesce(outside, 0), coalesce(outside, 0) = 0 FROM d LEFT JOIN f USING (document_id) UNION ALL SELECT d.document_id, 'placeholder', coalesce(placeholder, 0), coalesce(placeholder, 0) = 0 FROM d LEFT JOIN f USING (document_id))
  SELECT document_id, "check", CAST(n AS BIGINT) AS n, ok FROM k""")(lambda t: op.parse_checks(t.sql(PARSED), t.sql(PAGED)))
query("val11_quality_gate", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE length(coalesce(text, '')) < 50) AS heading_only, count(*) FILTER (WHERE length(text) > 8000) AS over_max, count(*) FILTER (WHERE contains(text, '@')) AS contaminated FROM documents GROUP BY lang")(lambda t: op.quality_gate(t.documents, "lang"))
query("val12_graph_integrity", """SELECT 'orphan' AS kind, count(*) AS n FROM relations_v r WHERE r.rel_type = 'FEEDS' AND NOT EXISTS (SELECT 1 FROM part p WHERE 'p' || p.p_partkey = r.target_uid) UNION ALL SELECT 'duplicate', count(*) FROM (SELECT source_uid FROM relations_v WHERE rel_type = 'FEEDS' GROUP BY source_uid, rel_type, target_uid HAVING count(*) > 1) AS d
  UNION ALL SELECT 'null', count(*) FROM entities_v WHERE entity_type IS NULL""")(
    lambda t: op.graph_integrity(t.relations_v.where("rel_type = 'FEEDS'"), t.part.select(F.concat(F.lit("p"), "p_partkey").alias("uid")), t.entities_v))
query("val13_provenance", "SELECT doc_id, md5(source || '|' || doc_id || '|' || text) AS evidence_hash, source IS NOT NULL AND text IS NOT NULL AS complete FROM documents")(lambda t: op.provenance(t.documents, "source", "doc_id", "text").select("doc_id", "evidence_hash", "complete"))
STATEMENTS = "SELECT document_id AS answer_id, claim_id AS statement_id, concat('Flow of ', CAST(page AS STRING), '.0 and ', CASE WHEN page % 3 = 0 THEN '1,250' ELSE value END, ' on p. 77, step 99') AS text, CASE WHEN page = 5 THEN array() ELSE array(chunk_id, concat('v', value)) END AS evidence_keys FROM claims_v"
EVIDENCE = "SELECT chunk_id AS evidence_key, 'It reads 1 or 2 or 4, at 1250.0.' AS text FROM claims_v GROUP BY chunk_id UNION ALL SELECT DISTINCT concat('v', value), concat('value ', value, '.00') FROM claims_v"
query("val14_answer_verification", """WITH s AS (SELECT document_id AS answer_id, page, CASE WHEN page % 3 = 0 THEN 1250 ELSE value::DOUBLE END AS claimed, value::DOUBLE AS cited FROM claims_v),
  h AS (SELECT answer_id, page <> 5 AND (page IN (1, 2, 4) OR page = cited OR page = 1250) AND (claimed IN (1, 2, 4, 1250) OR claimed = cited) AS holds FROM s) SELECT answer_id, count(*) AS checked, count(*) FILTER (WHERE holds) AS held, count(*) FILTER (WHERE holds) / count(*) AS score FROM h GROUP BY answer_id""")(
    lambda t: op.verify_answers(t.sql(STATEMENTS), t.sql(EVIDENCE)))
query("val15_uncorroborated", "SELECT c.claim_id FROM claims_v c WHERE NOT EXISTS (SELECT 1 FROM claims_v d WHERE d.subject = c.subject AND d.document_id = c.document_id AND d.numeric_value = c.numeric_value AND d.claim_id <> c.claim_id) AND c.numeric_value > 48")(
    lambda t: op.uncorroborated(t.claims_v, F.col("numeric_value") > 48).select("claim_id"))
COMPOSED = """SELECT p_partkey AS answer_id, concat('The unit runs at ', CAST(p_size AS STRING), '.0 and ', CAST(60 + p_partkey % 5 AS STRING), ' with ', tag, ' (', CASE p_partkey % 5 WHEN 0 THEN 'boiler feed tank' WHEN 1 THEN p_name WHEN 2 THEN 'normal' WHEN 3 THEN concat('atmospheric ', p_name) ELSE 'A/B' END, ') and 99-X-1') AS answer,
  concat('Rated ', CAST(p_size AS STRING), ', 61 at ', tag) AS brief, concat('e', CAST(p_partkey AS STRING)) AS entity_uid, tag AS canonical_tag, CASE WHEN p_partkey % 5 = 3 THEN concat('vacuum ', p_name) ELSE p_name END AS name, 'Pump' AS entity_type, 3 AS mention_count, p_size, p_partkey, p_name
  FROM (SELECT *, concat(CAST(10 + p_partkey % 3 AS STRING), '-P-', lpad(CAST(p_partkey % 40000 AS STRING), 5, '0')) AS tag FROM part) t"""
query("val15_composer_grounding", f"""SELECT answer_id, list_sort(list_filter(list_distinct([60.0 + p_partkey % 5, 99.0, 1.0]::DOUBLE[]), lambda x: x NOT IN (p_size, 61, 10 + p_partkey % 3, p_partkey % 40000))) AS figures, ['99-X-1'] AS tags FROM ({COMPOSED}) c""")(
    lambda t: grounding.unsupported(t.sql(COMPOSED)).select("answer_id", "figures", "tags"))
query("val15_misnamed_tags", f"""WITH c AS (SELECT *, list_distinct(regexp_extract_all(CASE p_partkey % 5 WHEN 0 THEN 'boiler feed tank' WHEN 1 THEN p_name WHEN 3 THEN 'atmospheric ' || p_name ELSE '' END, '[a-z]{{4,}}')) AS w, lower(name || ' pump ' || canonical_tag) AS documented FROM ({COMPOSED}) x),
  s AS (SELECT *, len(list_filter(w, lambda v: contains(documented, v))) AS shared FROM c WHERE len(w) > 0)
  SELECT answer_id, canonical_tag AS tag, CASE WHEN shared * 2 < len(w) THEN 'name' ELSE 'qualifier' END AS kind FROM s WHERE shared * 2 < len(w) OR p_partkey % 5 = 3""")(
    lambda t: (lambda c: grounding.misnamed(c, c.select("entity_uid", F.explode(F.array("name", "canonical_tag")).alias("alias")), c, about="entity_uid").select("answer_id", "tag", "kind"))(t.sql(COMPOSED)))
query("val17_draft_flags", "SELECT value, unit, document_id, min(claim_id) AS claim_id, count(*) AS n FROM claims_v WHERE grounding = 'weak' GROUP BY value, unit, document_id")(lambda t: op.draft_flags(t.claims_v))
query("val10_representative_tables", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 20 THEN 3 ELSE 0 END + CASE WHEN p_type LIKE '%STEEL%' THEN 1 ELSE 0 END DESC, p_partkey) = 1")(
    lambda t: op.representative(t.part, "p_brand", "p_partkey", F.when(F.col("p_size") > 20, 3).otherwise(0) + F.when(F.col("p_type").contains("STEEL"), 1).otherwise(0)))

OPENED = "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'text' WHEN 2 THEN 'figure' WHEN 3 THEN 'page_header' END AS element_type, CASE p_partkey % 6 WHEN 0 THEN concat('  Warning: ', p_name) WHEN 1 THEN 'N.B. keep' WHEN 2 THEN 'Safety note of it' WHEN 3 THEN 'Notes on it' ELSE p_name END AS content FROM part"
query("flt2_content_type", "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'warning' WHEN p_partkey % 6 = 1 THEN 'note' WHEN p_partkey % 6 = 2 THEN 'safety_note' WHEN p_size % 5 = 0 THEN 'heading' WHEN p_size % 5 = 2 THEN 'figure_caption' ELSE 'paragraph' END AS content_type FROM part")(
    lambda t: t.sql(OPENED).select("p_partkey", tables.content_type("element_type", "content").alias("content_type")))
APPROVED = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('Prepared by: A  Checked by: ', p_name) WHEN 1 THEN concat('Signature ', p_name) WHEN 2 THEN concat('Approved by B, signature ', repeat(p_name, 30)) ELSE p_name END AS content, p_size % 12 AS rows FROM part"
query("flt6_approval_tables", f"SELECT p_partkey, p_partkey % 4 IN (0, 2) AND rows <= 8 AND length(content) < 400 AS approval FROM ({APPROVED}) x")(lambda t: t.sql(APPROVED).select("p_partkey", tables.is_approval("content", F.col("rows")).alias("approval")))
LABELS = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(initcap(p_name), ' of the unit') WHEN 2 THEN concat(upper(p_brand), ' and ', p_name) ELSE repeat(concat(initcap(p_name), ' '), 9) END AS label FROM part"
query("flt9_label_text", "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN len(string_split(p_name, ' ')) * 2 >= len(string_split(p_name, ' ')) + 1 WHEN 2 THEN len(string_split(p_name, ' ')) <= 1 WHEN 3 THEN len(string_split(p_name, ' ')) * 9 <= 18 AND length(p_name) * 9 + 8 <= 120 ELSE false END AS label FROM part")(
    lambda t: t.sql(LABELS).select("p_partkey", tables.is_label("label").alias("label")))
SHAPED = "SELECT CAST(o_orderkey AS STRING) AS table_id, o_orderkey AS ord, array(upper(concat(' ', o_orderstatus)), concat(o_orderpriority, '  x'), '', 'Unit') AS headers, CAST(o_custkey % 5 AS INT) AS num_rows, 4 AS num_cols FROM orders"
query("stc11_table_signatures", """WITH s AS (SELECT o_orderkey, list_sort([lower(o_orderstatus), lower(o_orderpriority) || ' x', 'unit']) AS h, o_custkey % 5 AS r FROM orders) SELECT CAST(o_orderkey AS VARCHAR) AS table_id, array_to_string(h, '|') AS signature, substr(md5(r || '|4|' || array_to_string(list_sort(list_append(h, '')), '|')), 1, 16) AS shape_hash,
  nullif(min(o_orderkey) OVER (PARTITION BY h, r), o_orderkey)::VARCHAR AS duplicate_of FROM s""")(lambda t: tables.signatures(t.sql(SHAPED)).select("table_id", "signature", "shape_hash", "duplicate_of"))
COLUMNS = "SELECT CAST(l_orderkey AS STRING) AS table_id, row, c AS col, CASE c WHEN 0 THEN concat('11-P-', CAST(l_linenumber AS STRING)) WHEN 1 THEN CAST(l_linenumber * 2 AS STRING) WHEN 2 THEN CASE WHEN l_quantity > 10 THEN CAST(l_linenumber AS STRING) ELSE 'Nil' END ELSE CASE WHEN l_quantity > 10 THEN '12-E-1' ELSE '' END END AS content FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS row FROM lineitem) AS x LATERAL VIEW explode(sequence(0, 3)) AS c"
query("stc13_column_typing", """WITH n AS (SELECT l_orderkey, bool_and(l_quantity > 10) AS numbers FROM lineitem GROUP BY l_orderkey) SELECT CAST(l_orderkey AS VARCHAR) AS table_id, c AS col, CASE c WHEN 0 THEN 'tag' WHEN 1 THEN 'numeric' WHEN 3 THEN 'tag' ELSE CASE WHEN numbers THEN 'numeric' ELSE 'text' END END AS data_type FROM n, (VALUES (0), (1), (2), (3)) AS v(c)""")(
    lambda t: tables.column_types(t.sql(COLUMNS)))
query("stc13_repeated_rows", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS row FROM lineitem), f AS (SELECT l_orderkey, min(row) AS row FROM r GROUP BY l_orderkey, l_linenumber, l_quantity > 10) SELECT CAST(l_orderkey AS VARCHAR) AS table_id, CAST(row AS INT) AS "row", count(*) * 4 AS n FROM f GROUP BY ALL""")(
    lambda t: tables.drop_repeated_rows(t.sql(COLUMNS)).groupBy("table_id", "row").agg(F.count(F.lit(1)).alias("n")))
CHUNKS = "SELECT p_partkey, p_partkey % 7 > 0 AS is_engineering, 100 AS tokens, p_size * 2 AS procedure_tokens, p_partkey % 80 AS table_tokens, p_size % 5 AS n_spec_pairs, CASE p_partkey % 5 WHEN 0 THEN 'A > Upset response' WHEN 1 THEN 'B > Safety' WHEN 2 THEN 'C > Interlock' WHEN 3 THEN 'D > Pumps' ELSE 'E' END AS section_path FROM part"
query("stc20_chunk_typing", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'document_control' WHEN p_size >= 20 THEN 'procedure' WHEN p_partkey % 80 >= 50 THEN 'table' WHEN p_size % 5 >= 3 THEN 'specification' ELSE ['upset', 'safety', 'control', 'equipment', 'narrative'][p_partkey % 5 + 1] END AS chunk_type FROM part")(
    lambda t: tables.chunk_type(t.sql(CHUNKS)).select("p_partkey", "chunk_type"))
SAID = "SELECT conv_id, turn, concat('C > ', CAST(turn AS STRING)) AS section_path, CASE WHEN turn % 3 = 0 THEN 'One thing. Two things! Three?' WHEN turn % 3 = 1 THEN 'Only this' ELSE '' END AS text FROM (SELECT DISTINCT conv_id, turn FROM turns_v) AS x"
query("stc21_overlap_bridge", f"WITH s AS ({SAID}), b AS (SELECT *, coalesce(lag(CASE WHEN turn % 3 = 0 THEN 'Two things! Three?' WHEN turn % 3 = 1 THEN 'Only this' ELSE '' END) OVER (PARTITION BY conv_id ORDER BY turn), '') AS bridge FROM s) SELECT conv_id, turn, bridge, concat_ws(chr(10), section_path, nullif(bridge, ''), nullif(text, '')) AS retrieval_text FROM b")(
    lambda t: tables.overlap_bridge(t.sql(SAID), "conv_id", "turn").select("conv_id", "turn", "bridge", "retrieval_text"))
ROWS = "SELECT p_brand AS document_id, p_size AS number, concat(p_name, ' ...... ', CAST(p_partkey AS STRING)) AS title, p_partkey AS page FROM part"
query("stc1_contents", "WITH f AS (SELECT p_brand AS document_id, p_size AS number, arg_min(p_name, p_partkey) AS title, min(p_partkey) AS page_start FROM part GROUP BY ALL) SELECT *, coalesce(lead(page_start) OVER (PARTITION BY document_id ORDER BY number) - 1, 9999) AS page_end FROM f")(lambda t: tables.contents(t.sql(ROWS)))
RANGES = "SELECT p_brand AS document_id, p_size AS chapter, min(p_partkey) AS first_page, max(p_partkey) AS last_page, p_size % 3 AS priority FROM part GROUP BY p_brand, p_size"
PAGES = "SELECT DISTINCT p_brand AS document_id, l_partkey AS page FROM lineitem JOIN part ON l_suppkey = p_partkey"
query("stc2_page_chapter_map", f"SELECT document_id, page, arg_min(chapter, (priority, chapter)) AS chapter FROM ({PAGES}) p JOIN ({RANGES}) r USING (document_id) WHERE page BETWEEN first_page AND last_page GROUP BY ALL")(lambda t: tables.chapter_pages(t.sql(PAGES), t.sql(RANGES)))
HEADS = "SELECT concat('d', CAST(o_custkey % 50 AS STRING)) AS document_id, o_orderkey AS ord, CAST(1 + o_custkey % 4 AS INT) AS level, o_orderkey AS page FROM orders"
query("stc4_section_ends", f"WITH h AS ({HEADS}) SELECT document_id, ord, greatest(page, coalesce((SELECT min(n.page) - 1 FROM h n WHERE n.document_id = h.document_id AND n.ord > h.ord AND n.level <= h.level), 99999)) AS page_end FROM h")(
    lambda t: tables.section_ends(t.sql(HEADS), 99999).select("document_id", "ord", "page_end"))
LISTED = "SELECT CAST(l_orderkey AS STRING) AS table_id, concat_ws('-', CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING)) AS row, c AS col, CASE c WHEN 0 THEN 'x' WHEN 1 THEN concat('11-P-', CAST(l_partkey AS STRING)) ELSE concat('pump no ', CAST(l_linenumber AS STRING), ' at ', CAST(l_partkey AS STRING)) END AS content, false AS is_header FROM lineitem LATERAL VIEW explode(sequence(0, 2)) AS c UNION ALL SELECT CAST(o_orderkey AS STRING), '', 2, 'Service', true FROM orders"
query("ext9_equipment_columns", """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem), n AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_partkey < 100000) >= 2 AND count(*) FILTER (l_partkey < 100000) * 3 >= count(*)) SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS table_id, '11-P-' || l_partkey AS tag, 'pump no ' || l_linenumber || ' at ' || l_partkey AS description FROM l WHERE l_partkey < 100000 AND l_orderkey IN (FROM n)""")(
    lambda t: tables.equipment_columns(t.sql(LISTED)))
