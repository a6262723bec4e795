"""Queries of the index, its registers and what is retrieved from it."""

from pyspark.sql import functions as F

from ..functions.vocabulary import ACRONYMS, DOCUMENT_TYPES
from ..operators import claims, index, registers, retrieval, security
from .documents import BM25, FUSED
from .registry import query

DRAFTS = "SELECT concat('e', CAST(p_partkey % 90 AS STRING)) AS entity_uid, max(CASE WHEN p_partkey % 90 % 4 > 0 THEN concat('11-P-', CAST(p_partkey % 90 AS STRING)) ELSE '' END) AS canonical_tag, min(p_name) AS name, min(p_type) AS entity_type FROM part GROUP BY p_partkey % 90"
MENTIONED = """SELECT concat('e', CAST(CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_partkey % 80 END AS STRING)) AS entity_uid, CASE (l_suppkey + l_partkey) % 6 WHEN 0 THEN NULL WHEN 1 THEN 'lpg feed pump' WHEN 2 THEN 'BH/PG VGO PUMP 2A' WHEN 3 THEN concat('Crude ', CAST(l_partkey % 3 AS STRING)) WHEN 4 THEN '' ELSE 'o''neil id fan' END AS name,
  CASE WHEN l_linenumber = 3 THEN '' ELSE concat('alias ', CAST(l_partkey % 120 AS STRING)) END AS alias, CAST(l_orderkey % 500 AS INT) AS page, l_orderkey * 10 + l_linenumber AS place FROM lineitem"""
SHOWN = "array_to_string(list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda x: CASE WHEN list_contains({1}, x) THEN upper(x) ELSE x END), '')"
TITLED = "array_to_string(list_transform(regexp_extract_all(name, '\\p{L}+|[^\\p{L}]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"
query("ext13_entity_records", f"""WITH m AS ({MENTIONED}), v AS (SELECT entity_uid, name, count(*) AS n, min(place) AS place FROM m WHERE name <> '' GROUP BY ALL),
  b AS (SELECT entity_uid, {SHOWN.format(f"CASE WHEN lower(name) <> upper(name) AND name IN (lower(name), upper(name)) THEN {TITLED} ELSE name END", list(ACRONYMS))} AS shown FROM v QUALIFY row_number() OVER (PARTITION BY entity_uid ORDER BY n DESC, place, name) = 1),
  l AS (SELECT entity_uid, list_sort(list_distinct(list(alias) FILTER (WHERE alias <> '')))[:40] AS aliases, list_sort(list_distinct(list(page)))[:200] AS pages, count(*) AS n FROM m GROUP BY entity_uid)
  SELECT d.entity_uid, CASE WHEN shown IS NULL THEN CASE WHEN canonical_tag <> '' THEN canonical_tag ELSE d.name END WHEN canonical_tag <> '' THEN shown || ' (' || canonical_tag || ')' ELSE shown END AS name, entity_type, coalesce(array_to_string(aliases, '|'), '') AS aliases, coalesce(array_to_string(pages, '|'), '') AS pages, coalesce(n, 0) AS mention_count
  FROM ({DRAFTS}) d LEFT JOIN b USING (entity_uid) LEFT JOIN l USING (entity_uid)""")(
    lambda t: index.assemble_index(t.sql(DRAFTS), t.sql(MENTIONED)).select("entity_uid", "name", "entity_type", F.array_join("aliases", "|").alias("aliases"), F.array_join(F.col("pages").cast("array<string>"), "|").alias("pages"), "mention_count"))

AROUND = """SELECT p_partkey AS chunk_id, concat('The ', p_name, ' P-', CAST(10 + p_partkey % 60 AS STRING), CASE WHEN p_size % 3 = 0 THEN ' feeds E101A and P-12, ' ELSE ' stands by P-12; ' END, p_type) AS text, CASE WHEN p_size % 4 > 0 THEN concat('S', CAST(p_size % 12 AS STRING)) ELSE '' END AS section_path FROM part"""
THINGS = "SELECT concat('s', CAST(s_suppkey AS STRING)) AS entity_uid, CASE WHEN s_suppkey % 2 = 0 THEN concat('p-', CAST(10 + s_suppkey % 70 AS STRING)) END AS canonical_tag, concat('P-', CAST(10 + s_suppkey % 50 AS STRING)) AS name, CASE WHEN s_suppkey % 5 > 0 THEN concat('S', CAST(s_suppkey % 9 AS STRING)) END AS section FROM supplier"
CALLED = "SELECT concat('s', CAST(s_suppkey AS STRING)) AS entity_uid, CASE WHEN s_suppkey % 7 = 0 THEN 'E101A' ELSE 'p-12' END AS alias FROM supplier"
FACTS = "SELECT DISTINCT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS claim_id, concat('s', CAST(l_suppkey AS STRING)) AS entity_uid, CAST(l_orderkey % 10 AS INT) AS confidence FROM lineitem"
TERMS = "SELECT DISTINCT CAST(p_size AS BIGINT) AS place, split_part(p_type, ' ', 1 + p_size % 3) AS term, concat('m', CAST(p_size AS STRING)) AS meaning FROM part WHERE p_size > 2 UNION ALL SELECT 1, 'st', 'short' UNION ALL SELECT 2, 'The ', 'article'"
LISTED = "row_number() OVER (PARTITION BY {0} ORDER BY {1}) AS r, count(*) OVER (PARTITION BY {0}) AS n"
query("gra11_context_facets", f"""WITH c AS ({AROUND}), e AS ({THINGS}), a AS ({CALLED}), k AS ({FACTS}), g AS ({TERMS}), nm AS (SELECT chunk_id, unnest(regexp_extract_all(text, '\\b[A-Z]{{1,4}}-?\\d{{2,5}}[A-Z]?\\b')) AS via, generate_subscripts(regexp_extract_all(text, '\\b[A-Z]{{1,4}}-?\\d{{2,5}}[A-Z]?\\b'), 1) AS pos FROM c),
  d AS (SELECT chunk_id, via, min(pos) AS pos FROM nm GROUP BY ALL), s AS (SELECT entity_uid, lower(name) AS key FROM e UNION SELECT entity_uid, lower(alias) FROM a), lo AS (SELECT DISTINCT entity_uid, lower(key) AS key FROM (SELECT * FROM s UNION ALL SELECT entity_uid, canonical_tag FROM e) x WHERE key <> ''),
  x AS (SELECT key, entity_uid AS item, {LISTED.format('key', 'entity_uid')} FROM s), y AS (SELECT key, entity_uid AS item, {LISTED.format('key', 'entity_uid')} FROM lo),
  met AS (SELECT DISTINCT chunk_id, item AS entity_uid FROM d JOIN x ON key = lower(via) AND r <= 40), kk AS (SELECT entity_uid, claim_id AS item, {LISTED.format('entity_uid', 'confidence DESC, claim_id')} FROM k),
  rel AS (SELECT source_uid AS a, target_uid AS b, concat_ws('>', source_uid, rel_type, target_uid) AS edge FROM relations_v), sd AS (SELECT DISTINCT * FROM (SELECT * FROM rel UNION ALL SELECT b, a, edge FROM rel) z), ed AS (SELECT a, edge AS item, {LISTED.format('a', 'edge')} FROM (SELECT DISTINCT a, edge FROM sd) z),
  re AS (SELECT a, b AS item, {LISTED.format('a', 'b')} FROM (SELECT DISTINCT a, b FROM sd WHERE a <> b) z), se AS (SELECT section, entity_uid AS item, {LISTED.format('section', 'entity_uid')} FROM e WHERE section <> ''),
  gl AS (SELECT chunk_id, term, meaning, place, row_number() OVER (PARTITION BY chunk_id ORDER BY place, term) AS r FROM c JOIN (SELECT * FROM g WHERE term <> '' QUALIFY row_number() OVER (PARTITION BY upper(term) ORDER BY place, term, meaning) = 1) q ON contains(upper(text), upper(term))),
  u AS (SELECT chunk_id, 'name' AS facet, '' AS via, count(*) OVER (PARTITION BY chunk_id) AS n, via AS item, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS r, 30 AS most FROM d UNION ALL SELECT chunk_id, 'entity', via, n, item, r, 40 FROM d JOIN x ON key = lower(via) UNION ALL SELECT chunk_id, 'identity', via, n, item, r, 40 FROM d JOIN y ON key = lower(via)
    UNION ALL SELECT chunk_id, 'claim', entity_uid, n, item, r, 20 FROM met JOIN kk USING (entity_uid) UNION ALL SELECT chunk_id, 'relation', entity_uid, n, item, r, 20 FROM met JOIN ed ON a = entity_uid UNION ALL SELECT chunk_id, 'related', entity_uid, n, item, r, 15 FROM met JOIN re ON a = entity_uid
    UNION ALL SELECT chunk_id, 'section', section, n, item, r, 20 FROM c JOIN se ON section = section_path UNION ALL SELECT chunk_id, 'glossary', term, 1, meaning, 1, 1 FROM gl WHERE r <= 15)
  SELECT chunk_id, facet, via, n, string_agg(item, '|' ORDER BY r) AS items FROM u WHERE r <= most GROUP BY chunk_id, facet, via, n""")(
    lambda t: index.context_facets(t.sql(AROUND), t.sql(THINGS), t.sql(CALLED), t.sql(FACTS), t.relations_v, t.sql(TERMS)).withColumn("items", F.array_join("items", "|")))
query("gra11_similar_chunks", """SELECT q.vec_id AS chunk_id, e.vec_id AS near, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS INT) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id QUALIFY rank <= 3""")(
    lambda t: (lambda v: index.nearest_chunks(v, v.where("chunk_id % 100 = 0")))(t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")).select("chunk_id", "near", "rank"))

REGISTER = """SELECT concat('d', CAST(l_suppkey % 20 AS STRING)) AS document_id, l_orderkey AS place, CAST(row_number() OVER (PARTITION BY l_suppkey % 20, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INT) AS row, l_orderkey % 90 AS page, CASE l_orderkey % 9 WHEN 0 THEN '1|Standing Instruction No|Remark status|Title of it|Date' WHEN 1 THEN 'SN|STANDING INSTRUCTION NO.|TITLE|DATE|Expired / Incorporated'
    WHEN 2 THEN 'a|PROD / SI / 12' WHEN 3 THEN 'no number|here|at all' ELSE '' END AS head, concat(CAST(l_linenumber AS STRING), '|', CASE WHEN l_partkey % 7 > 0 THEN concat('ab / prod N / si/', CAST(100 + l_partkey % 300 AS STRING)) ELSE 'none' END, '| T  ', CAST(l_partkey AS STRING), '|D', CAST(l_suppkey AS STRING), '|', CASE l_partkey % 5 WHEN 0 THEN 'Expired' WHEN 1 THEN 'now INVALID' WHEN 2 THEN 'Incorporated in Chapter - 12' WHEN 3 THEN 'in force' ELSE 'see chapter7' END) AS line FROM lineitem"""
REGISTER_ROWS = f"SELECT document_id, place, row, page, CASE WHEN row = 0 AND head <> '' THEN head ELSE line END AS line FROM ({REGISTER}) x"
PLACED = "coalesce(nullif(list_position(list_transform(low, lambda x: {0}), true), 0), {1})"
query("stc9_standing_instructions", f"""WITH r AS (SELECT document_id, place, "row", page, string_split(line, '|') AS cells FROM ({REGISTER_ROWS.replace(' row,', ' "row",').replace('WHEN row ', 'WHEN "row" ').replace('AS row,', 'AS "row",')}) y), f AS (SELECT *, list_transform(cells, lambda x: lower(x)) AS low FROM r WHERE "row" = 0 AND len(cells) >= 3),
  h AS (SELECT document_id, place, len(list_filter(low, lambda x: contains(x, 'standing instruction'))) > 0 AS headed, len(list_filter(cells, lambda x: regexp_matches(x, '{registers.INSTRUCTION}'))) > 0 AS numbered,
    [{PLACED.format("contains(x, 'title')", 3)}, {PLACED.format("contains(x, 'date')", 4)}, {PLACED.format("contains(x, 'expired') OR contains(x, 'incorporated') OR contains(x, 'status')", 'len(cells)')}] AS own FROM f),
  u AS (SELECT *, last_value(CASE WHEN headed THEN own END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY place) AS pos FROM h), c AS (SELECT document_id, place, "row", page, list_transform(cells, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS cells FROM r),
  n AS (SELECT c.*, pos, upper(regexp_replace(regexp_extract(list_filter(cells, lambda x: regexp_matches(x, '{registers.INSTRUCTION}'))[1], '{registers.INSTRUCTION}'), '\\s+', '', 'g')) AS number FROM c JOIN u ON u.document_id = c.document_id AND u.place = c.place WHERE (headed OR numbered AND pos IS NOT NULL) AND NOT (headed AND "row" = 0)),
  k AS (SELECT document_id, number, coalesce(cells[pos[1]], '') AS title, coalesce(cells[pos[2]], '') AS issue_date, coalesce(cells[pos[3]], '') AS remark, page FROM n WHERE number <> '' QUALIFY row_number() OVER (PARTITION BY document_id, number ORDER BY place, "row") = 1)
  SELECT *, CASE WHEN remark ILIKE '%expired%' THEN 'expired' WHEN remark ILIKE '%invalid%' OR remark ILIKE '%cancel%' THEN 'cancelled' WHEN remark ILIKE '%incorporated%' THEN 'incorporated' ELSE 'in_use' END AS status, coalesce(regexp_extract(remark, '{registers.IN_CHAPTER}', 1), '') AS chapter FROM k""")(
    lambda t: registers.standing_instructions(t.sql(REGISTER_ROWS).withColumn("cells", F.split("line", r"\|"))))

PAGED = """SELECT concat('d', CAST(o_custkey % 40 AS STRING)) AS document_id, CAST(1 + o_orderkey % 60 AS INT) AS page, o_orderkey AS reading_order, CAST(CASE WHEN o_custkey % 40 < 3 THEN 0 WHEN o_orderkey % 9 = 0 AND o_custkey % 40 > 20 THEN 1 WHEN o_orderkey % 9 < 3 THEN 2 ELSE 0 END AS INT) AS heading_level,
  concat(CASE WHEN o_orderkey % 9 < 2 AND o_custkey % 3 = 0 THEN ' Section ' ELSE ' T' END, CAST(o_orderkey AS STRING), CASE WHEN o_custkey % 40 = 5 THEN ' Process Flow sheet' WHEN o_custkey % 40 = 6 AND o_orderkey % 3 = 0 THEN ' MSDS' WHEN o_orderkey % 271 = 1 THEN ' O&M Manual' WHEN o_orderkey % 50 = 3 THEN ' corrosion' ELSE '' END,
  CASE o_orderkey % 7 WHEN 0 THEN concat(' P-', CAST(o_orderkey % 400 AS STRING), 'A') WHEN 1 THEN concat(' V-', CAST(o_orderkey % 90 AS STRING), ', P-12') ELSE '' END) AS content FROM orders"""
BOXED = """SELECT document_id, place, CAST(k AS INT) AS row, CAST(row_number() OVER (PARTITION BY document_id, place, k ORDER BY p, s, q) - 1 AS INT) AS col, CASE p % 11 WHEN 0 THEN 'OPERATING  MANUAL' WHEN 1 THEN 'Plant Name' WHEN 2 THEN 'ATMOSPHERIC UNIT' WHEN 3 THEN 'Rev 3' WHEN 4 THEN 'ab' WHEN 5 THEN 'UNIT NO' WHEN 6 THEN 'Crude unit' ELSE CASE p % 13 WHEN 0 THEN 'Guide' ELSE 'OPERATING MANUAL' END END AS content
  FROM (SELECT concat('d', CAST(l_orderkey % 45 AS STRING)) AS document_id, l_orderkey AS place, l_linenumber % 3 AS k, l_partkey AS p, l_suppkey AS s, l_quantity AS q FROM lineitem WHERE l_orderkey % 45 < 38) z"""
KINDS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, '{w}') OR contains(opening, '{w}')" for w in words) + f" THEN '{name}'" for name, words in DOCUMENT_TYPES) + " ELSE 'unknown' END"
query("stc16_profile", f"""WITH e AS ({PAGED}), fr AS (SELECT * FROM e WHERE page <= 5), ti AS (SELECT document_id, arg_min(trim(content), (CASE WHEN heading_level = 1 THEN 0 ELSE 1 END, reading_order)) AS title FROM fr WHERE heading_level > 0 GROUP BY document_id), op AS (SELECT document_id, lower(left(string_agg(content, ' ' ORDER BY reading_order, content), 2000)) AS opening FROM fr GROUP BY document_id),
  d AS (SELECT document_id, coalesce(title, '') AS title, lower(coalesce(title, '')) AS low, coalesce(opening, '') AS opening FROM (SELECT DISTINCT document_id FROM e) x LEFT JOIN ti USING (document_id) LEFT JOIN op USING (document_id)), b AS ({BOXED.replace(' AS row,', ' AS "row",')}), t AS (SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS t, lead(content) OVER (PARTITION BY document_id, place, "row" ORDER BY col) AS nx FROM b),
  n AS (SELECT document_id, count(DISTINCT place) AS tables FROM b GROUP BY document_id HAVING count(DISTINCT place) >= 3), o AS (SELECT document_id, place, t, min("row") AS r, min("row" * 1000 + col) AS spot FROM t WHERE length(t) >= 3 AND NOT regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '\\b(page|rev|chapter|plant|doc|document)\\b', 'i') GROUP BY ALL),
  v AS (SELECT document_id, t, sum(CASE WHEN r = 0 THEN 3 ELSE 1 END) AS votes, min((place, spot)) AS f FROM o GROUP BY ALL), w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY votes DESC, f) = 1),
  u AS (SELECT document_id, nx2 AS unit, count(*) AS c, min((place, "row", col)) AS f FROM (SELECT *, trim(regexp_replace(nx, '\\s+', ' ', 'g')) AS nx2 FROM t) y WHERE regexp_matches(content, 'plant\\s*(no|name)|unit\\s*(no|name)?', 'i') AND nx2 <> '' AND lower(nx2) <> lower(trim(content)) GROUP BY ALL), un AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY c DESC, f) = 1)
  SELECT d.document_id, CASE WHEN votes * 2 >= tables AND (title = '' OR upper(title) LIKE 'SECTION%' OR upper(title) LIKE 'CHAPTER%') THEN CASE w.t WHEN 'OPERATING MANUAL' THEN 'Operating Manual' WHEN 'ATMOSPHERIC UNIT' THEN 'Atmospheric Unit' ELSE w.t END ELSE title END AS title, {KINDS} AS document_type, CASE WHEN tables >= 3 THEN unit END AS unit
  FROM d LEFT JOIN n ON n.document_id = d.document_id LEFT JOIN w ON w.document_id = d.document_id LEFT JOIN un ON un.document_id = d.document_id""")(
    lambda t: registers.profile(t.sql(PAGED), t.sql(BOXED)))
query("stc16_conventions", f"""WITH t AS (SELECT document_id, unnest(regexp_extract_all(content, '{registers.EQUIPMENT_TAG}')) AS tag FROM ({PAGED}) e WHERE page <= 30) SELECT document_id, tag[1] AS kind, count(*) AS n, array_to_string(list_sort(list_distinct(list(tag)))[:5], '|') AS examples FROM t GROUP BY ALL HAVING count(*) >= 2""")(
    lambda t: registers.conventions(t.sql(PAGED)).withColumn("examples", F.array_join("examples", "|")))

CHAPTERS = "SELECT DISTINCT concat('d', CAST(p_size % 8 AS STRING)) AS document_id, CAST(p_partkey % 12 AS INT) AS number FROM part WHERE p_partkey % 12 > 2"
SECTIONS = "SELECT concat('d', CAST(p_size % 9 AS STRING)) AS document_id, concat('s', CAST(p_partkey AS STRING)) AS section_id, p_brand AS path, concat(CAST(p_partkey % 12 AS STRING), '.', CAST(p_partkey % 5 AS STRING)) AS number, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey % 12 AS INT) END AS chapter_number, CASE WHEN p_partkey % 3 = 0 THEN concat('s', CAST(p_partkey + p_partkey % 11 AS STRING)) END AS parent_section_id, CAST(p_partkey AS INT) AS place FROM part"
PROCEDURES = "SELECT concat('d', CAST(s_suppkey % 10 AS STRING)) AS document_id, concat('p', CAST(s_suppkey AS STRING)) AS procedure_id, CASE WHEN s_suppkey % 6 > 0 THEN concat('s', CAST(s_suppkey * 25 AS STRING)) END AS section_id FROM supplier"
STEPS = "SELECT concat('p', CAST(l_suppkey AS STRING)) AS procedure_id, CAST(l_partkey % 97 AS INT) AS sequence FROM lineitem"
REFERENCES = "SELECT concat('d', CAST(l_suppkey % 9 AS STRING)) AS document_id, CASE WHEN l_linenumber = 2 THEN 'unknown' ELSE p_brand END AS source_path, CASE WHEN l_linenumber % 2 = 0 THEN 'section' ELSE 'chapter' END AS target_kind, concat(CAST(l_orderkey % 14 AS STRING), '.', CAST(l_partkey % 6 AS STRING)) AS target_number FROM lineitem JOIN part ON p_partkey = l_partkey"
TAKEN = "SELECT DISTINCT concat('d', CAST(o_custkey % 9 AS STRING)) AS document_id, concat('M/SI/', CAST(o_orderkey % 40 AS STRING)) AS number, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 13 AS STRING) ELSE '' END AS chapter FROM orders"
HOLDERS = "SELECT DISTINCT concat('d', CAST(p_size % 8 AS STRING)) AS document_id FROM part"
GRAPH = f"""WITH ch AS ({CHAPTERS}), se AS ({SECTIONS}), pr AS ({PROCEDURES}), st AS (SELECT DISTINCT * FROM ({STEPS}) x), re AS (SELECT DISTINCT * FROM ({REFERENCES}) x), si AS ({TAKEN}), pa AS (SELECT document_id, path AS source_path, arg_max(section_id, place) AS source_id FROM se GROUP BY ALL), nu AS (SELECT document_id, number AS target_number, arg_min(section_id, place) AS section FROM se GROUP BY ALL),
  e AS (SELECT document_id AS source_id, 'HAS_CHAPTER' AS edge, document_id || '#ch' || number AS target_id FROM ch UNION SELECT document_id || '#ch' || chapter_number, 'HAS_SECTION', section_id FROM se WHERE parent_section_id IS NULL AND chapter_number IS NOT NULL UNION SELECT parent_section_id, 'HAS_SUBSECTION', section_id FROM se WHERE parent_section_id IS NOT NULL UNION SELECT document_id, 'HAS_PROCEDURE', procedure_id FROM pr
    UNION SELECT procedure_id, 'IN_SECTION', section_id FROM pr WHERE section_id IS NOT NULL UNION SELECT procedure_id, 'HAS_STEP', procedure_id || '#s' || lpad(sequence::VARCHAR, 3, '0') FROM st UNION SELECT procedure_id || '#s' || lpad(sequence::VARCHAR, 3, '0'), 'NEXT', procedure_id || '#s' || lpad(nx::VARCHAR, 3, '0') FROM (SELECT *, lead(sequence) OVER (PARTITION BY procedure_id ORDER BY sequence) AS nx FROM st) y WHERE nx IS NOT NULL
    UNION SELECT source_id, 'REFERENCES', CASE WHEN target_kind <> 'chapter' AND section IS NOT NULL THEN section ELSE re.document_id || '#ch' || split_part(re.target_number, '.', 1) END FROM re LEFT JOIN pa ON pa.document_id = re.document_id AND pa.source_path = re.source_path LEFT JOIN nu ON nu.document_id = re.document_id AND nu.target_number = re.target_number
    UNION SELECT document_id, 'HAS_STANDING_INSTRUCTION', document_id || '#si:' || number FROM si UNION SELECT document_id || '#si:' || number, 'INCORPORATED_IN', document_id || '#ch' || chapter FROM si WHERE chapter <> ''),
  n AS (SELECT document_id AS id FROM ({HOLDERS}) x UNION SELECT document_id || '#ch' || number FROM ch UNION SELECT section_id FROM se UNION SELECT procedure_id FROM pr UNION SELECT procedure_id || '#s' || lpad(sequence::VARCHAR, 3, '0') FROM st UNION SELECT document_id || '#si:' || number FROM si),
  h AS (SELECT *, source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n) AND source_id IS NOT NULL AND NOT (edge = 'REFERENCES' AND source_id = target_id) AS held FROM e)"""
graph_edges = lambda t: (lambda p: registers.held_edges(registers.document_edges(*p), registers.document_nodes(t.sql(HOLDERS), *p[:4], p[5])))([t.sql(x) for x in (CHAPTERS, SECTIONS, PROCEDURES, STEPS, REFERENCES, TAKEN)])
query("src16_document_edges", f"{GRAPH} SELECT source_id, edge, target_id FROM h WHERE held")(lambda t: graph_edges(t).where("held").drop("held"))
query("src15_dangling_edges", f"{GRAPH} SELECT edge, count(*) AS n, count(*) FILTER (WHERE coalesce(held, false)) AS held, count(*) FILTER (WHERE NOT coalesce(held, false)) AS dangling FROM h GROUP BY edge")(
    lambda t: graph_edges(t).groupBy("edge").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("held").cast("long")).alias("held"), F.sum((~F.col("held")).cast("long")).alias("dangling")))

FILTERS = "SELECT s_suppkey AS request_id, CASE s_suppkey % 4 WHEN 0 THEN 'table,narrative' WHEN 1 THEN 'safety' ELSE '' END AS types, CASE s_suppkey % 3 WHEN 0 THEN '1,2' WHEN 1 THEN '7' ELSE '' END AS chapters, CASE s_suppkey % 5 WHEN 0 THEN 'd1,d2,d3' ELSE '' END AS docs FROM supplier"
PLACES = "SELECT p_partkey AS chunk_id, CASE p_size % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'narrative' WHEN 2 THEN 'safety' END AS chunk_type, CAST(p_size % 9 AS STRING) AS chapter, concat('d', CAST(p_partkey % 6 AS STRING)) AS document_id FROM part"
listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
query("win3_filtered_search", FUSED + f""", q AS ({FILTERS}), c AS ({PLACES}), u AS (SELECT request_id, chunk_id, 1.0::DOUBLE / (59 + rank) AS part, 1 AS r, 'keyword' AS why FROM a WHERE rank <= 32 UNION ALL SELECT request_id, chunk_id, 1.0::DOUBLE / (59 + rank), 1, 'vector' FROM b WHERE rank <= 32 UNION ALL SELECT DISTINCT l_suppkey, l_partkey, 0, 0, 'entity' FROM lineitem WHERE l_quantity = 50),
  s AS (SELECT request_id, chunk_id, sum(part) + CASE WHEN min(r) = 0 THEN CASE WHEN max(r) = 1 THEN 1.0::DOUBLE / 60 ELSE 0.5::DOUBLE / 60 END ELSE 0 END AS score, string_agg(why, '+' ORDER BY why) AS reasons FROM u GROUP BY ALL),
  m AS (SELECT request_id, chunk_id, score, reasons, NOT (chapters = '' OR list_contains(string_split(chapters, ','), chapter)) AS soft FROM s JOIN c USING (chunk_id) JOIN q USING (request_id) WHERE (types = '' OR coalesce(list_contains(string_split(types, ','), chunk_type), false)) AND (docs = '' OR list_contains(string_split(docs, ','), document_id)))
  SELECT request_id, chunk_id, CAST(round(score * 10000) AS BIGINT) AS basis_points, reasons, soft, CAST(row_number() OVER (PARTITION BY request_id ORDER BY soft, round(score, 12) DESC, chunk_id) AS INT) AS rank FROM m QUALIFY rank <= 8""")(
    lambda t: retrieval.search_chunks({"keyword": t.sql(FUSED + "SELECT * FROM a WHERE rank <= 32"), "vector": t.sql(FUSED + "SELECT * FROM b WHERE rank <= 32")}, t.sql(FILTERS).select("request_id", listed("types").alias("chunk_types"), listed("chapters").alias("chapters"), listed("docs").alias("document_ids")), t.sql(PLACES), 8,
        t.sql("SELECT DISTINCT l_suppkey AS request_id, l_partkey AS chunk_id FROM lineitem WHERE l_quantity = 50")).select("request_id", "chunk_id", F.round(F.col("score") * 10000).cast("long").alias("basis_points"), "reasons", "soft", "rank"))
TYPED = "CASE doc_id % 6 WHEN 0 THEN 'narrative' WHEN 1 THEN 'equipment' WHEN 2 THEN 'control' WHEN 3 THEN 'safety' WHEN 4 THEN 'table' END"
HITS = ", ".join(f"instr(lower(t), '{w}')" for w in retrieval.WHY_WORDS)
query("qry11_explanations", f"""WITH k AS ({BM25.replace('rank <= 10', 'rank <= 24')}), f AS (SELECT request_id, doc_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY rank) AS INT) AS rank FROM k WHERE {TYPED} IN ('narrative', 'equipment', 'control', 'safety') QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY rank) <= 5),
  p AS (SELECT f.*, coalesce(d.text, '') AS t, split_part(b.text, ' ', 1) AS kw FROM f JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = f.request_id), s AS (SELECT *, greatest(1, coalesce(list_min(list_filter([{HITS}, instr(lower(t), lower(kw))], lambda x: x > 0)), 1) - 260) AS start FROM p)
  SELECT request_id, doc_id, rank, 'keyword' AS reasons, md5(trim(CASE WHEN length(t) > start + 520 THEN regexp_replace(substr(t, start, 520), '\\s+\\S*$', '') ELSE substr(t, start, 520) END)) AS excerpt FROM s""")(
    lambda t: retrieval.explanations(t.documents.select("doc_id", "text", F.expr(TYPED).alias("chunk_type"), F.lit(None).cast("int").alias("chapter"), F.col("source").alias("document_id")), t.benchmark.select(F.col("item_id").alias("request_id"), "text", F.array(F.split_part("text", F.lit(" "), F.lit(1))).alias("keywords")), key="doc_id")
    .select("request_id", "doc_id", "rank", "reasons", F.md5("excerpt").alias("excerpt")))

RESULTS = "SELECT l_orderkey AS request_id, CASE l_partkey % 7 WHEN 0 THEN 'verification' WHEN 1 THEN 'report' WHEN 2 THEN NULL ELSE 'lookup' END AS agent, CAST(l_quantity / 64 AS DOUBLE) AS score, CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 5 > 1 END AS ok, l_linenumber % 2 = 0 AS optional, CAST(CASE WHEN l_suppkey % 9 = 0 THEN 2 WHEN l_suppkey % 9 = 1 THEN NULL ELSE 0 END AS INT) AS n_missing FROM lineitem"
VERDICTS = "SELECT o_orderkey AS request_id, CAST(o_custkey % 9 AS DOUBLE) / 8 AS verified FROM orders WHERE o_orderkey % 3 > 0"
query("agg10_answer_confidence", f"""WITH r AS (SELECT *, CASE WHEN agent IN ('verification', 'report') THEN NULL ELSE (CASE WHEN optional THEN 0.5::DOUBLE ELSE 1 END) * (CASE WHEN ok = false THEN 0.3::DOUBLE ELSE 1 END) END AS w FROM ({RESULTS}) x), b AS (SELECT request_id, coalesce(sum(w * score) / sum(w), 0.3::DOUBLE) AS base, sum(coalesce(n_missing, 0)) AS missing FROM r GROUP BY request_id)
  SELECT request_id, CAST(round(CAST(round(greatest(0, least(1, base * (0.6::DOUBLE + 0.4::DOUBLE * coalesce(verified, 1)) - least(0.25::DOUBLE, 0.05::DOUBLE * missing))), 9) AS DECIMAL(18, 9)), 2) * 100 AS INT) AS percent FROM b LEFT JOIN ({VERDICTS}) v USING (request_id)""")(
    lambda t: claims.answer_confidence(t.sql(RESULTS), t.sql(VERDICTS)).select("request_id", F.round(F.col("score") * 100).cast("int").alias("percent")))
PROBES = "SELECT DISTINCT o_orderkey AS request_id, CASE o_custkey % 4 WHEN 0 THEN 'guest' WHEN 1 THEN 'operator' WHEN 2 THEN 'engineer' ELSE 'admin' END AS role, concat('s', CAST(o_custkey % 100 + k AS STRING)) AS entity_uid FROM orders, (SELECT 0 AS k UNION ALL SELECT 7 AS k) y WHERE o_orderkey % 100 = 0"
BEARING = "SELECT DISTINCT concat('s', CAST(l_suppkey AS STRING)) AS entity_uid, concat('doc', CAST(l_partkey % 7 AS STRING)) AS document_id, CASE l_linenumber % 3 WHEN 0 THEN 'relation' WHEN 1 THEN 'claim' ELSE 'note' END AS kind, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id, CAST(l_quantity AS INT) AS weight FROM lineitem"
HOMES = "SELECT DISTINCT concat('s', CAST(l_suppkey AS STRING)) AS entity_uid, concat('doc', CAST(l_orderkey % 7 AS STRING)) AS document_id FROM lineitem WHERE l_linenumber = 1"
SEES = "CASE role WHEN 'guest' THEN 0 WHEN 'operator' THEN 1 WHEN 'engineer' THEN 2 ELSE 4 END >= CASE tag WHEN 'PUBLIC' THEN 0 WHEN 'INTERNAL' THEN 1 WHEN 'CONFIDENTIAL' THEN 2 ELSE 3 END"
query("sec5_scope_of_requests", f"""WITH p AS ({PROBES}), m AS (SELECT request_id, b.document_id, kind, id, max(weight) AS weight FROM p JOIN ({BEARING}) b ON b.entity_uid = p.entity_uid JOIN documents_info_v d ON d.document_id = b.document_id WHERE kind IN ('claim', 'relation') AND NOT ({SEES}) GROUP BY ALL),
  f AS (SELECT request_id, document_id, kind || ':' || id AS record_id FROM m QUALIFY row_number() OVER (PARTITION BY request_id, kind ORDER BY weight DESC, id, document_id) <= CASE kind WHEN 'claim' THEN 40 ELSE 10 END)
  SELECT * FROM f UNION ALL SELECT p.request_id, min(h.document_id), 'entity:' || p.entity_uid FROM p JOIN ({HOMES}) h ON h.entity_uid = p.entity_uid JOIN (SELECT DISTINCT request_id, document_id FROM f) s ON s.request_id = p.request_id AND s.document_id = h.document_id GROUP BY p.request_id, p.entity_uid""")(
    lambda t: security.scope_probe(t.sql(PROBES), t.sql(BEARING), t.documents_info_v, t.sql(HOMES), {"claim": 40, "relation": 10}))
