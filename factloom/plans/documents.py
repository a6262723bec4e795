"""Queries over documents, pages, retrieval and structure."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import claims, elements, joins, matching, retrieval, security, structure
from .registry import query

#: Greedy filling by a walk over the rows of a document.
PACKED = """WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY {doc} ORDER BY {order}) AS pos FROM ({rows}) x), w AS (SELECT {doc}, pos, 0::BIGINT AS chunk, tokens::BIGINT AS used FROM p WHERE pos = 1
  UNION ALL SELECT p.{doc}, p.pos, w.chunk + CASE WHEN w.used > 0 AND w.used + p.tokens > {budget} THEN 1 ELSE 0 END, CASE WHEN w.used > 0 AND w.used + p.tokens > {budget} THEN p.tokens ELSE w.used + p.tokens END FROM w JOIN p ON p.{doc} = w.{doc} AND p.pos = w.pos + 1)
  SELECT p.{doc}, p.{order}, p.tokens, w.chunk FROM p JOIN w ON p.{doc} = w.{doc} AND p.pos = w.pos"""
SIZED = r"SELECT conv_id, turn, CAST(sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) * 13 // 10) AS BIGINT) AS tokens FROM turns_v GROUP BY conv_id, turn"
from .text import TOKENS

query("flt3_repeated_lines", r"""WITH l AS (SELECT source, doc_id, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM documents),
  n AS (SELECT source, count(DISTINCT doc_id) AS docs FROM documents GROUP BY source)
  SELECT l.source, substr(md5(line), 1, 16) AS hash, count(DISTINCT doc_id) AS n_docs, docs FROM l JOIN n USING (source) WHERE length(line) >= 3 GROUP BY l.source, line, docs HAVING count(DISTINCT doc_id) * 10 >= docs AND count(DISTINCT doc_id) >= 3""")(
    lambda t: elements.repeated_lines(t.documents, "source", "doc_id", "text"))
REQUESTS = "SELECT item_id AS request_id, text FROM benchmark"
HEADED = "SELECT concat('d', CAST(o_custkey % 40 AS STRING)) AS document_id, CAST(1 + o_orderkey % 30 AS INT) AS page, o_orderkey AS reading_order, CAST(CASE WHEN o_orderkey % 9 = 0 THEN 1 WHEN o_orderkey % 9 < 3 THEN 2 ELSE 0 END AS INT) AS heading_level, concat('T', CAST(o_orderkey AS STRING)) AS content FROM orders"
BM25 = f"""WITH p AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents), e AS (SELECT doc_id, len(t) AS length, unnest(t) AS token FROM p),
  f AS (SELECT doc_id, length, token, count(*) AS tf FROM e GROUP BY ALL), tot AS (SELECT count(*) AS n, avg(len(t)) AS m FROM p WHERE len(t) > 0),
  q AS (SELECT DISTINCT item_id AS request_id, unnest({TOKENS.format('text')}) AS token FROM benchmark), d AS (SELECT token, count(*) AS df FROM f WHERE token IN (SELECT token FROM q) GROUP BY token),
  i AS (SELECT token, ln((n - df + 0.5) / (df + 0.5)) AS raw, m FROM d, tot), fl AS (SELECT avg(raw) * 0.25 AS floor FROM i),
  s AS (SELECT request_id, doc_id, sum(CASE WHEN raw < 0 THEN floor ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / m))) AS score FROM q JOIN f USING (token) JOIN i USING (token), fl GROUP BY ALL)
  SELECT request_id, doc_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10"""
query("win1_bm25", BM25)(
    lambda t: retrieval.bm25(t.documents, t.sql(REQUESTS), 10, key="doc_id").select("request_id", "doc_id", "rank"))
QV = "SELECT vec_id AS request_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0"
query("win2_vector_top_k", """SELECT q.vec_id AS request_id, e.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS INT) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10""")(
    lambda t: retrieval.vector_top_k(t.embeddings, t.sql(QV), 10).select("request_id", "vec_id", "rank"))
FUSED = """WITH a AS (SELECT l_suppkey AS request_id, l_partkey AS chunk_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS INT) AS rank FROM lineitem GROUP BY l_suppkey, l_partkey),
  b AS (SELECT l_suppkey AS request_id, l_partkey AS chunk_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey DESC) AS INT) AS rank FROM lineitem GROUP BY l_suppkey, l_partkey) """
query("win3_rank_fusion", FUSED + """, u AS (SELECT request_id, chunk_id, 1.0::DOUBLE / (59 + rank) AS part, 1 AS r FROM a WHERE rank <= 24 UNION ALL SELECT request_id, chunk_id, 1.0::DOUBLE / (59 + rank), 1 FROM b WHERE rank <= 24 UNION ALL SELECT DISTINCT l_suppkey, l_partkey, 0, 0 FROM lineitem WHERE l_quantity = 50),
  s AS (SELECT request_id, chunk_id, sum(part) + CASE WHEN min(r) = 0 THEN CASE WHEN max(r) = 1 THEN 1.0::DOUBLE / 60 ELSE 0.5::DOUBLE / 60 END ELSE 0 END AS score FROM u GROUP BY ALL)
  SELECT request_id, chunk_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(score, 12) DESC, chunk_id) AS INT) AS rank FROM s QUALIFY rank <= 12""")(
    lambda t: retrieval.fuse([t.sql(FUSED + "SELECT * FROM a WHERE rank <= 24"), t.sql(FUSED + "SELECT * FROM b WHERE rank <= 24")], 10**6, t.sql("SELECT DISTINCT l_suppkey AS request_id, l_partkey AS chunk_id FROM lineitem WHERE l_quantity = 50"))
    .withColumn("rank", F.expr("row_number() over (partition by request_id order by round(score, 12) desc, chunk_id)")).where("rank <= 12").select("request_id", "chunk_id", "rank"))
CLASSES = "WITH s AS (SELECT p_partkey AS id, list_sort(list_distinct(string_split(p_name, ' '))) AS t FROM part), c AS (SELECT t, min(id) AS class_id FROM s GROUP BY t)"
CLASSED = lambda t: matching.set_classes(t.part.select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("tokens")))
query("joi6_set_classes", f"{CLASSES} SELECT id, class_id FROM s JOIN c USING (t)")(lambda t: CLASSED(t).select("id", "class_id"))
query("joi6_jaccard", f"""{CLASSES} SELECT a.class_id AS left_id, b.class_id AS right_id, len(list_intersect(a.t, b.t))::INT AS common, len(list_distinct(list_concat(a.t, b.t)))::INT AS "union" FROM c a, c b
  WHERE a.class_id <> b.class_id AND len(list_intersect(a.t, b.t)) > 0 AND len(list_intersect(a.t, b.t)) * 3 >= len(list_distinct(list_concat(a.t, b.t)))""")(
    lambda t: (lambda c: matching.similar_sets(c, c, 1 / 3).where("left_id <> right_id"))(CLASSED(t).select(F.col("class_id").alias("id"), "tokens").distinct()))
query("joi6_text_overlap", f"""WITH q AS (SELECT p_partkey AS id, list_distinct({TOKENS.format("p_name || ' ' || p_brand || ' ' || p_type")}) AS t FROM part), c AS (SELECT t, min(id) AS id FROM (SELECT id, list_sort(t) AS t FROM q) x GROUP BY t),
  a AS (SELECT s_suppkey AS id, list_distinct({TOKENS.format("p_name || ' ' || p_brand")}) AS t FROM supplier JOIN part ON p_partkey = s_suppkey)
  SELECT a.id AS left_id, c.id AS right_id, len(list_intersect(a.t, c.t))::INT AS common, len(list_distinct(list_concat(a.t, c.t)))::INT AS "union" FROM a, c
  WHERE len(list_intersect(a.t, c.t)) > 0 AND (len(list_intersect(a.t, c.t)) * 5 >= len(list_distinct(list_concat(a.t, c.t))) * 4 OR len(a.t) >= 2 AND len(list_intersect(a.t, c.t)) = len(a.t))""")(
    lambda t: matching.similar_sets(t.supplier.join(t.part, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("id"), F.array_distinct(text.tokenize(F.concat_ws(" ", "p_name", "p_brand"))).alias("tokens")),
        matching.set_classes(t.part.select(F.col("p_partkey").alias("id"), text.tokenize(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("tokens"))).select(F.col("class_id").alias("id"), "tokens").distinct(), 0.8, contained=2))
query("src3_html_elements")(lambda t: structure.html_elements(t.pages))
query("src3_element_counts", r"""SELECT page_id, len(regexp_extract_all(html, '<h1[ >]'))::INT AS h1, len(regexp_extract_all(html, '<li[ >]'))::INT AS li, len(regexp_extract_all(html, '<p[ >]'))::INT AS p FROM pages""")(
    lambda t: t.pages.select("page_id", *[F.size(F.regexp_extract_all("html", F.lit(f"<{e}[ >]"), F.lit(0))).alias(e) for e in ("h1", "li", "p")]))
LEVELED = "SELECT DISTINCT l_orderkey % 500 AS doc, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ord, CAST(CASE WHEN l_quantity < 10 THEN 1 + l_partkey % 3 ELSE 0 END AS INT) AS lvl, concat('T', CAST(l_partkey AS STRING)) AS title FROM lineitem"
query("stc3_heading_path", f"""WITH e AS ({LEVELED}), h AS (SELECT *, coalesce(max(CASE WHEN lvl = 1 THEN ord END) OVER w, -1) AS a1, coalesce(max(CASE WHEN lvl = 2 THEN ord END) OVER w, -1) AS a2, coalesce(max(CASE WHEN lvl = 3 THEN ord END) OVER w, -1) AS a3,
    arg_max(title, CASE WHEN lvl = 1 THEN ord END) OVER w AS t1, arg_max(title, CASE WHEN lvl = 2 THEN ord END) OVER w AS t2, arg_max(title, CASE WHEN lvl = 3 THEN ord END) OVER w AS t3 FROM e WINDOW w AS (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING))
  SELECT doc, ord, lvl, title, concat_ws(' > ', CASE WHEN a1 >= 0 THEN t1 END, CASE WHEN a2 >= 0 AND a2 >= a1 THEN t2 END, CASE WHEN a3 >= 0 AND a3 >= greatest(a1, a2) THEN t3 END) AS section_path FROM h""")(
    lambda t: structure.heading_paths(t.sql(LEVELED), "doc", "ord", "lvl", "title", 3))
query("stc5_procedure_runs", """WITH s AS (SELECT user_id, event_id, event_type, ts, sum(CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
  SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS n_imperative FROM s GROUP BY ALL HAVING count(*) >= 3""")(
    lambda t: structure.runs(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "purchase")).groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") == "click").cast("long")).alias("n_imperative")).where("n >= 3"))
CELLS = "SELECT DISTINCT l_orderkey % 300 AS table_id, CAST(l_linenumber AS INT) AS row, CAST(l_partkey % 6 AS INT) AS col, CAST(1 + l_suppkey % 2 AS INT) AS rowspan, CAST(1 + l_partkey % 2 AS INT) AS colspan, concat('c', CAST(l_linenumber AS STRING), '_', CAST(l_partkey % 6 AS STRING)) AS content FROM lineitem"
query("stc12_merged_cells", f"""WITH c AS ({CELLS}), o AS (SELECT table_id, "row", col, content, 0 AS copied FROM c
    UNION ALL SELECT table_id, r AS "row", unnest(range(col, col + colspan)) AS col, content, 1 FROM (SELECT *, unnest(range("row", "row" + rowspan)) AS r FROM c WHERE rowspan > 1 OR colspan > 1) y)
  SELECT table_id, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, arg_min(content, (copied, content)) AS content, min(copied)::INT AS copied FROM o GROUP BY table_id, "row", col""")(lambda t: structure.propagate_merged(t.sql(CELLS)))
query("stc19_chunk_packing", PACKED.format(doc="conv_id", order="turn", rows=SIZED, budget=256))(lambda t: structure.pack(t.turns_v.groupBy("conv_id", "turn").agg(F.sum(text.token_estimate("text")).alias("tokens")), "conv_id", "turn", "tokens", 256))
ELEMENTS = """SELECT l_orderkey % 400 AS doc, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ord, l_orderkey % 5 <> 0 AND l_quantity < 12 AS is_heading, CAST(CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 4 END AS INT) AS level,
  CASE WHEN l_orderkey % 5 = 0 THEN concat('p', CAST(l_orderkey AS STRING)) END AS procedure, CASE WHEN l_orderkey % 5 = 0 THEN CAST(l_linenumber - CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS INT) END AS step,
  CASE WHEN l_orderkey % 5 = 1 AND l_quantity >= 12 THEN concat('t', CAST(l_orderkey AS STRING)) END AS "table", concat('T', CAST(l_partkey AS STRING)) AS title, concat('S', CAST(l_suppkey AS STRING)) AS path,
  CASE WHEN l_partkey % 3 > 0 THEN concat('P', CAST(l_partkey % 9 AS STRING)) END AS parent_heading, CAST(CASE WHEN l_quantity < 12 THEN l_quantity ELSE l_quantity * 9 END AS BIGINT) AS tokens, CAST(l_linenumber AS INT) AS page FROM lineitem"""
CHUNKED = f"""WITH RECURSIVE x AS (SELECT DISTINCT * FROM ({ELEMENTS}) d), b AS (SELECT *, row_number() OVER w AS pos, coalesce(procedure IS NOT NULL AND (step = 0 OR step = 1 AND lag(procedure) OVER w IS DISTINCT FROM procedure), false) AS starts FROM x WINDOW w AS (PARTITION BY doc ORDER BY ord)),
  p AS (SELECT *, coalesce(lead(starts) OVER (PARTITION BY doc ORDER BY ord), false) AS nexts FROM b),
  w AS (SELECT doc, pos, is_heading, "table", procedure, 0::BIGINT AS chunk, tokens AS used, 1 AS n, NOT is_heading AS body, false AS moved, CASE WHEN is_heading THEN title ELSE coalesce(parent_heading, '') END AS heading, path FROM p WHERE pos = 1
    UNION ALL SELECT doc, pos, is_heading, "table", procedure, chunk, used, n, body, moved, heading, path FROM (
      SELECT p.doc, p.pos, p.is_heading, p."table", p.procedure, w.chunk + CASE WHEN e.ends THEN 1 ELSE 0 END + CASE WHEN m.goes THEN 1 ELSE 0 END AS chunk, CASE WHEN e.ends OR m.goes THEN 0 ELSE w.used END + p.tokens AS used, CASE WHEN e.ends OR m.goes THEN 0 ELSE w.n END + 1 AS n,
        (NOT e.ends AND NOT m.goes AND w.body) OR NOT p.is_heading AS body, m.goes AS moved, CASE WHEN p.is_heading THEN p.title WHEN e.ends THEN coalesce(p.parent_heading, w.heading) ELSE w.heading END AS heading, CASE WHEN p.is_heading OR e.ends THEN p.path ELSE w.path END AS path
      FROM w JOIN p ON p.doc = w.doc AND p.pos = w.pos + 1,
      LATERAL (SELECT (p.is_heading AND w.body AND (coalesce(p.level, 2) <= 2 OR w.used >= 400)) OR (p.starts AND w.used >= 200 AND NOT w.moved)
        OR (w.used + p.tokens > 1200 AND (NOT coalesce(w."table" = p."table" OR w.procedure = p.procedure, false) OR w.used + p.tokens > 2400)) AS ends) e,
      LATERAL (SELECT p.is_heading AND p.nexts AND NOT e.ends AND w.used + p.tokens >= 200 AS goes) m) y)"""
query("stc19_structure_chunks", CHUNKED + """, o AS (SELECT p.*, w.chunk, w.moved, w.heading AS h, w.path AS hp FROM w JOIN p ON p.doc = w.doc AND p.pos = w.pos),
  c AS (SELECT doc, chunk, arg_max(h, pos) AS h, arg_max(hp, pos) AS hp, arg_min(moved, pos) AS fm, arg_min(title, pos) AS ft, arg_min(path, pos) AS fp, count(*) AS n_elements, sum(tokens)::BIGINT AS tokens, min(page) AS page_start, max(page) AS page_end, count(DISTINCT "table") AS n_tables, count(DISTINCT procedure) AS n_procedures FROM o GROUP BY doc, chunk)
  SELECT doc, chunk, n_elements, tokens, page_start, page_end, n_tables::INT AS n_tables, n_procedures::INT AS n_procedures, CASE WHEN coalesce(lead(fm) OVER w, false) THEN lead(ft) OVER w ELSE h END AS heading, CASE WHEN coalesce(lead(fm) OVER w, false) THEN lead(fp) OVER w ELSE hp END AS path FROM c WINDOW w AS (PARTITION BY doc ORDER BY chunk)""")(
    lambda t: structure.chunks(structure.chunk_elements(t.sql(ELEMENTS.replace('"table"', "`table`")).distinct(), "doc", "ord"), "doc", "ord", "page").select("doc", "chunk", "n_elements", "tokens", "page_start", "page_end", F.size("tables").alias("n_tables"), F.size("procedures").alias("n_procedures"), "heading", "path"))
query("stc16_profile_title", f"WITH e AS ({HEADED}) SELECT document_id, coalesce(arg_min(content, reading_order) FILTER (WHERE heading_level = 1 AND page <= 5), arg_min(content, reading_order) FILTER (WHERE heading_level > 0)) AS title, count(*) FILTER (WHERE heading_level > 0) AS n_headings, count(*) AS n_elements FROM e GROUP BY document_id")(
    lambda t: elements.profiles(t.sql(HEADED)))
query("val1_grounding", r"""WITH b AS (SELECT item_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: length(x) > 3)) AS t FROM benchmark), s AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
  w AS (SELECT doc_id, pos, list_distinct(string_split(lower(line), ' ')) AS t FROM s) SELECT item_id, doc_id, CAST(min(pos) AS INT) AS first_line, count(*) AS n_lines FROM b, w WHERE len(list_intersect(b.t, w.t)) * 10 >= len(b.t) * 8 AND len(b.t) > 0 GROUP BY item_id, doc_id""")(
    lambda t: joins.grounded(t.benchmark, t.documents, "doc_id", "text"))
query("agg13_missing_documents", "SELECT source, max(CASE WHEN lang = 'de' THEN 1 ELSE 0 END) = 1 AS present, count(*) AS n, CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END AS priority FROM documents GROUP BY source")(
    lambda t: claims.missing_documents(t.documents, "source", F.coalesce(F.col("lang") == "de", F.lit(False)), F.when(F.col("source") == "src0", 1).when(F.col("source") == "src1", 2).otherwise(3)))
query("agg8_label_promotion", "SELECT event_type, count(DISTINCT user_id) AS n_documents, count(*) AS n_chunks FROM events GROUP BY event_type HAVING count(DISTINCT user_id) >= 2 AND count(*) >= 5")(
    lambda t: claims.promoted_labels(t.events, "event_type", "user_id").select("event_type", "n_documents", "n_chunks"))
query("sec8_distinctive_values", "SELECT p_name, min(p_brand) AS only_in FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) = 1")(
    lambda t: security.distinctive(t.part, "p_name", "p_brand"))
query("flt14_duplicates", "SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY md5(text) HAVING count(*) > 1")(
    lambda t: claims.duplicates(t.documents, "text", "doc_id"))
