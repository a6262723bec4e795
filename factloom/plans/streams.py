"""Queries over events, logs and access."""

from pyspark.sql import functions as F

from ..functions import phrases
from ..operators import audit, security
from ..streaming import progress, stateful
from .registry import query

query("stm1_windowed_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, CAST(round(sum(value) * 1000) AS BIGINT) AS milli FROM events GROUP BY ALL")(
    lambda t: progress.windowed_counts(t.events).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round(F.col("total") * 1000).cast("long").alias("milli")))
query("stm1_phase_durations", "SELECT event_id, user_id, event_type, next_type FROM (SELECT event_id, user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events) AS x WHERE next_type IS NOT NULL")(
    lambda t: progress.next_states(t.events, ["user_id"], "event_type").select("event_id", "user_id", "event_type", "next_type"))
query("stm3_first_seen", "SELECT DISTINCT user_id, event_type FROM events")(lambda t: progress.first_seen(t.events, ["user_id", "event_type"]).select("user_id", "event_type"))
query("stm4_state_changes", "SELECT event_id, was, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS NOT NULL AND was <> event_type")(
    lambda t: progress.state_changes(t.events, ["user_id"], "event_type").select("event_id", "was", "event_type"))
query("stm5_run_state", "SELECT run_id, step, arg_max(status, (ts, event_id)) AS status FROM progress_v GROUP BY run_id, step")(lambda t: progress.latest(t.progress_v, ["run_id", "step"]).select("run_id", "step", "status"))
query("stm6_resume", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")(lambda t: progress.resume(t.events.select("event_id"), t.events.where("event_type = 'click'"), "event_id"))
query("stm7_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS brk FROM events), s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g)
  SELECT user_id, count(*) AS n, min(ts) AS start FROM s GROUP BY user_id, s""")(lambda t: progress.sessions(t.events).select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("start")))
query("stm7_expiry", "SELECT user_id, max(event_id) AS last_id, count(*) AS n FROM events GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-29 12:00:00'")(
    lambda t: progress.alive(t.events, "user_id", "2024-01-29 12:00:00"))
query("stm5_kept_runs", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(event_id % 40 // 4 AS VARCHAR) AS run, event_type AS step, CASE WHEN value >= 50 THEN 'done' ELSE 'running' END AS status, ts, event_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL), l AS (SELECT key, run, step, arg_max(status, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS event_id, max((ts, event_id)) AS m FROM e GROUP BY ALL),
  r AS (SELECT key, run, row_number() OVER (PARTITION BY key ORDER BY max(m) DESC, run DESC) <= 3 AS kept FROM l GROUP BY key, run) SELECT l.key, l.run, step, status, event_id, kept FROM l JOIN r ON r.key = l.key AND r.run = l.run""")(
    lambda t: stateful.run_states(t.progress_v.withColumn("run", F.floor(F.col("event_id") % 40 / 4)), "run_id", "run", 3).select("key", "run", "step", "status", "event_id", "kept"))
query("stm7_released", """WITH g AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 7200000000 THEN 0 ELSE 1 END AS brk FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(brk) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM g),
  x AS (SELECT key, v, max((ts, event_id)) AS l, epoch_us(max(ts)) AS e, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM s GROUP BY key, v) SELECT key, event_id, n FROM x WHERE v < (SELECT max(v) FROM x y WHERE y.key = x.key) OR (e + 999) // 1000 + 7200000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events)""")(
    lambda t: stateful.released(t.events, "user_id", 7200).select("key", "event_id", "n"))
query("agg12_counter_deltas", "SELECT event_id, CAST(round((value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) * 1000) AS BIGINT) AS delta FROM events")(
    lambda t: progress.counter_deltas(t.events, "user_id").select("event_id", F.round(F.col("delta") * 1000).cast("long").alias("delta")))
query("str35_props_json", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events")(
    lambda t: t.events.select("event_id", phrases.json_number("props", "k").alias("k")))
LOG = "SELECT user_id, event_id, CAST(event_id AS STRING) AS ts, concat(event_type, ':', props) AS payload FROM events"
query("aud1_hash_chain", f"""WITH RECURSIVE l AS (SELECT user_id, event_id, CAST(event_id AS VARCHAR) AS ts, event_type || ':' || props AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
  c AS (SELECT *, '' AS prev_hash, sha256(seq || '|' || ts || '||' || payload) AS hash FROM l WHERE seq = 0 UNION ALL SELECT l.*, c.hash, sha256(l.seq || '|' || l.ts || '|' || c.hash || '|' || l.payload) FROM c JOIN l ON l.user_id = c.user_id AND l.seq = c.seq + 1) SELECT * FROM c""")(lambda t: audit.append(t.sql(LOG), "user_id", ["event_id"]))
query("aud2_verify_chain", "SELECT user_id, count(*) AS n, user_id % 3 <> 0 OR count(*) <= 5 AS holds, CASE WHEN user_id % 3 = 0 AND count(*) > 5 THEN 5 END::BIGINT AS first_bad, CASE WHEN user_id % 3 = 0 AND count(*) > 5 THEN 'content' END AS reason FROM events GROUP BY user_id")(
    lambda t: audit.verify(audit.append(t.sql(LOG), "user_id", ["event_id"]).withColumn("payload", F.when((F.col("user_id") % 3 == 0) & (F.col("seq") == 5), F.lit("edited")).otherwise(F.col("payload"))), "user_id"))
query("aud4_filtered_log", "SELECT event_id, CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INT) AS r FROM events WHERE event_type = 'error' QUALIFY r <= 100")(
    lambda t: progress.newest(t.events.where("event_type = 'error'"), ["ts", "event_id"], 100).select("event_id", "r"))
query("aud4_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")(
    lambda t: progress.counts(t.events, "event_type"))
ALLOWED = "tag IN ('PUBLIC', 'INTERNAL', 'CONFIDENTIAL')"
query("sec1_level_rule", "SELECT r.role, d.document_id, CASE r.role WHEN 'guest' THEN 0 WHEN 'operator' THEN 1 WHEN 'engineer' THEN 2 WHEN 'admin' THEN 4 ELSE 0 END >= CASE d.tag WHEN 'PUBLIC' THEN 0 WHEN 'INTERNAL' THEN 1 WHEN 'CONFIDENTIAL' THEN 2 ELSE 3 END AS allowed FROM (VALUES ('guest'), ('operator'), ('engineer'), ('admin'), ('nobody')) AS r(role), documents_info_v d")(
    lambda t: t.documents_info_v.withColumn("role", F.explode(F.array(*[F.lit(r) for r in ("guest", "operator", "engineer", "admin", "nobody")]))).select("role", "document_id", security.can_read(F.col("role"), F.col("tag")).alias("allowed")))
query("sec3_row_filter", f"SELECT c.claim_id FROM claims_v c JOIN documents_info_v d ON c.document_id = d.document_id WHERE {ALLOWED} OR c.claim_id LIKE '1%'")(
    lambda t: security.secured(t.claims_v, t.documents_info_v, "engineer", t.claims_v.where("claim_id LIKE '1%'").select("claim_id")).select("claim_id"))
query("sec3_withheld", f"SELECT c.document_id, count(*) AS n_withheld FROM claims_v c JOIN documents_info_v d ON c.document_id = d.document_id WHERE NOT {ALLOWED} GROUP BY c.document_id")(lambda t: security.withheld(t.claims_v, t.documents_info_v, "engineer"))
query("sec4_entity_narrowing", f"SELECT c.subject, count(DISTINCT c.document_id) AS n_documents FROM claims_v c JOIN documents_info_v d ON c.document_id = d.document_id WHERE {ALLOWED} GROUP BY c.subject")(
    lambda t: security.secured(t.claims_v, t.documents_info_v, "engineer").groupBy("subject").agg(F.countDistinct("document_id").alias("n_documents")))
query("sec5_scope_probe", f"SELECT DISTINCT c.document_id, c.chunk_id FROM claims_v c JOIN documents_info_v d ON c.document_id = d.document_id WHERE NOT {ALLOWED} AND c.predicate = 'flow_rate' AND c.numeric_value > 49")(
    lambda t: t.claims_v.where("predicate = 'flow_rate' and numeric_value > 49").join(t.documents_info_v.where(~security.can_read(F.lit("engineer"), F.col("tag"))).select("document_id"), "document_id", "left_semi").select("document_id", "chunk_id").distinct())
query("sec2_classification", "SELECT document_id, CASE WHEN document_id = 'doc3' THEN 'INTERNAL' WHEN origin = 'upload' THEN 'CONFIDENTIAL' WHEN document_type = 'standard' THEN 'PUBLIC' WHEN document_type = 'datasheet' THEN 'INTERNAL' ELSE 'SECRET' END AS classified FROM documents_info_v")(
    lambda t: security.classify_documents(t.documents_info_v, t.spark.createDataFrame([("doc3", "INTERNAL")], "document_id string, pin string"), (("standard", "PUBLIC"), ("datasheet", "INTERNAL"))).select("document_id", "classified"))
query("sec6_grants", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'revoked' WHEN o_totalprice > 300000 THEN 'spent' WHEN o_orderkey % 7 = 0 THEN 'expired' WHEN o_custkey % 5 = 0 THEN 'requester' ELSE 'granted' END AS reason FROM orders""")(
    lambda t: t.orders.select("o_orderkey", security.grant_reason(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 300000, F.col("o_orderkey") % 7 == 0, F.col("o_custkey") % 5 == 0, F.lit(False)).alias("reason")))
query("sec7_release_routing", "SELECT subject, max(CASE d.tag WHEN 'PUBLIC' THEN 0 WHEN 'INTERNAL' THEN 1 WHEN 'CONFIDENTIAL' THEN 2 ELSE 3 END) AS needs FROM claims_v c JOIN documents_info_v d ON c.document_id = d.document_id GROUP BY subject")(
    lambda t: security.release_level(t.claims_v, t.documents_info_v, "subject"))
query("val16_leak_check", f"SELECT c.claim_id FROM claims_v c LEFT JOIN documents_info_v d ON c.document_id = d.document_id AND {ALLOWED} WHERE d.document_id IS NULL AND c.numeric_value > 45")(
    lambda t: security.leaks(t.claims_v.where("numeric_value > 45"), t.documents_info_v, "engineer").select("claim_id"))
query("sec3_conflict_rows", f"SELECT subject, predicate, count(*) AS n FROM claims_v c JOIN documents_info_v d ON c.document_id = d.document_id WHERE {ALLOWED} GROUP BY subject, predicate HAVING count(*) >= 2")(
    lambda t: security.secured(t.claims_v, t.documents_info_v, "engineer").groupBy("subject", "predicate").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"))
