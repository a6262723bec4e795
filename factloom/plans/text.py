"""Queries over text, tags and units."""

from pyspark.sql import functions as F

from ..functions import phrases, tags, text, units
from ..functions.vocabulary import GENERIC_SUBJECTS, NON_TAG_PREFIXES, STOP_WORDS
from ..streaming import progress
from .registry import query

IPS = "SELECT DISTINCT user_id, CASE user_id % 6 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN concat('10.0.', CAST(user_id % 256 AS STRING), '.7') WHEN 2 THEN concat('172.', CAST(16 + user_id % 16 AS STRING), '.1.9') WHEN 3 THEN '0.0.0.0' WHEN 4 THEN '10.0.0.999' ELSE concat('172.32.', CAST(user_id % 256 AS STRING), '.8') END AS ip FROM events"

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
TOKENS = f"list_filter(regexp_extract_all(replace(lower(coalesce({{0}}, '')), '–', '-'), '[a-z0-9]+(?:[-/][a-z0-9]+)*'), lambda w: length(w) > 1 AND w NOT IN ({STOPS}))"
ALIAS = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[–—]', '-', 'g'), '[^a-z0-9/ \-]+', ' ', 'g'), ' *- *', '-', 'g'), ' +', ' ', 'g'))"
NORM = f"CASE WHEN length({ALIAS}) > 4 AND NOT ends_with({ALIAS}, 'ss') THEN regexp_replace({ALIAS}, 's$', '') ELSE {ALIAS} END"

query("str1_tokenize", f"SELECT doc_id, len({TOKENS.format('text')})::INT AS n, md5(array_to_string({TOKENS.format('text')}, ' ')) AS tokens FROM documents")(
    lambda t: t.documents.withColumn("k", text.tokenize("text")).select("doc_id", F.size("k").alias("n"), F.md5(F.array_join("k", " ")).alias("tokens")))
NAMES = "SELECT p_partkey, concat(p_name, CASE p_partkey % 4 WHEN 0 THEN 's' WHEN 1 THEN ' – (B)' WHEN 2 THEN '  glass' ELSE '' END) AS n FROM part"
query("str2_norm_alias", f"SELECT p_partkey, n, {NORM.format('n')} AS alias FROM ({NAMES})")(lambda t: t.sql(NAMES).withColumn("alias", text.norm_alias("n")))
query("str4_token_estimate", r"SELECT doc_id, (len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) * 13 // 10)::BIGINT AS estimate FROM documents")(
    lambda t: t.documents.select("doc_id", text.token_estimate("text").alias("estimate")))
#: Sentences by marks put between them: after .!?; before a capital or bracket, and for line feeds.
MARKED = r"regexp_replace(regexp_replace(coalesce(text, ''), '([.!?;])[\x20\x09-\x0D]+([A-Z(\[])', '\1' || chr(1) || '\2', 'g'), '\n+', chr(1), 'g')"
SENTENCES = f"SELECT doc_id, list_filter(list_transform(string_split({MARKED}, chr(1)), lambda x: trim(x)), lambda x: length(x) >= 3) AS s FROM documents"
query("str6_sentence_split", f"SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS pos, unnest(s) AS sentence FROM ({SENTENCES})")(lambda t: t.documents.select("doc_id", F.posexplode(text.sentences("text")).alias("pos", "sentence")))
query("str5_last_sentences", r"SELECT doc_id, array_to_string(p[greatest(1, len(p) - 1):], ' ') AS tail FROM (SELECT doc_id, string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents)")(lambda t: t.documents.select("doc_id", text.last_sentences("text").alias("tail")))
query("str8_numbers", r"SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.][0-9]+)?'), lambda x: x::DOUBLE)))::INT AS n FROM documents")(
    lambda t: t.documents.select("doc_id", F.size(text.numbers("text")).alias("n")))
RAW = """SELECT partkey, CASE partkey % 7 WHEN 0 THEN lower(canonical_tag) WHEN 1 THEN replace(canonical_tag, '-', ' – ') WHEN 2 THEN concat(substr(canonical_tag, 1, length(canonical_tag) - 1), ' A/B') WHEN 3 THEN concat(' ', substr(canonical_tag, 4), 'A. ')
  WHEN 4 THEN concat('ISO-', CAST(9000 + partkey % 100 AS STRING)) WHEN 5 THEN name ELSE replace(substr(canonical_tag, 1, length(canonical_tag) - 1), '-', '_') END AS raw FROM entities_v"""
CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(raw)), '[–—_]', '-', 'g'), '\s*-\s*', '-', 'g'), '\s*/\s*', '/', 'g'), '\s+', ' ', 'g'), '^[ .,:;()]+|[ .,:;()]+$', '', 'g'), '([0-9]) ([A-Z](?:/[A-Z])*)$', '\1\2')"""
TAG = rf"""WITH r AS ({RAW}), c AS (SELECT *, replace({CLEAN}, ' ', '-') AS d FROM r),
g AS (SELECT *, regexp_extract(d, '^(?:([0-9]{{1,3}})-)?([A-Z]{{1,4}})-([0-9]{{1,5}})([A-Z](?:/[A-Z])*)?$', ['plant', 'prefix', 'number', 'suffix']) AS m,
  regexp_matches(d, '^(?:([0-9]{{1,3}})-)?([A-Z]{{1,4}})-([0-9]{{1,5}})([A-Z](?:/[A-Z])*)?$') AND length(d) <= 32 AS ok FROM c),
b AS (SELECT *, CASE WHEN m.plant <> '' THEN m.plant || '-' ELSE '' END || m.prefix || '-' || m.number AS base, ok AND NOT (m.plant = '' AND m.prefix IN ({", ".join(f"'{p}'" for p in NON_TAG_PREFIXES)})) AS good FROM g)
SELECT partkey, raw, CASE WHEN good THEN CASE WHEN length(m.suffix) = 1 THEN base || m.suffix ELSE base END END AS canonical, CASE WHEN good AND length(m.suffix) = 1 THEN base END AS parent,
  CASE WHEN good THEN CASE WHEN length(m.suffix) > 1 THEN len(string_split(m.suffix, '/')) ELSE 0 END END::INT AS n_children FROM b"""
query("str9_parse_tag", TAG)(lambda t: t.sql(RAW).withColumn("p", tags.parse_tag("raw")).select("partkey", "raw", "p.canonical", "p.parent", F.when(F.col("p").isNotNull(), F.size("p.children")).alias("n_children")))
SCOPED = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('11-P-', CAST(p_partkey % 1000 AS STRING)) ELSE concat('P-', CAST(p_partkey % 1000 AS STRING)) END AS raw FROM part"
query("str10_unit_scope", f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN raw ELSE 'CDU-II/' || raw END AS scoped FROM ({SCOPED})")(
    lambda t: t.sql(SCOPED).select("p_partkey", tags.scoped(tags.parse_tag("raw"), F.lit("cdu (II)")).alias("scoped")))
query("str11_find_tags", "SELECT p_partkey, '11-P-' || p_partkey % 100 || ',E-201,12-V-07B' AS tags FROM part")(lambda t: t.sql("SELECT p_partkey, concat('Start 11-P-', p_partkey % 100, ' A/B then see E-201, ISO-9001, Rev-2, 11 – P – ', p_partkey % 100, ' and 12_V_07 b of ', p_name) AS s FROM part").select("p_partkey", F.array_join(tags.find_tags("s"), ",").alias("tags")))
query("str12_entity_uid", "SELECT p_partkey, substr(md5(lower(trim(p_name))), 1, 16) AS uid, substr(md5(lower(trim(p_name)) || '|' || p_brand), 1, 16) AS scoped FROM part")(
    lambda t: t.part.select("p_partkey", text.entity_uid("p_name").alias("uid"), text.scoped_uid("p_name", "p_brand").alias("scoped")))
VALUES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 5 WHEN 0 THEN concat(' ', CAST(CAST(l_quantity AS INT) AS STRING), ',', lpad(CAST(l_suppkey % 1000 AS STRING), 3, '0'), ' kg/h') WHEN 1 THEN concat('< ', CAST(CAST(l_quantity AS INT) AS STRING), '.5') WHEN 2 THEN concat('SS', CAST(l_suppkey AS STRING)) WHEN 3 THEN concat('-', CAST(CAST(l_quantity AS INT) AS STRING), '-9') ELSE '' END AS v FROM lineitem"
query("str13_leading_number", rf"SELECT * EXCLUDE h, CASE WHEN h <> '' THEN replace(h, ',', '')::DOUBLE END AS n FROM (SELECT *, regexp_extract(trim(v), '^[<>≤≥~±]?[ ]*([+-]?[0-9][0-9,]*(?:[.][0-9]+)?)', 1) AS h FROM ({VALUES}))")(
    lambda t: t.sql(VALUES).withColumn("n", text.leading_number("v")))
query("str14_context_key", "SELECT claim_id, concat_ws('|', predicate, parameter_role, location, '', lower(scenario), pressure_basis, qualifier) AS k FROM claims_v")(
    lambda t: t.claims_v.select("claim_id", text.context_key("predicate", "parameter_role", "location", F.lit(None).cast("string"), "scenario", "pressure_basis", "qualifier").alias("k")))
SPELLED = [("degC", "°C", "temperature", ""), ("kg/cm2 g", "kg/cm2", "pressure", "gauge"), ("KG/HR", "kg/h", "mass_flow", ""), (" m3/hr", "m3/h", "volumetric_flow", ""), ("barg", "barg", "pressure", "gauge"), ("kg/cm2A", "kg/cm2", "pressure", "absolute"),
           ("meters", "m", "length", ""), ("furlong", "furlong", "unknown", ""), ("", "", "text", ""), ("RPM", "rpm", "speed", ""), ("psia", "psia", "pressure", "absolute"), ("pct", "%", "percentage", ""), ("cst", "cSt", "viscosity", "")]
PICK = lambda k: "CASE p_partkey % 13 " + " ".join(f"WHEN {i} THEN '{x[k]}'" for i, x in enumerate(SPELLED)) + " END"
query("str16_unit_spelling", f"SELECT p_partkey, {PICK(1)} AS unit, {PICK(2)} AS family, {PICK(3)} AS basis FROM part")(
    lambda t: t.sql(f"SELECT p_partkey, {PICK(0)} AS u FROM part").select("p_partkey", units.normalize_extracted("u").alias("unit"), units.extracted_family("u").alias("family"), units.extracted_basis("u").alias("basis")))
ASKED = [("degC", "°C", "temperature", None), ("KG/CM²G", "kg/cm2g", "pressure", "gauge"), ("m³/hr", "m3/h", "volumetric_flow", None), ("bar a", "bara", "pressure", "absolute"), ("MPa", "mpa", "pressure", None), ("kgf/cm2", "kg/cm2", "pressure", None),
         ("tph", "tph", "mass_flow", None), ("%", "%", "percentage", None), ("", "", "unknown", None), ("ata", "ata", "pressure", "absolute"), ("MW", "mw", "power", None)]
ASK = lambda k: "CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN " + ("NULL" if x[k] is None else f"'{x[k]}'") for i, x in enumerate(ASKED)) + " END"
query("str19_query_units", f"SELECT p_partkey, {ASK(1)} AS unit, {ASK(2)} AS family, {ASK(3)} AS basis FROM part")(
    lambda t: t.sql(f"SELECT p_partkey, {ASK(0)} AS u FROM part").select("p_partkey", units.normalize("u").alias("unit"), units.family("u").alias("family"), units.basis("u").alias("basis")))
query("str20_convert", """SELECT claim_id, CAST(round(CASE WHEN unit = 'bar' THEN numeric_value * 1.01972 + CASE pressure_basis WHEN 'absolute' THEN -1.033 ELSE 0 END WHEN unit = 'kg/cm2' THEN numeric_value + CASE pressure_basis WHEN 'absolute' THEN -1.033 ELSE 0 END END * 100000) AS BIGINT) AS gauge
  FROM claims_v""")(lambda t: units.with_converted(t.claims_v, "numeric_value", "unit", "kg/cm2g", "gauge", "pressure_basis").select("claim_id", F.round(F.col("gauge") * 100000).cast("long").alias("gauge")))
query("str21_find_quantities", "SELECT claim_id, numeric_value AS value, unit, CAST(NULL AS VARCHAR) AS basis FROM claims_v UNION ALL SELECT claim_id, 3, 'barg', 'gauge' FROM claims_v")(
    lambda t: t.claims_v.select("claim_id", F.explode(units.find_quantities(F.concat(F.lit("Keep at "), "value", F.lit(" "), "unit", F.lit(" under 3 barg")))).alias("q")).select("claim_id", "q.*"))
query("flt10_non_entity", f"SELECT DISTINCT s, trim(s) = '' OR regexp_matches(s, '^[<>]?[ ]*[+-]?[0-9][0-9., /%+-]*$') OR s IN ('IBP', '10%') OR trim(regexp_replace(lower(s), '[^a-z]+', ' ', 'g')) IN ({', '.join(repr(g) for g in GENERIC_SUBJECTS)}) AS is_label FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN 'IBP' WHEN 2 THEN 'Total:' WHEN 3 THEN '6.5-8.0' WHEN 4 THEN '' ELSE p_brand END AS s FROM part)")(
    lambda t: t.sql("SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN 'IBP' WHEN 2 THEN 'Total:' WHEN 3 THEN '6.5-8.0' WHEN 4 THEN '' ELSE p_brand END AS s FROM part").withColumn("is_label", text.is_non_entity_name("s")))
query("str36_ip_class", "SELECT user_id, ip, CASE user_id % 6 WHEN 0 THEN 'loopback' WHEN 1 THEN 'private' WHEN 2 THEN 'private' WHEN 3 THEN 'unspecified' WHEN 4 THEN 'invalid' ELSE 'external' END AS kind FROM (" + IPS + ") AS x")(
    lambda t: t.sql(IPS).select("user_id", "ip", phrases.ip_class("ip").alias("kind")))
query("agg14_session_rollup", """SELECT conv_id, n_turns, n_user, last_turn, CAST(r AS INT) AS r FROM (SELECT conv_id, count(*) AS n_turns, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS n_user, max(turn) AS last_turn, row_number() OVER (ORDER BY count(*) DESC, conv_id) AS r FROM turns_v GROUP BY conv_id) AS x WHERE r <= 50""")(
    lambda t: progress.roll_up(t.turns_v))
query("agg14_last_entities", "SELECT conv_id, turn, head FROM (SELECT conv_id, turn, split_part(text, ' ', 1) AS head, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM turns_v) AS x WHERE r <= 3")(
    lambda t: progress.last_of(t.turns_v, "conv_id", "turn").select("conv_id", "turn", F.split_part("text", F.lit(" "), F.lit(1)).alias("head")))
