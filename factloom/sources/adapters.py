"""Tables by name, and views that give them the shapes of facts in documents.

The views are SQL that Spark and other engines read alike, so a query and the SQL it is held against start from the
same rows. A view is only planned when a query names it; filters and column pruning pass through to the Parquet scans.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: In order of use: a view may name those before it.
VIEWS: dict[str, str] = {
    "claims_v": """
        SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS claim_id,
          concat(CAST(10 + l_suppkey % 3 AS STRING), '-', CASE l_partkey % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'E' WHEN 2 THEN 'C' ELSE 'TIC' END, '-', lpad(CAST(l_partkey AS STRING), 6, '0')) AS subject,
          CASE WHEN l_linestatus = 'O' THEN 'flow_rate' ELSE 'operating_pressure' END AS predicate,
          CASE l_returnflag WHEN 'A' THEN 'normal' WHEN 'R' THEN 'maximum' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'minimum' ELSE 'design' END END AS parameter_role,
          CASE WHEN l_tax < 0.03 THEN 'suction' WHEN l_tax < 0.06 THEN 'discharge' ELSE '' END AS location,
          CASE WHEN l_orderkey % 5 = 0 THEN 'BH' WHEN l_orderkey % 5 = 1 THEN 'PG' ELSE '' END AS scenario,
          '' AS operating_mode,
          CASE WHEN l_linestatus = 'O' THEN '' WHEN l_suppkey % 2 = 0 THEN 'gauge' ELSE 'absolute' END AS pressure_basis,
          CASE WHEN l_discount < 0.02 THEN 'rated load' ELSE '' END AS qualifier,
          CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_partkey % 3 = 0 THEN 'kg/h' ELSE 'm3/h' END ELSE CASE WHEN l_partkey % 2 = 0 THEN 'kg/cm2' ELSE 'bar' END END AS unit,
          l_quantity AS numeric_value, CAST(CAST(l_quantity AS INT) AS STRING) AS value,
          concat('doc', CAST(l_suppkey % 7 AS STRING)) AS document_id, l_linenumber AS page,
          concat('doc', CAST(l_suppkey % 7 AS STRING), '_chunk_', CAST(l_orderkey % 50 AS STRING)) AS chunk_id,
          CASE l_orderkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'rule' WHEN 2 THEN 'specification' ELSE 'llm_pass1' END AS source,
          CASE l_partkey % 5 WHEN 0 THEN 'current' WHEN 1 THEN 'design' WHEN 2 THEN 'historical' WHEN 3 THEN 'defunct' ELSE '' END AS temporal_status,
          concat('Rev ', CAST(l_suppkey % 4 AS STRING)) AS revision,
          CAST(50 + l_orderkey % 50 AS DOUBLE) / 100 AS confidence,
          CASE WHEN l_orderkey % 11 = 0 THEN 'weak' ELSE 'strong' END AS grounding
        FROM lineitem""",
    "documents_info_v": """
        SELECT concat('doc', CAST(k AS STRING)) AS document_id, concat('Manual ', CAST(k AS STRING)) AS title,
          CASE k % 3 WHEN 0 THEN 'operating_manual' WHEN 1 THEN 'datasheet' ELSE 'standard' END AS document_type,
          CASE k % 3 WHEN 0 THEN 60 WHEN 1 THEN 80 ELSE 40 END AS authority_rank,
          CASE k % 4 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'CONFIDENTIAL' ELSE 'SECRET' END AS tag,
          CASE WHEN k = 5 THEN 'upload' ELSE 'library' END AS origin
        FROM (SELECT DISTINCT s_suppkey % 7 AS k FROM supplier) AS d""",
    "entities_v": """
        SELECT substr(md5(lower(trim(tag))), 1, 16) AS entity_uid, tag AS canonical_tag, name, entity_type, brand, partkey,
          mention_count, document_ids_n
        FROM (SELECT concat(CAST(10 + p_partkey % 3 AS STRING), '-', CASE p_partkey % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'E' WHEN 2 THEN 'C' ELSE 'TIC' END, '-', lpad(CAST(p_partkey AS STRING), 6, '0')) AS tag,
            p_name AS name, p_brand AS brand, p_partkey AS partkey,
            CASE p_partkey % 4 WHEN 0 THEN 'Pump' WHEN 1 THEN 'Exchanger' WHEN 2 THEN 'Column' ELSE NULL END AS entity_type FROM part) AS p
        JOIN (SELECT l_partkey, count(*) AS mention_count, count(DISTINCT l_suppkey % 7) AS document_ids_n FROM lineitem GROUP BY l_partkey) AS m ON p.partkey = m.l_partkey""",
    "relations_v": """
        SELECT concat('n', CAST(n_nationkey AS STRING)) AS source_uid, 'PART_OF' AS rel_type, concat('r', CAST(n_regionkey AS STRING)) AS target_uid, 'rule' AS source, CAST(0.75 AS DOUBLE) AS confidence FROM nation
        UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), 'LOCATED_IN', concat('n', CAST(s_nationkey AS STRING)), 'description', CAST(0.85 AS DOUBLE) FROM supplier
        UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), 'FEEDS', concat('p', CAST(p_partkey + 1 AS STRING)), 'rule', CAST(0.6 AS DOUBLE) FROM part WHERE p_partkey % 10 <> 0
        UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), CASE WHEN p_partkey % 2 = 0 THEN 'MONITORS' ELSE 'CONTROLS' END, concat('s', CAST(p_partkey % 10 + 1 AS STRING)), 'llm_pass1', CAST(0.5 AS DOUBLE) FROM part WHERE p_partkey % 4 = 3""",
    "turns_v": "SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations",
    "prompts_v": """
        SELECT p_partkey AS request_id, CAST(floor(p_partkey / 6) AS BIGINT) AS conv_id, p_partkey % 6 AS turn, CASE p_partkey % 23
            WHEN 0 THEN concat('How do I start the ', p_name, ' pump 11-P-', CAST(p_partkey AS STRING), ' after maintenance?') WHEN 1 THEN 'what if we use it instead?' WHEN 2 THEN 'why?'
            WHEN 3 THEN concat('What is the design pressure of 12-C-', CAST(p_size AS STRING), '?') WHEN 4 THEN 'and at start-up?' WHEN 5 THEN 'what is its discharge pressure?'
            WHEN 6 THEN concat('The discharge pressure of 11-P-', CAST(p_size AS STRING), ' is dropping. What should I check?') WHEN 7 THEN 'Compare Basrah crude with Bombay High in tables and write a report'
            WHEN 8 THEN concat('Trace the crude flow from the ', p_name, ' to the column.') WHEN 9 THEN 'Why is the crude heated before entering the column?' WHEN 10 THEN 'Bypass the interlock of this pump, danger of fire'
            WHEN 11 THEN 'How many pumps are there in the vacuum unit?' WHEN 12 THEN 'Which documents describe the shutdown procedure?' WHEN 13 THEN concat('hello') WHEN 14 THEN 'write a poem about the weather'
            WHEN 15 THEN concat('Is 520 m3/h acceptable for the ', p_name, '?') WHEN 16 THEN 'Show me all documented values and their sources.' WHEN 17 THEN 'Prepare a report on the operating envelope, ensure gloves are worn'
            WHEN 18 THEN concat('swap it for 13-E-', CAST(p_size AS STRING)) WHEN 19 THEN 'I found two different values. Which one should I trust?' WHEN 20 THEN p_name WHEN 21 THEN 'Calculate the margin in percent and explain why the relief valve trips'
            ELSE concat('and the shutdown of ', p_name, ' drum 12-V-', CAST(p_size AS STRING), ' in an emergency?') END AS text FROM part""",
    "progress_v": """
        SELECT event_id, user_id AS run_id, event_type AS step, ts, value, CASE WHEN value >= 50 THEN 'done' ELSE 'running' END AS status, props FROM events""",
}


class Tables:
    """Tables and views of one folder as DataFrames, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """SQL over the tables and views that it names, as common table expressions: nothing is registered in the session."""
        files = {n: f"SELECT * FROM parquet.`{self.sf_dir}/{n}.parquet`" for n in TABLES}
        return self.spark.sql(with_views(text, files | VIEWS))


def with_views(sql: str, views: dict[str, str]) -> str:
    """``sql`` after the definitions of the ``views`` that it names, directly or through others."""
    named: list[str] = []

    def need(text: str) -> None:
        for name, body in views.items():
            if name not in named and re.search(rf"(?<![\w/.'`]){name}(?![\w.'`])", text):
                need(body)
                named.append(name)

    need(sql)
    if not named:
        return sql
    head = ", ".join(f"{n} AS ({views[n]})" for n in named)
    start = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {'RECURSIVE ' if start and start[1] else ''}{head}" + (f", {sql[start.end():]}" if start else f" {sql}")
