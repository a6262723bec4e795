"""Queries equal their SQL on keys beyond the small tables': tags' numbers of more than five digits, and tags that repeat."""

import os

import duckdb
import pytest
from test_queries import DATA, plain

from factloom.operators import entities
from factloom.plans import all_queries, all_sql

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
SHIFTS = {"p_partkey": (0, 99_900, 1_000_000), "s_suppkey": (0, 29_995, 60_000), "o_orderkey": (0, 10_000, 20_000)}
KEYS = {"part": {"p_partkey": "p_partkey"}, "supplier": {"s_suppkey": "s_suppkey"}, "orders": {"o_orderkey": "o_orderkey"}, "lineitem": {"l_partkey": "p_partkey", "l_suppkey": "s_suppkey", "l_orderkey": "o_orderkey"}}
NAMES = """ext10_type_inference ext4_prose_claims ext5_rule_relations ext6_co_mention ext7_description_relations ext8_entity_harvest ext8_tag_mentions ext9_equipment_columns
  flt12_plant_items gra7_trains joi3_redirect qry15_request_resolution qry16_follow_ups str25_take_apart""".split()


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("shifted"), duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        name, own = f[:-8], KEYS.get(f[:-8], {})
        moved = ", ".join(f"CAST({c} + {list(SHIFTS[k])}[i] AS BIGINT) AS {c}" for c, k in own.items())
        rows = f"SELECT * REPLACE ({moved}) FROM (SELECT * FROM '{DATA}/{f}') t, range(1, 4) r(i)" if own else f"SELECT * FROM '{DATA}/{f}'"
        con.execute(f"COPY (SELECT {'* EXCLUDE (i)' if own else '*'} FROM ({rows})) TO '{folder}/{f}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{f}'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_query_on_large_keys(spark, shifted, name):
    out = all_queries()[name](spark, shifted[0])
    columns = sorted(out.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in out.collect())
    cursor = shifted[1].execute(all_sql()[name])
    names = [d[0] for d in cursor.description]
    assert rows == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())


def test_a_repeated_redirect_adds_no_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "uid string, n int")
    to = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x")], "uid string, target_uid string")
    assert sorted(tuple(r) for r in entities.redirect(rows, to).collect()) == [("b", 2), ("x", 1), ("x", 3)]


def test_rows_of_a_table_are_told_apart_by_any_part_key(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * REPLACE (CAST(7 AS BIGINT) AS l_orderkey, CAST(k AS BIGINT) AS l_partkey, CAST(n AS INT) AS l_linenumber) FROM (SELECT * FROM '{DATA}/lineitem.parquet' LIMIT 1) l, (VALUES (102382, 1), (2382, 2), (5, 3)) v(k, n)")
    con.execute(f"CREATE VIEW orders AS SELECT * REPLACE (CAST(7 AS BIGINT) AS o_orderkey) FROM (SELECT * FROM '{DATA}/orders.parquet' LIMIT 1) o")
    for name in ("lineitem", "orders"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    rows = all_queries()["ext9_equipment_columns"](spark, str(tmp_path)).select("table_id", "tag", "description").collect()
    assert sorted(map(tuple, rows)) == sorted(con.execute(f"SELECT table_id, tag, description FROM ({all_sql()['ext9_equipment_columns']})").fetchall())


def test_relations_of_every_part_are_read(spark, shifted):
    rows = all_queries()["ext5_rule_relations"](spark, shifted[0]).select("chunk_id", "subject", "object").collect()
    assert sorted(int(r.chunk_id) for r in rows) == sorted(k for (k,) in shifted[1].execute("SELECT p_partkey FROM part WHERE p_partkey % 4 < 3").fetchall())
    assert all(r.subject == f"11-P-{r.chunk_id}" and r.object.endswith(f"-{int(r.chunk_id) + 1}") for r in rows)


def test_every_claim_mentions_a_tag(spark, shifted):
    rows = all_queries()["ext8_tag_mentions"](spark, shifted[0]).collect()
    assert sum(r.mentions for r in rows) == shifted[1].execute("SELECT count(*) FROM lineitem").fetchone()[0]
    assert max(len(r.tag.split("-")[-1]) for r in rows) == 5 and len({len(r.tag.split("-")[0]) for r in rows}) == 2
