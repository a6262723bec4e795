"""Operators on small tables."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import audit, claims, graph, matching, retrieval, security, structure
from factloom.streaming import progress

CLAIM = "claim_id string, subject string, predicate string, parameter_role string, location string, operating_mode string, scenario string, pressure_basis string, qualifier string, unit string, numeric_value double, value string, document_id string, page int, chunk_id string, source string, temporal_status string, revision string, confidence double"


def claim(i, value, role="normal", page=1, unit="m3/h", document="d1", temporal="current", **more):
    row = {"claim_id": f"c{i}", "subject": "11-PM-01", "predicate": "flow_rate", "parameter_role": role, "location": "", "operating_mode": "", "scenario": "", "pressure_basis": "", "qualifier": "", "unit": unit, "numeric_value": value, "value": str(value),
           "document_id": document, "page": page, "chunk_id": f"k{page}", "source": "table", "temporal_status": temporal, "revision": "Rev 1", "confidence": 0.8} | more
    return tuple(row[n.split()[0]] for n in CLAIM.split(", "))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), CLAIM)


def test_conflicts(spark):
    got = claims.conflicts(frame(spark, claim(1, 482.0), claim(7, 470.0, page=2), claim(2, 219.0, "minimum"), claim(3, 500.0, "maximum"), claim(4, 500.0, "maximum", page=3))).collect()
    assert sorted((r.status, r.n_claims) for r in got) == [("corroborated", 2), ("potential_conflict", 2)]
    linked = {(r.numeric_value, r.page): (r.n_corroborating, r.n_conflicting) for r in claims.linked_conflicts(frame(spark, claim(1, 482.0), claim(2, 470.0, page=2), claim(3, 482.0, page=2), claim(4, 482.0, unit="kg/h", page=2))).where("unit = 'm3/h'").collect()}
    assert linked == {(482.0, 1): (1, 1), (470.0, 2): (0, 1), (482.0, 2): (1, 0)}


@pytest.mark.parametrize("value,expected", [(485.0, "within_normal"), (510.0, "within_design"), (530.0, "outside_design"), (300.0, "within_normal")])
def test_limit_verdict(spark, value, expected):
    documents = spark.createDataFrame([("d1", 60)], "document_id string, authority_rank int")
    rows = frame(spark, claim(1, 482.0), claim(2, 219.0, "minimum"), claim(3, 500.0, "maximum"), claim(4, 520.0, "design"))
    limits = claims.envelope(claims.markers(claims.authority(rows, documents, ["subject"]), ["subject"], "m3/h"), ["subject"])
    assert claims.verdict(limits, F.lit(value)).first().verdict == expected


def test_authority_and_filters(spark):
    documents = spark.createDataFrame([("d1", 60), ("d2", 80)], "document_id string, authority_rank int")
    rows = frame(spark, claim(1, 1.0, temporal="historical"), claim(2, 2.0), claim(3, 3.0, document="d2"), claim(4, 4.0, document="d3"))
    got = claims.authority(rows, documents, ["subject"]).orderBy("authority").collect()
    assert [r.claim_id for r in got] == ["c3", "c2", "c4", "c1"] and got[0].reason == "document" and got[-1].reason == "only"
    assert claims.soft_filter(rows, ["subject"], F.col("page") == 9).count() == 4 and claims.soft_filter(rows, ["subject"], F.col("document_id") == "d2").count() == 1


EDGES = [("a", "FEEDS", "b"), ("b", "FEEDS", "c"), ("c", "FEEDS", "a"), ("a", "FEEDS", "d"), ("d", "FEEDS", "c"), ("i", "MONITORS", "a")]


def test_graph(spark):
    relations = spark.createDataFrame([(*e, "rule", 0.5) for e in EDGES], "source_uid string, rel_type string, target_uid string, source string, confidence double")
    starts = spark.createDataFrame([("a",)], "start string")
    hops = lambda *x, **k: {(r.node, r.hop) for r in graph.neighbours(relations, starts, *x, **k).collect()}
    assert hops(1) == {("b", 1), ("c", 1), ("d", 1), ("i", 1)} and hops(2, "out") == {("b", 1), ("d", 1), ("c", 2)}
    assert hops(1, "in", ["MONITORS"]) == {("i", 1)}
    paths = graph.shortest_paths(relations, spark.createDataFrame([("a", "c"), ("c", "i"), ("b", "b")], "start string, target string")).collect()
    assert {(r.start, r.target): r.path for r in paths} == {("a", "c"): ["a", "b", "c"], ("b", "b"): ["b"]}
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    layers = graph.layers(nodes, spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "e"), ("e", "d")], "node string, needs string"))
    assert {r.node: r.layer for r in layers.collect()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None}
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, w int")
    new = spark.createDataFrame([(2, None, 7), (3, "c", 8)], "k int, v string, w int")
    assert sorted(map(tuple, graph.upsert(old, new, ["k"]).collect())) == [(1, "a", 5), (2, "b", 7), (3, "c", 8)]


def test_retrieval(spark):
    chunks = spark.createDataFrame([("k1", "pump losing suction pressure"), ("k2", "column overhead"), ("k3", "suction strainer blocked, suction low"), ("k4", "safety valve")], "chunk_id string, text string")
    ranked = retrieval.bm25(chunks, spark.createDataFrame([(1, "pump suction")], "request_id int, text string"), 3)
    assert [r.chunk_id for r in ranked.orderBy("rank").collect()][0] == "k1"
    fused = retrieval.fuse([ranked.select("request_id", "chunk_id", "rank")], 5, spark.createDataFrame([(1, "k4")], "request_id int, chunk_id string"))
    assert [r.chunk_id for r in fused.orderBy("rank").collect()][-1] == "k4"
    sets = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "d"]), (3, ["x"])], "id int, tokens array<string>")
    assert {(r.left_id, r.right_id) for r in matching.similar_sets(sets, sets, 0.5).collect()} == {(1, 1), (2, 2), (3, 3), (1, 2), (2, 1)}


def test_vector_search_takes_any_number_of_queries(spark):
    vector = lambda i: [float((i * 7 + j * j * 5) % 11 - 5) for j in range(4)]
    vectors = {i: vector(i) for i in range(30)}
    queries = {i: vector(3 * i + 1) for i in range(1_101)}
    got = retrieval.vector_top_k(spark.createDataFrame(list(vectors.items()), "vec_id int, embedding array<float>"), spark.createDataFrame(list(queries.items()), "request_id int, q array<float>"), 3)
    want = set()
    for i, q in queries.items():
        best = sorted((-sum(x * y for x, y in zip(v, q)), j) for j, v in vectors.items())[:3]
        want |= {(i, j, -s, r) for r, (s, j) in enumerate(best, 1)}
    rows = [tuple(r) for r in got.select("request_id", "vec_id", "score", "rank").collect()]
    assert len(rows) == 3 * 1_101 and set(rows) == want


def test_structure(spark):
    rows = [(1, 1, "A"), (2, 2, "B"), (3, 0, "x"), (4, 3, "C"), (5, 2, "D"), (6, 0, "y"), (7, 1, "E"), (8, 3, "F")]
    got = structure.heading_paths(spark.createDataFrame([("d", *r) for r in rows], "doc string, ord int, lvl int, title string"), "doc", "ord", "lvl", "title").orderBy("ord").collect()
    assert [r.section_path for r in got] == ["A", "A > B", "A > B", "A > B > C", "A > D", "A > D", "E", "E > F"]
    cells = spark.createDataFrame([("t", 0, 0, 1, 2, "wide"), ("t", 0, 1, 1, 1, "own"), ("t", 1, 0, 2, 1, "tall")], "table_id string, row int, col int, rowspan int, colspan int, content string")
    assert {(r.row, r.col): r.content for r in structure.propagate_merged(cells).collect()} == {(0, 0): "wide", (0, 1): "own", (1, 0): "tall", (2, 0): "tall"}
    packed = structure.pack(spark.createDataFrame([("d", i, n) for i, n in enumerate([60, 60, 300, 10, 90])], "doc string, ord int, tokens int"), "doc", "ord", "tokens", 128)
    assert [r.chunk for r in packed.orderBy("ord").collect()] == [0, 0, 1, 2, 2]
    html = "<nav><p>menu</p></nav><h1>Title</h1><p>One<p>Two <b>x</b></p><ul><li>a<li>b</ul><!-- <p>no</p> -->"
    elements = structure.html_elements(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("position").collect()
    assert [(e.element_type, e.content) for e in elements] == [("h1", "Title"), ("p", "One"), ("p", "Two x"), ("li", "a"), ("li", "b")]


def test_audit_detects_edit_deletion_and_reorder(spark):
    rows = spark.createDataFrame([("log", i, str(i), f"p{i}") for i in range(6)], "chain string, i int, ts string, payload string")
    log = audit.append(rows, "chain", ["i"])
    check = lambda df: audit.verify(df, "chain").first()
    assert check(log).holds
    edited = check(log.withColumn("payload", F.when(F.col("seq") == 2, "x").otherwise(F.col("payload"))))
    assert (edited.holds, edited.first_bad, edited.reason) == (False, 2, "content")
    assert check(log.where("seq <> 3")).reason == "gap"
    swapped = log.withColumn("seq", F.when(F.col("seq") == 1, 2).when(F.col("seq") == 2, 1).otherwise(F.col("seq")).cast("long"))
    assert check(swapped).first_bad == 1


def test_secured_views_are_subsets(spark):
    documents = spark.createDataFrame([("a", "PUBLIC"), ("b", "SECRET"), ("c", "odd")], "document_id string, tag string")
    rows = spark.createDataFrame([(f"r{i}", d) for i, d in enumerate("abcab")], "claim_id string, document_id string")
    ids = lambda role, grants=None: {r.claim_id for r in security.secured(rows, documents, role, grants).collect()}
    assert ids("nobody") == ids("guest") == {"r0", "r3"} <= ids("admin") == {"r0", "r1", "r2", "r3", "r4"}
    assert ids("guest", spark.createDataFrame([("r4",)], "claim_id string")) == {"r0", "r3", "r4"}
    assert {r.document_id: r.n_withheld for r in security.withheld(rows, documents, "guest").collect()} == {"b": 2, "c": 1}


def test_stream_equals_batch(spark, tmp_path):
    spark.sql("select id as event_id, timestamp_seconds(1704067200 + id * 600) as ts, id % 3 as user_id, elt(int(id % 2) + 1, 'click', 'error') as event_type, double(id) as value from range(300)").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = progress.read_stream(spark, str(tmp_path / "in"), batch)
    for k, (name, f, mode) in enumerate((("windows", lambda e: progress.windowed_counts(e, "6 hours"), "complete"), ("seen", lambda e: progress.first_seen(e, ["user_id", "event_type"], "30 days").select("user_id", "event_type"), "append"), ("sessions", progress.sessions, "complete"))):
        got = progress.run_once(f(stream), name, str(tmp_path / f"c{k}"), mode)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, f(batch).collect())), name


def test_results_do_not_depend_on_partitions(spark):
    rows = frame(spark, *[claim(i, float(i % 7), page=i % 5, role=["normal", "maximum"][i % 2]) for i in range(60)])
    results = [sorted(map(tuple, claims.conflicts(rows.repartition(n)).collect())) for n in (1, 8, 64)]
    assert results[0] == results[1] == results[2]
