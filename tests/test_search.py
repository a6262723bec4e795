"""Filters after fusion, and explanations."""

from factloom.operators import claims, retrieval, security


def test_chapters_are_soft_and_documents_are_not(spark):
    words = spark.createDataFrame([(r, f"c{i}", i + 1) for r in (1, 2, 3) for i in range(6)], "request_id int, chunk_id string, rank int")
    near = spark.createDataFrame([(1, "c5", 1), (1, "gone", 2)], "request_id int, chunk_id string, rank int")
    anchors = spark.createDataFrame([(1, "c4"), (1, "c6")], "request_id int, chunk_id string")
    chunks = spark.createDataFrame([(f"c{i}", ["table", "narrative", None][i % 3], i // 2, "d1" if i != 2 else "d2") for i in range(7)], "chunk_id string, chunk_type string, chapter int, document_id string")
    requests = spark.createDataFrame([(1, None, [], None), (2, [], [2], ["d1"]), (3, ["table"], [9], None), (4, None, None, None)], "request_id int, chunk_types array<string>, chapters array<int>, document_ids array<string>")
    out = {}
    for r in retrieval.search_chunks({"keyword": words, "vector": near}, requests, chunks, 4, anchors).orderBy("request_id", "rank").collect():
        out.setdefault(r.request_id, []).append((r.chunk_id, r.reasons, r.soft))
    assert out[1] == [("c4", "entity+keyword", False), ("c5", "keyword+vector", False), ("c0", "keyword", False), ("c1", "keyword", False)]
    assert out[2] == [("c4", "keyword", False), ("c5", "keyword", False), ("c0", "keyword", True), ("c1", "keyword", True)]  # c2 is of another document
    assert out[3] == [("c0", "keyword", True), ("c3", "keyword", True)] and 4 not in out
    assert retrieval.search_chunks({"keyword": words.limit(0)}, requests, chunks, 4).count() == 0


def test_explanations_stand_around_reasons_and_keywords(spark):
    long = "The column is heated. " * 40 + "Steam strips the column because light ends remain. " + "More about trays follows here. " * 30
    chunks = spark.createDataFrame([(1, long, "narrative", 3, "d"), (2, "The column has trays.", "table", 3, "d"), (3, "Column trays hold liquid.", "control", None, None), (4, None, "narrative", 1, "d"), (5, "Nothing of note here", "safety", 1, "d"), *[(k, f"Unrelated words again {k}", "safety", 1, "d") for k in range(6, 12)]], "chunk_id int, text string, chunk_type string, chapter int, document_id string")
    requests = spark.createDataFrame([(1, "why is the column stripped with trays", ["trays"]), (2, "zzz", None), (3, None, ["x"])], "request_id int, text string, keywords array<string>")
    out = retrieval.explanations(chunks, requests).orderBy("rank").collect()
    assert {r.chunk_id for r in out} == {1, 3} and {r.request_id for r in out} == {1}
    assert "because light ends" in [r.excerpt for r in out if r.chunk_id == 1][0] and [r.excerpt for r in out if r.chunk_id == 3] == ["Column trays hold liquid."]
    assert {r.chunk_id for r in retrieval.explanations(chunks, requests, "support").collect()} == {1, 2, 3}


def test_confidence_of_answers(spark):
    results = spark.createDataFrame([(1, "lookup", 0.8, True, False, 0), (1, "graph", 0.4, False, True, 2), (1, "verification", 0.0, True, False, 1), (2, "report", 0.9, True, False, 9), (3, None, None, None, None, None), (4, "lookup", 1.0, True, False, 0)], "request_id int, agent string, score double, ok boolean, optional boolean, n_missing int")
    verdicts = spark.createDataFrame([(1, 0.5), (2, 0.0), (4, None)], "request_id int, verified double")
    out = {r.request_id: (r.base, r.score) for r in claims.answer_confidence(results, verdicts).collect()}
    base = (0.8 + 0.15 * 0.4) / 1.15
    assert out == {1: (round(base, 2), round(base * 0.8 - 0.15, 2)), 2: (0.3, 0.0), 3: (0.0, 0.0), 4: (1.0, 1.0)}


def test_scope_of_a_request_holds_ids_of_closed_documents_only(spark):
    requests = spark.createDataFrame([(1, "operator", "e1"), (1, "operator", "e2"), (2, "admin", "e1"), (3, None, "e1"), (4, "guest", None)], "request_id int, role string, entity_uid string")
    documents = spark.createDataFrame([("open", "PUBLIC"), ("shut", "CONFIDENTIAL"), ("unknown", None)], "document_id string, tag string")
    records = spark.createDataFrame([("e1", d, "claim", f"{d[0]}{i}", i) for d in ("open", "shut") for i in range(5)] + [("e2", "shut", "claim", "s4", 4), ("e2", "unknown", "chunk", "u", 1), ("e1", "shut", "note", "n", 1), ("e1", "lost", "claim", "l", 9), ("e1", "shut", "claim", None, 9)], "entity_uid string, document_id string, kind string, id string, weight int")
    entities = spark.createDataFrame([("e1", "open"), ("e1", "unknown"), ("e1", "shut"), ("e2", "open")], "entity_uid string, document_id string")
    out = {}
    for r in security.scope_probe(requests, records, documents, entities, {"claim": 2, "chunk": 3}).collect():
        out.setdefault(r.request_id, set()).add((r.document_id, r.record_id))
    assert out == {1: {("shut", "claim:s4"), ("shut", "claim:s3"), ("unknown", "chunk:u"), ("shut", "entity:e1")}, 3: {("shut", "claim:s4"), ("shut", "claim:s3"), ("shut", "entity:e1")}}


def test_equal_names_meet_requests_once(spark):
    requests = spark.createDataFrame([(1, "red Pump"), (2, "pump red"), (3, "blue")], "request_id int, text string")
    entities = spark.range(300).selectExpr("concat('e', id) AS entity_uid", "id AS mention_count", "CASE WHEN id % 2 = 0 THEN 'Red pump' ELSE 'pump' END AS name")
    out = retrieval.search_names(requests, entities, 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(request_id" not in plan and "windowspecdefinition(x" in plan  # ranked by set of words, not by request
    assert sorted(tuple(r) for r in out.collect()) == [(r, u, 1_100_000, k) for r in (1, 2) for k, u in ((1, "e100"), (2, "e102"))]


def test_equal_procedures_are_cut_before_requests(spark):
    procedures = spark.range(50).selectExpr("id AS procedure_id", "CAST(id % 2 AS STRING) AS procedure_type", "array('a') AS applies_to", "array('a', 'b') AS step_tags", "array('x') AS head_tokens", "array('y') AS step_tokens", "100 - id AS page")
    requests = spark.createDataFrame([(1, "a", "1", ["x"]), (2, "a", "1", ["x"]), (3, "b", None, []), (4, "c", None, ["x"])], "request_id int, entity string, procedure_type string, tokens array<string>")
    out = retrieval.score_procedures(procedures, requests, 2)
    assert "windowspecdefinition(__e" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(1, 47, 8.4, 2), (1, 49, 8.4, 1), (2, 47, 8.4, 2), (2, 49, 8.4, 1), (3, 48, 1.4, 2), (3, 49, 1.4, 1)]
