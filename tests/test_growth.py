"""Queries whose work grows with their input, not with the product of groups or by a Python call a group."""

from pyspark.sql import functions as F

from factloom.functions import tags
from factloom.operators import claims as claim_rows
from factloom.operators import elements, entities, extract, graph, joins, plans, registers, requests, retrieval, security, tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_members_of_a_name_do_not_multiply(spark):
    names = spark.createDataFrame([(k, "Feed Pump" if k < 60 else f"own {k}") for k in range(80)] + [(3, "Spare"), (7, "")], "k long, name string")
    aliases = spark.createDataFrame([(f"u{i}", "feed pumps" if i < 50 else f"other {i}") for i in range(70)] + [("u1", "spare"), ("u9", None)], "entity_uid string, alias string")
    rows = joins.alias_members(names, aliases).collect()
    assert len(rows) == 60 + 50 + 1 + 1
    assert {(r.alias, r.first_k, r.first_uid) for r in rows} == {("feed pump", 0, "u0"), ("spare", 3, "u1")}
    held = lambda side: {(r.alias, r.member) for r in rows if r.side == side}
    links = {(int(k), u) for a, k in held("key") for b, u in held("entity") if a == b}
    assert links == {(k, f"u{i}") for k in range(60) for i in range(50)} | {(3, "u1")}


def test_table_claims_call_no_python_a_table(spark):
    rows = [("t1", "Pump 11-P-01:", 1, ["Pressure (Kg/cm2)", "5", None]), ("t1", "Pump 11-P-01:", 0, ["", "Minimum", "Maximum"]), ("t1", "Pump 11-P-01:", None, ["Temperature (°C)", "", "90"]), ("t2", None, 0, ["alone"]), (None, "Drum", 0, ["Capacity", "7"]), (None, "Drum", 1, ["Speed rpm", "30"])]
    out = extract.table_claims(spark.createDataFrame(rows, "table_id string, hint string, row int, cells array<string>"))
    assert sorted(map(repr, ((r.table_id, r.subject, r.predicate, r.value, r.unit, r.parameter_role, r.layout) for r in out.collect()))) == sorted(map(repr, [
        ("t1", "11-P-01", "minimum_pressure", "5", "kg/cm2", "minimum", "A"), ("t1", "11-P-01", "maximum_temperature", "90", "°C", "maximum", "A"), (None, "Drum", "flow_rate", "7", "", "", "C"), (None, "Drum", "speed", "30", "rpm", "", "C")]))
    assert "InPandas" not in plan_of(out) and "MapInArrow" in plan_of(out)


def test_requests_of_one_file_are_classified_in_many_tasks(spark):
    asked = spark.createDataFrame([(i, "Compare the two") for i in range(40)], "request_id int, text string").coalesce(1)
    out = requests.classify_tasks(asked)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.request_id, r.task) for r in out.collect()} == {(i, "comparison") for i in range(40)}


def test_a_plan_is_made_once_a_shape(spark):
    rows = [(i, "lookup" if i % 2 else None, ["safety"] if i % 3 else None, None, i % 2 == 0, None, False) for i in range(60)] + [(7, "lookup", ["safety"], None, False, None, False)]
    steps = plans.plan_steps(spark.createDataFrame(rows, "request_id int, task string, secondary array<string>, has_entity boolean, has_value boolean, has_mentions boolean, wants_report boolean"))
    assert [tuple(r) for r in steps.where("request_id = 7").orderBy("place", "step").select("place", "step").collect()] == [(1, "lookup"), (1, "lookup"), (2, "safety2"), (2, "safety2")]
    assert {(r.request_id, r.step) for r in steps.collect()} == {(i, "lookup") for i in range(60)} | {(i, "safety2") for i in range(60) if i % 3}
    assert "HashAggregate" in plan_of(steps).split("posexplode")[1]


def test_texts_of_one_file_are_searched_in_many_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(retrieval, "settle", lambda df: seen.append(df) or graph.settle(df))
    chunks = spark.createDataFrame([(1, "red valve red"), (2, "valve"), (3, ""), (4, None), (5, "of the"), (6, "green pump line"), (7, "blue tank line")], "k long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "Red pump")], "request_id long, text string")
    ranked = retrieval.bm25(chunks, asked, 5, key="k")
    assert [(r.k, r["rank"]) for r in ranked.orderBy("rank").collect()] == [(1, 1), (6, 2)]
    assert sorted(tuple(r) for r in seen[0].collect()) == [(1, 3, "", 1), (1, 3, "red", 2), (2, 1, "", 1), (6, 3, "", 1), (6, 3, "pump", 1), (7, 3, "", 1)]
    assert len(seen) == 1
    assert retrieval.embed(chunks, "k", "text").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_an_embedding_is_the_signed_counts_of_length_one(spark):
    rows = spark.createDataFrame([(1, "red valve red"), (2, None), (3, "the")], "k long, text string")
    hashed = {w: spark.sql(f"SELECT pmod(xxhash64('{w}'), 16) AS h").first().h for w in ("red", "valve")}
    want = [0.0] * 8
    for w, n in (("red", 2), ("valve", 1)):
        want[hashed[w] % 8] += n if hashed[w] < 8 else -n
    norm = sum(x * x for x in want) ** 0.5
    assert {r.k: list(r.embedding) for r in retrieval.embed(rows, "k", "text", 8).collect()} == {1: [x / norm for x in want], 2: [0.0] * 8, 3: [0.0] * 8}


def test_cells_meet_common_tokens_as_counts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(elements, "settle", lambda df: seen.append(df) or graph.settle(df))
    rows = [("d", f"t{p}", p, i % 3, f"Plant name {p}{i}" if p < 4 else f"own {chr(97 + p)}") for p in range(6) for i in range(40)] + [("d", "t0", 0, 1, None), ("d", "t5", 5, 9, "Plant name 11"), ("few", "t9", 1, 0, "Plant name 1")]
    out = elements.template_tables(spark.createDataFrame(rows, "document_id string, table_id string, page int, row int, content string"), spark.createDataFrame([("d", 6), ("few", 3)], "document_id string, pages int"))
    assert {tuple(r) for r in out.collect()} == {("d", f"t{p}") for p in range(4)}
    assert len(seen) == 1 and {(r.table_id, r.token): r.cells for r in seen[0].where("document_id = 'd'").collect()}["t4", "own e"] == 40 and seen[0].count() < 16


def test_records_nobody_asks_for_are_left_and_equal_ones_go_by_document(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(security, "settle", lambda df: seen.append(df) or graph.settle(df))
    asked = spark.createDataFrame([(i, ("guest", "engineer")[i % 2], "e1") for i in range(40)], "request_id int, role string, entity_uid string").coalesce(1)
    documents = spark.createDataFrame([(f"d{i}", "SECRET") for i in range(9)] + [("open", "PUBLIC")], "document_id string, tag string")
    records = spark.createDataFrame([(e, f"d{i}", "claim", "same", 5) for e in ("e1", "e2") for i in reversed(range(9))] + [("e1", "open", "claim", "x", 9)], "entity_uid string, document_id string, kind string, id string, weight int")
    out = security.scope_probe(asked, records, documents, spark.createDataFrame([("e2", "d0")], "entity_uid string, document_id string"), {"claim": 2})
    assert sorted(tuple(r) for r in out.collect()) == [(i, d, "claim:same") for i in range(40) for d in ("d0", "d1")]
    assert sorted((r.entity_uid, r.role, r.x.document_id) for r in seen[0].collect()) == [("e1", r, d) for r in ("engineer", "guest") for d in ("d0", "d1")]


RAW = ["11-P-01", " 11-p-01a/b ", "P-1", "12 V 3", "11-P-01\n", "IS-4576", "11-P-000001", "p–12 A", "abc", "12", "", None, "ABCDE-1", "11-P-1/A", "(11-P-1)", "1-A-1" + "A/A" * 14, "11_P_7 B , C", "\n11-P-2", "Ä-1", "11-P-1 x"]


def test_a_tag_is_parsed_step_by_step_and_told_by_one_pattern(spark):
    out = spark.createDataFrame([(i, r) for i, r in enumerate(RAW)], "i int, raw string").select("i", tags.parse_tag("raw")["canonical"].alias("c"), tags.is_tag("raw").alias("t")).collect()
    got = {RAW[r.i]: r.c for r in out}
    dashed = F.regexp_replace(tags.cleaned("raw"), "(?<=[A-Z0-9]) (?=[A-Z0-9])", "-")  # what was parsed before, without the short ways
    long = {RAW[r.i]: r.d for r in spark.createDataFrame([(i, r) for i, r in enumerate(RAW)], "i int, raw string").select("i", F.when(dashed.rlike(tags.PATTERN) & (F.length(dashed) <= 32) & ~dashed.rlike("^IS-"), dashed).alias("d")).collect()}
    assert {k: v is None for k, v in got.items()} == {k: v is None for k, v in long.items()} and all(r.t == (r.c is not None) for r in out)
    assert got["11-P-01\n"] == "11-P-01" and got[" 11-p-01a/b "] == "11-P-01" and got["12 V 3"] == "12-V-3" and got["IS-4576"] is None


def test_trains_and_columns_parse_a_text_once(spark):
    claims = spark.createDataFrame([("a", "11-P-1A"), ("b", "11-P-1"), ("c", "odd one"), ("d", None)], "claim_id string, subject string")
    items = spark.createDataFrame([("11-P-1",), ("11-P-1A",), ("odd one",)], "canonical_tag string")
    out = entities.expand_trains(items, claims)
    assert {tuple(r) for r in out.collect()} == {("11-P-1", "a"), ("11-P-1A", "a"), ("11-P-1", "b"), ("odd one", "c")}
    assert plan_of(out).count(tags.PATTERN) <= 5 * 2  # one rlike and four groups, in the plan and its adaptive copy
    cells = spark.createDataFrame([("t", 0, c, x) for c, xs in enumerate((["11-P-1", ""], ["5", "6"], ["11 P 1", "x"])) for x in xs], "table_id string, row int, col int, content string")
    assert {r.col: r.data_type for r in tables.column_types(cells).collect()} == {0: "tag", 1: "numeric", 2: "text"}
    assert tags.CLEAN in plan_of(tables.column_types(cells))


def test_claims_of_a_group_are_shuffled_once(spark):
    names = ["subject", "numeric_value", "document_id", "page", "chunk_id", *claim_rows.CONTEXT]
    made = [(f"s{i % 3}", None if i == 8 else [1.0, 1.00001, 2.0][i % 2 + (i > 20)], f"d{i % 2}", None if i % 7 == 0 else i % 4, "c", "p", "", "", "", "", "", "") for i in range(30)] + [("lone", 1.0, "d", 1, "c", *[""] * 7)]
    rows = spark.createDataFrame(made, ", ".join(f"{n} {'double' if n == 'numeric_value' else 'int' if n == 'page' else 'string'}" for n in names))
    out = claim_rows.conflicts(rows)
    want = claim_rows.with_context_key(rows.where("numeric_value is not null")).groupBy("subject", "context_key").agg(F.count(F.lit(1)), F.countDistinct("document_id", "page", "chunk_id"), F.countDistinct(F.round(F.col("numeric_value") * 10000).cast("long")))
    assert sorted((r.subject, r.context_key, r.n_claims, r.n_places, r.n_values) for r in out.collect()) == sorted(tuple(r) for r in want.collect() if r[2] > 1 and r[3] > 1)
    assert "Expand" not in plan_of(out) and plan_of(out).count("Exchange hash") == 2  # the plan and its first form


def test_subjects_of_a_cube_are_sums(spark):
    rows = spark.createDataFrame([(None if i == 5 else f"s{i % 5}", f"p{i % 2}", None if i % 7 == 0 else f"l{i % 3}") for i in range(40)], "subject string, predicate string, location string")
    out = claim_rows.counts_of_cube(rows)
    want = rows.cube("predicate", "location").agg(F.count(F.lit(1)), F.countDistinct("subject"))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert claim_rows.counts_of_cube(rows.limit(0)).count() == rows.limit(0).cube("predicate", "location").count().count()


def test_labels_meet_values_without_a_join(spark):
    lines = ["Make: KSB", "Model:", "Speed:", "5", "6", "Text", "Ab:", "7", "8", "Bc:", "Text", "9", "Cd:", "1"]
    rows = spark.createDataFrame([(d, i, x) for d in ("d", "e") for i, x in enumerate(lines)] + [(None, 0, "Ab:"), (None, 1, "3"), ("n", 1, None)], "document_id string, reading_order int, content string")
    out = extract.spec_pairs(rows)
    assert sorted(tuple(r) for r in out.collect()) == sorted((d, *x) for d in ("d", "e") for x in [("Make", "KSB", 0), ("Model", "5", 1), ("Speed", "6", 2), ("Cd", "1", 12)])
    assert "Join" not in plan_of(out)


def test_cells_go_with_their_row(spark):
    cells = spark.createDataFrame([("t", r, c, x, r * 10) for r, xs in enumerate((["a", "b"], [" a", "b "], ["a", None], ["a", ""], ["b", "a"])) for c, x in enumerate(xs)] + [("u", 7, 0, "a", 1), (None, 1, 0, "a", 1)], "table_id string, row int, col int, content string, more int")
    out = tables.drop_repeated_rows(cells)
    assert out.columns == cells.columns and sorted(tuple(r) for r in out.collect()) == sorted([("t", 0, 0, "a", 0), ("t", 0, 1, "b", 0), ("t", 2, 0, "a", 20), ("t", 2, 1, None, 20), ("t", 4, 0, "b", 40), ("t", 4, 1, "a", 40), ("u", 7, 0, "a", 1)])
    assert "Join" not in plan_of(out)


def test_numbers_are_looked_for_where_a_slash_is(spark):
    rows = [("d", 1, 0, ["No", "Standing Instruction No", "Title", "Date", "Status"], 3), ("d", 1, 1, ["1", "ab  / PROD / SI / 7", " a  title", "now", "expired"], 3), ("d", 1, 2, ["2", "none / here", "x", "y", "z"], 3), ("d", 2, 0, ["1", "AB / SI / 8", "t", "D", None], 4), ("d", 2, 1, ["1", "AB / SI / 7", "late", "D", ""], 4), ("e", 1, 0, ["1", "AB / SI / 8", "t"], 4)]
    out = registers.standing_instructions(spark.createDataFrame(rows, "document_id string, place int, row int, cells array<string>, page int"))
    assert sorted((r.document_id, r.number, r.title, r.status, r.page) for r in out.collect()) == [("d", "AB/PROD/SI/7", "a title", "expired", 3), ("d", "AB/SI/7", "late", "in_use", 4), ("d", "AB/SI/8", "t", "in_use", 4)]
    assert ", /)" in plan_of(out)  # a slash is looked for before the pattern


def test_stored_elements_are_shuffled_once(spark):
    from factloom.plans import all_queries

    out = all_queries()["src5_chunks_with_elements"](spark, "/root/testdata/sf0.001")
    assert plan_of(out).count("Exchange hash") == 2  # elements, once without repeats, and a chunk's elements
    assert out.count() == out.select("chunk_id").distinct().count() > 0 and out.where("n <> size(split(elements, ','))").count() == 0
