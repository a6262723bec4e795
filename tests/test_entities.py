"""Entities, words about claims, checks, tables and joins on small examples."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import claim_rules, phrases, units
from factloom.operators import checks, claims, entities, joins, retrieval, security, tables


@pytest.fixture
def one(spark):
    return lambda x, f: spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("r")).first().r


def test_words_about_values(one):
    assert [one(x, claim_rules.parameter_role) for x in ("Mech. Design", "Pressure (Kg/cm2) / Maximum", "Rated capacity", "Feed", None)] == ["mechanical_design", "maximum", "rated", "", ""]
    assert one("at Flash  Zone", claim_rules.location) == "flash_zone" and one("BH Mode Atmos-side", claim_rules.scenario) == "BH mode" and one("pg crude", claim_rules.scenario) == "PG mode" and one("bh", claim_rules.scenario) == ""
    assert [one(x, claim_rules.basis_in_text) for x in ("Pressure, Kg/cm2 A", "bar(g)", "psi gauge", "kg/cm2")] == ["absolute", "gauge", "gauge", ""]
    name = lambda x, c=None: one(x, lambda t: claim_rules.predicate(t, F.lit(c) if c else None)["predicate"])
    assert [name("Pressure"), name("Design temp"), name("Pressure", "minimum"), name("Pressure drop"), name("RVP"), name("Sp. Gr"), name("Colour"), name("x")] == [
        "operating_pressure", "design_temperature", "minimum_pressure", "generic_property", "generic_property", "specific_gravity", "generic_property", None]


def test_plausible_values_and_types(spark):
    rows = [("specific_gravity", "10.56", "", False), ("specific_gravity", "0.85", "", True), ("yield", "120", "%", False), ("yield", "120", "t", True), ("flash_point", "Nil", "", True), ("speed", "9999", "", True)]
    out = spark.createDataFrame(rows, "p string, v string, u string, want boolean").select("want", claim_rules.plausible("p", "v", "u").alias("got")).collect()
    assert all(r.want == r.got for r in out)
    kinds = spark.createDataFrame([("11-P-01", ""), ("PIC-1105", ""), ("11-ZZ-1", ""), (None, "crude feed pump"), (None, "x")], "t string, n string").select(entities.infer_type("t", "n").alias("k")).collect()
    assert [r.k for r in kinds] == ["Pump", "Controller", "Equipment", "Pump", None]


def test_named_entities_merge_into_tagged_ones(spark):
    known = spark.createDataFrame([
        ("t1", "C-01", "11-C-01", "Column", 9), ("t2", "PM-01", "11-PM-01", "Pump", 9), ("t3", "PM-02", "11-PM-02", "Pump", 2), ("t4", "E-1", "11-E-01", "Exchanger", 1),
        ("n1", "Atmospheric Column", None, "Column", 57), ("n2", "reflux pumps", None, "Pump", 1), ("n3", "feed pump", None, "Pump", 1), ("n4", "trim cooler", None, "Pump", 1), ("n5", "other", None, None, 1)],
        "uid string, name string, canonical_tag string, entity_type string, mention_count int")
    alias = spark.createDataFrame([("t1", "atmospheric column"), ("t2", "reflux pump"), ("t3", "Reflux Pump"), ("t2", "crude feed pump"), ("t4", "product trim cooler")], "uid string, alias string")
    out = {r.uid: (r.target_uid, r.how) for r in entities.merge_named(known, alias).collect()}
    assert out == {"n1": ("t1", "name"), "n2": ("t2", "name"), "n3": ("t2", "tail")}  # n4: another class of equipment
    moved = entities.redirect(spark.createDataFrame([("n1", 1), ("t3", 2)], "uid string, k int"), entities.merge_named(known, alias))
    assert sorted(map(tuple, moved.collect())) == [("t1", 1), ("t3", 2)]
    told = entities.resolve_subjects(spark.createDataFrame([("11 C 01", "d"), ("Reflux pump", "d"), ("99-Z-7", "d"), ("New drum", "d")], "subject string, document_id string"), known, alias).collect()
    assert {r.subject: (r.subject_uid if r.resolved in ("tag", "alias") else None, r.resolved) for r in told} == {"11 C 01": ("t1", "tag"), "Reflux pump": ("t2", "alias"), "99-Z-7": (None, "new tag"), "New drum": (None, "new name")}


def test_relations_that_texts_imply(spark):
    said = ["11-FIC-1105 holds the flow to 11-E-01.", "12-TI-9 and 11-E-01 stand here.", "PI-7 " + "x " * 120 + "11-E-01.", "11-E-01 and 11-P-01."]
    out = entities.co_mentions(spark.createDataFrame([("k", s) for s in said + said[:1]], "chunk_id string, sentence string"))
    assert [tuple(r)[:3] for r in out.collect()] == [("11-FIC-1105", "11-E-01", "CONTROLS")]
    known = spark.createDataFrame([("i", "LI-2201", "Instrument", "12-C-01 bottom level"), ("j", "FIC-3", "Controller", "flow of the crude feed pumps"), ("c", "12-C-01", "Column", None), ("p", "11-P-01", "Pump", None)], "uid string, canonical_tag string, entity_type string, description string")
    out = entities.description_relations(known, spark.createDataFrame([("p", "Crude feed pump")], "uid string, alias string"))
    assert {tuple(r)[:3] for r in out.collect()} == {("i", "c", "MONITORS"), ("j", "p", "CONTROLS")}
    rules = spark.createDataFrame([("motor", "FEEDS", "ERROR"), ("Product", "FEEDS", "WARNING"), ("pump", "FEEDS", "OK"), (None, "FEEDS", "OK")], "subject_type string, rel_type string, want string")
    assert all(r.want == r.verdict for r in entities.relation_rules(rules).collect())


def test_upserted_entities(spark):
    rows = [("u", 2, "Pump A", ["b", ""], "Pump", "d2", 0.9, "later"), ("u", 1, "Pump", ["a"], "unknown", "d1", 0.5, ""), ("u", 3, "Pump", None, "Drum", "d1", 0.7, "x")]
    r = entities.upsert_entities(spark.createDataFrame(rows, "uid string, seq int, name string, aliases array<string>, entity_type string, document_id string, confidence double, evidence string")).first()
    assert (r.name, r.aliases, r.entity_type, r.document_ids, r.confidence, r.evidence, r.mention_count) == ("Pump", ["Pump A", "a", "b"], "Pump", ["d1", "d2"], 0.9, "later", 3)


def test_parse_checks(spark):
    rows = [("d", p, k, "text", c) for k, (p, c) in enumerate([(1, "a"), (2, ""), (6, "[Figure 3]"), (5, "b"), (12, "c")])] + [("d", 1, 0, "text", "again")]
    out = checks.parse_checks(spark.createDataFrame(rows, "document_id string, page int, reading_order int, element_type string, content string"), spark.createDataFrame([("d", 10), ("empty", 3)], "document_id string, total_pages int"))
    got = {(r.document_id, r.check): (r.n, r.ok) for r in out.collect()}
    assert got["d", "coverage"] == (3, False) and got["d", "empty_run"] == (4, False) and got["d", "order_unique"] == (1, False) and got["d", "order_monotonic"] == (1, False)
    assert got["d", "outside"] == (1, False) and got["d", "placeholder"] == (1, False) and got["empty", "coverage"] == (0, False) and got["empty", "outside"] == (0, True) and len(got) == 12


def test_answers_are_held_against_their_evidence(spark):
    evidence = spark.createDataFrame([("e1", "The normal flow is 1,200.0 kg/h, page 14."), ("e2", "Design 6.5")], "evidence_key string, text string")
    said = [("a", 1, "Flow is 1200 (p. 99, step 7)", ["e1"]), ("a", 2, "Flow is 1300", ["e1"]), ("a", 3, "Design 6.50 and 1200", ["e1", "e2"]), ("a", 4, "Nothing cited", []), ("b", 5, "No figures", ["e2"]), ("b", 6, "x", ["missing"])]
    out = {r.answer_id: (r.checked, r.held) for r in checks.verify_answers(spark.createDataFrame(said, "answer_id string, statement_id int, text string, evidence_keys array<string>"), evidence).collect()}
    assert out == {"a": (4, 2), "b": (2, 1)}


def test_tables(spark):
    kinds = [("text", "WARNING: hot", "warning"), ("heading", "Title", "heading"), ("text", "N.B. see", "note"), ("odd", "x", "paragraph"), (None, None, "paragraph"), ("figure", "", "figure_caption")]
    assert all(r.want == r.got for r in spark.createDataFrame(kinds, "e string, c string, want string").select("want", tables.content_type("e", "c").alias("got")).collect())
    labels = [("Product Quality of the Unit", True), ("opens the valve slowly", False), ("LP Steam Header", True), ("", False), ("Aa " * 19, False)]
    assert all(r.want == r.got for r in spark.createDataFrame(labels, "c string, want boolean").select("want", tables.is_label("c").alias("got")).collect())
    shaped = spark.createDataFrame([("a", 1, ["Tag", " Name "], 3, 2), ("b", 2, ["name", "TAG"], 3, 2), ("c", 3, ["name", "TAG"], 4, 2)], "table_id string, ord int, headers array<string>, num_rows int, num_cols int")
    assert {r.table_id: (r.signature, r.duplicate_of) for r in tables.signatures(shaped).collect()} == {"a": ("name|tag", None), "b": ("name|tag", "a"), "c": ("name|tag", None)}
    cells = spark.createDataFrame([("t", r, c, v) for r, row in enumerate([["11-P-01", "5", "x"], ["11-P-02", "7.5", "11-P-01"], ["11-P-01", "5", "x"], ["", "5", "x"]]) for c, v in enumerate(row)], "table_id string, row int, col int, content string")
    assert {r.col: r.data_type for r in tables.column_types(cells).collect()} == {0: "tag", 1: "numeric", 2: "text"}
    assert sorted({r.row for r in tables.drop_repeated_rows(cells).collect()}) == [0, 1, 3]


def test_sections_and_chapters(spark):
    heads = spark.createDataFrame([("d", 1, 1, 1), ("d", 2, 2, 3), ("d", 3, 2, 3), ("d", 4, 1, 9)], "document_id string, ord int, level int, page int")
    assert {r.ord: r.page_end for r in tables.section_ends(heads, 20).collect()} == {1: 8, 2: 3, 3: 8, 4: 20}
    rows = spark.createDataFrame([("d", 1, "Intro ..... 3", 3), ("d", 2, "Next", 10), ("d", 1, "Intro", 4)], "document_id string, number int, title string, page int")
    assert {r.number: (r.title, r.page_start, r.page_end) for r in tables.contents(rows).collect()} == {1: ("Intro", 3, 9), 2: ("Next", 10, 9999)}
    pages = spark.createDataFrame([("d", 5), ("d", 100), ("d", 2000)], "document_id string, page int")
    spans = spark.createDataFrame([("d", 1, 1, 150, 2), ("d", 2, 90, 110, 1), ("e", 3, 1, 9999, 0)], "document_id string, chapter int, first_page int, last_page int, priority int")
    assert {r.page: r.chapter for r in tables.chapter_pages(pages, spans).collect()} == {5: 1, 100: 2}


def test_joins(spark):
    passages = spark.createDataFrame([(1, "one two three four five six seven"), (2, "short one"), (3, None)], "item_id int, text string")
    texts = spark.createDataFrame([(1, "x ONE two\nthree  four five six seven y"), (2, "a short one here"), (3, None), (4, "two three four five six")], "k int, t string")
    assert {tuple(r) for r in joins.contained(passages, texts, "k", "t").collect()} == {(1, 1), (2, 2)}
    events = spark.createDataFrame([(1, 1, "e", 1), (1, 2, "p", 2), (1, 3, "p", 3), (2, 1, "p", 4)], "u int, ts int, kind string, id int")
    out = joins.as_of(events, "u", ["ts"], F.col("kind") == "p", F.col("kind") == "e", "id", "last")
    assert {r.id: r.last for r in out.collect()} == {2: 1, 3: 1, 4: None}
    names = spark.createDataFrame([(1, "Feed Pumps"), (2, "feed pump"), (3, "x"), (4, "Feed pump")], "uid int, name string")
    assert {tuple(r) for r in joins.same_names(names).collect()} == {(1, 2), (1, 4), (2, 4)} and {tuple(r) for r in joins.same_names(names, 1).collect()} == {(1, 2), (2, 4)}


def test_conversion_as_a_projection_equals_the_expression(spark):
    rows = [(10.0, "kg/cm2a", ""), (14.0, "bar", "gauge"), (212.0, "°F", ""), (5.0, "m3/hr", ""), (3.0, "", ""), (None, "bar", None), (2.0, "MPa", "absolute")]
    frame = spark.createDataFrame(rows, "v double, u string, b string")
    for to in ("kg/cm2g", "bar", "°C", "m3/h", "kg/h", "psi"):
        both = units.with_converted(frame, "v", "u", to, "got", "b").withColumn("want", units.convert(F.col("v"), "u", F.lit(to), F.col("b"))).collect()
        assert all((r.got is None) == (r.want is None) and (r.got is None or abs(r.got - r.want) < 1e-9) for r in both), to


def test_conflicts_resolved(spark):
    base = dict(predicate="flow_rate", parameter_role="normal", location="", operating_mode="", scenario="", pressure_basis="", qualifier="", revision="Rev 1", source="table", confidence=0.9, page=1)
    rows = [dict(base, claim_id=c, subject=s, numeric_value=v, value=str(v), temporal_status=t, document_id="d") for c, s, v, t in (("1", "a", 482.0, "current"), ("2", "a", 470.0, "historical"), ("3", "b", 5.0, ""), ("4", "b", 5.0, ""), ("5", "c", 1.0, ""), ("6", "c", 2.0, ""))]
    out = claims.resolve_conflicts(spark.createDataFrame(rows), spark.createDataFrame([("d", 50)], "document_id string, authority_rank int"))
    assert {r.subject: (r.status, r.preferred if r.subject == "a" else None) for r in out.collect()} == {"a": ("resolved", "482.0"), "b": ("corroborated", None), "c": ("unresolved", None)}


def test_small_functions(spark, one):
    assert [one(x, phrases.ip_class) for x in ("127.0.0.1", "172.16.0.1", "172.32.0.1", "0.0.0.0", "256.1.1.1", "host", None)] == ["loopback", "private", "external", "unspecified", "invalid", "invalid", "invalid"]
    assert one("it is 482", phrases.real_reference) is None and one("see IS 482", phrases.real_reference) == "IS 482" and one("Intro ...... 12", phrases.contents_title) == "Intro"
    models = spark.createDataFrame([("chat", "a", 0.5), ("chat", "b", 0.52), ("code", "a", 0.1), ("code", "b", 0.9)], "kind string, model string, score double")
    held = spark.createDataFrame([("chat", "a"), ("code", "a")], "kind string, resident string")
    assert {r.kind: r.model for r in retrieval.route(models, held, "kind", 0.08).collect()} == {"chat": "a", "code": "b"}
    assert [r.x for r in spark.range(1).select(security.grant_reason(F.lit(False), F.lit(None).cast("boolean"), F.lit(True), F.lit(False), F.lit(False)).alias("x")).collect()] == ["spent"]
    same = spark.range(1).select((security.scope_hash(F.array(F.lit("b"), F.lit("a"), F.lit("b"))) == security.scope_hash(F.array(F.lit("a"), F.lit("b")))).alias("s"))
    assert same.first().s


def test_section_ends_in_one_pass(spark):
    heads = spark.range(40_000).selectExpr("'d' AS document_id", "id AS ord", "CAST(1 + id % 4 AS INT) AS level", "id AS page")
    out = tables.section_ends(heads, 99_999)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()  # such a frame is read anew for every row
    ends = {r.ord: r.page_end for r in out.where("ord < 4 or ord > 39995").collect()}
    assert ends == {0: 3, 1: 3, 2: 3, 3: 3, 39_996: 99_999, 39_997: 99_999, 39_998: 99_999, 39_999: 99_999}


def test_long_chapters_are_not_listed_by_page(spark):
    pages = spark.createDataFrame([("d", 5), ("d", 2**37), ("d", 2**36), ("e", 7), (None, 7)], "document_id string, page long")
    spans = spark.createDataFrame([("d", 1, 0, 2**37, 2), ("d", 2, 2**36, 2**36, 1), ("d", 3, 2**36 - 9, 2**36 + 9, 1), ("d", 4, 9, 5, 0), ("e", 5, 1, 9, None), ("e", 6, 1, 9, 0)], "document_id string, chapter int, first_page long, last_page long, priority int")
    assert sorted(tuple(r) for r in tables.chapter_pages(pages.union(pages), spans).collect()) == [("d", 5, 1), ("d", 2**36, 2), ("d", 2**37, 1), ("e", 7, 5)]
