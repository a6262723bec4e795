"""Entity records, contexts of chunks, registers and document graphs, on small cases with known answers."""

from factloom.operators import index, registers


def test_records_take_the_most_voted_name_and_bounded_lists(spark):
    drafts = spark.createDataFrame([("a", "11-P-1", "x", "Pump"), ("b", "", "Own Name", None), ("c", None, None, None), ("d", "12-E-2", "y", "Exchanger")], "entity_uid string, canonical_tag string, name string, entity_type string")
    said = [("a", "LPG CHARGE PUMP", "P1", 4, 2), ("a", "lpg charge pump", "", None, 1), ("a", None, "P1", 4, 0), ("a", "", None, 3, 5), ("b", "Mixed case Lpg2 Lpg", "n", 1, None), ("zz", "nobody", "q", 1, 1)]
    said += [("d", f"name {i % 2}", f"alias {i:03d}", i, i) for i in range(300)]
    mentions = spark.createDataFrame(said, "entity_uid string, name string, alias string, page int, place long")
    out = {r.entity_uid: r for r in index.assemble_index(drafts, mentions).collect()}
    assert set(out) == {"a", "b", "c", "d"}
    assert out["a"].name == "LPG Charge Pump (11-P-1)" and out["a"].aliases == ["P1"] and out["a"].pages == [3, 4] and out["a"].mention_count == 4  # a tie of votes goes to the earlier place
    assert out["b"].name == "Mixed case Lpg2 LPG" and out["c"].name is None and out["c"].aliases == [] and out["c"].pages == [] and out["c"].mention_count == 0
    assert out["d"].name == "Name 0 (12-E-2)" and out["d"].aliases == [f"alias {i:03d}" for i in range(40)] and out["d"].pages == list(range(200))
    bare = index.assemble_index(drafts, mentions.limit(0)).collect()
    assert {r.entity_uid: r.name for r in bare} == {"a": "11-P-1", "b": "Own Name", "c": None, "d": "12-E-2"}


def test_facets_around_a_chunk(spark):
    chunks = spark.createDataFrame([(1, "P-101 feeds E101A; see P-101 and the Reflux drum", "S1"), (2, None, None), (3, "", ""), (1, "Again", "S9"), (4, "ab", "S2")], "chunk_id int, text string, section_path string")
    entities = spark.createDataFrame([("u1", "11-P-101", "p-101", "S1"), ("u2", "e101a", None, "S1"), ("u3", None, "x", None)], "entity_uid string, canonical_tag string, name string, section string")
    aliases = spark.createDataFrame([("u3", "P-101"), ("u3", ""), ("u1", None)], "entity_uid string, alias string")
    claims = spark.createDataFrame([(f"c{i:02d}", "u1", i % 3) for i in range(30)] + [("z", None, 1)], "claim_id string, entity_uid string, confidence int")
    relations = spark.createDataFrame([("u1", "FEEDS", "u2"), ("u1", "FEEDS", "u2"), ("u1", "SAME", "u1"), (None, "FEEDS", "u1")], "source_uid string, rel_type string, target_uid string")
    glossary = spark.createDataFrame([("reflux", "returned liquid", 2), ("REFLUX", "later", 3), ("ab", "two letters", 1), ("", "none", 0), ("drum!", "no", 4)], "term string, meaning string, place int")
    near = spark.createDataFrame([(1, 4, 1), (1, 3, 2)], "chunk_id int, near int, rank int")
    facets = index.context_facets(chunks, entities, aliases, claims, relations, glossary, near)
    out = {(r.chunk_id, r.facet, r.via): (r.n, r.items) for r in facets.collect()}
    assert out[1, "name", ""] == (2, ["P-101", "E101A"]) and out[1, "entity", "P-101"] == (2, ["u1", "u3"]) and (1, "entity", "E101A") not in out
    assert out[1, "identity", "E101A"] == (1, ["u2"]) and out[1, "claim", "u1"][0] == 30 and out[1, "claim", "u1"][1] == [f"c{i:02d}" for i in [*range(2, 30, 3), *range(1, 30, 3)]]
    assert out[1, "relation", "u1"] == (2, ["u1>FEEDS>u2", "u1>SAME>u1"]) and out[1, "related", "u1"] == (1, ["u2"]) and out[1, "section", "S1"] == (2, ["u1", "u2"]) and out[1, "glossary", "reflux"] == (1, ["returned liquid"])
    assert out[4, "glossary", "ab"] == (1, ["two letters"]) and out[1, "similar", ""] == (2, ["4", "3"]) and not [k for k in out if k[0] in (2, 3)]
    assert index.context_facets(chunks.limit(0), entities, aliases, claims, relations, glossary).count() == 0


def test_nearest_chunks_leave_out_the_chunk_itself(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.5, None])], "chunk_id int, embedding array<double>")
    out = [(r.chunk_id, r.near, r.rank) for r in index.nearest_chunks(rows, rows.where("chunk_id < 3"), 2).orderBy("chunk_id", "rank").collect()]
    assert out == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2)]


def test_register_columns_carry_over_tables_without_a_header(spark):
    rows = [
        ("d", 1, 0, ["x", "TITLE", "y"], 1), ("d", 2, 0, ["X/PROD/SI/9", "early", "z", "w"], 1),  # no register yet
        ("d", 3, 0, ["SN", "Standing Instruction No.", "Title", "Date", "Expired/Incorporated"], 2), ("d", 3, 1, ["1", "Mr / prod N / SI / 002", " Use   of pumps", "1.1.90", "Incorporated in Chapter-12"], 2),
        ("d", 3, 2, ["2", "no number", "t", "d", ""], 2), ("d", 4, 0, ["3", "MR/PROD/SI/3", "Second", None, "EXPIRED"], 3), ("d", 4, 1, ["4", "MR/PROD N/SI/002", "again", "", ""], 3),
        ("d", 5, 0, ["a", "b", "c"], 4), ("d", 5, 1, ["x", "MR/PROD/SI/7", "not a register", "", ""], 4), ("d", 6, 0, ["x", "MR/SI/8"], 5), ("d", 7, 0, ["MR/SI/10", "five", "six"], 5),
        ("e", 1, 0, ["1", "MR/PROD/SI/1", "other document", "", ""], 1), ("e", 2, 0, None, 1), ("e", 3, 0, [], 1),
    ]
    df = spark.createDataFrame(rows, "document_id string, place int, row int, cells array<string>, page int")
    out = {(r.document_id, r.number): (r.title, r.issue_date, r.status, r.chapter, r.page) for r in registers.standing_instructions(df).collect()}
    assert out == {("d", "MR/PRODN/SI/002"): ("Use of pumps", "1.1.90", "incorporated", "12", 2), ("d", "MR/PROD/SI/3"): ("Second", "", "expired", "", 3), ("d", "MR/SI/10"): ("six", "", "in_use", "", 5)}
    assert registers.standing_instructions(df.limit(0)).count() == 0


def test_profiles_take_headings_page_heads_and_tags(spark):
    elements = spark.createDataFrame([
        ("a", 1, 1, None, "x" * 1990), ("a", 1, 2, 2, "Section one"), ("a", 2, 3, 0, "an sop too late"), ("a", 3, 4, 0, "P-101 and P-101, V-12 A"), ("a", 31, 5, 0, "V-13"),
        ("b", 1, 1, 2, "Low"), ("b", 5, 2, 1, " Vendor Manual "), ("b", 6, 3, 1, "late"), ("b", 6, 4, 0, None), ("c", 9, 1, 1, "too late"),
    ], "document_id string, page int, reading_order int, heading_level int, content string")
    cells = spark.createDataFrame([("a", p, r, c, t) for p in range(3) for r, c, t in ((0, 0, "OPERATING  MANUAL"), (1, 0, "Plant No"), (1, 1, "Crude Unit"), (1, 2, None), (2, 0, "Page 3"), (2, 1, "other"))] + [("b", 1, 0, 0, "GUIDE")], "document_id string, place int, row int, col int, content string")
    out = {r.document_id: (r.title, r.document_type, r.unit) for r in registers.profile(elements, cells).collect()}
    assert out == {"a": ("Operating Manual", "unknown", "Crude Unit"), "b": ("Vendor Manual", "vendor_manual", None), "c": ("", "unknown", None)}
    assert [tuple(r) for r in registers.conventions(elements).collect()] == [("a", "P", 2, ["P-101"])]


def test_edges_need_both_ends(spark):
    documents = spark.createDataFrame([("d",)], "document_id string")
    chapters = spark.createDataFrame([("d", 1), ("d", 2), ("x", 1)], "document_id string, number int")
    sections = spark.createDataFrame([("d", "s1", "A", "1.1", 1, None, 1), ("d", "s2", "A", "1.2", 1, "s1", 2), ("d", "s3", "B", "1.2", 7, None, 3), ("d", "s4", "C", "", None, "gone", 4)], "document_id string, section_id string, path string, number string, chapter_number int, parent_section_id string, place int")
    procedures = spark.createDataFrame([("d", "p1", "s1"), ("d", "p2", None)], "document_id string, procedure_id string, section_id string")
    steps = spark.createDataFrame([("p1", 1), ("p1", 1203), ("p1", 1203)], "procedure_id string, sequence int")
    references = spark.createDataFrame([("d", "A", "section", "1.1"), ("d", "A", "section", "2.9"), ("d", "B", "chapter", "1.2"), ("d", "nowhere", "section", "1.1"), ("d", "A", "section", "1.2"), ("d", "B", "section", "8"), ("d", None, None, None)], "document_id string, source_path string, target_kind string, target_number string")
    instructions = spark.createDataFrame([("d", "M/SI/1", "2"), ("d", "M/SI/2", "9"), ("d", "M/SI/3", "")], "document_id string, number string, chapter string")
    edges = registers.document_edges(chapters, sections, procedures, steps, references, instructions)
    held = registers.held_edges(edges, registers.document_nodes(documents, chapters, sections, procedures, steps, instructions)).collect()
    assert {(r.source_id, r.edge, r.target_id) for r in held if r.held} == {
        ("d", "HAS_CHAPTER", "d#ch1"), ("d", "HAS_CHAPTER", "d#ch2"), ("d#ch1", "HAS_SECTION", "s1"), ("s1", "HAS_SUBSECTION", "s2"), ("d", "HAS_PROCEDURE", "p1"), ("d", "HAS_PROCEDURE", "p2"), ("p1", "IN_SECTION", "s1"),
        ("p1", "HAS_STEP", "p1#s001"), ("p1", "HAS_STEP", "p1#s1203"), ("p1#s001", "NEXT", "p1#s1203"), ("s2", "REFERENCES", "s1"), ("s2", "REFERENCES", "d#ch2"), ("s3", "REFERENCES", "d#ch1"),
        *(("d", "HAS_STANDING_INSTRUCTION", f"d#si:M/SI/{k}") for k in (1, 2, 3)), ("d#si:M/SI/1", "INCORPORATED_IN", "d#ch2"),
    }
    assert {(r.source_id, r.edge, r.target_id) for r in held if not r.held} == {("x", "HAS_CHAPTER", "x#ch1"), ("d#ch7", "HAS_SECTION", "s3"), ("gone", "HAS_SUBSECTION", "s4"), (None, "REFERENCES", "s1"), ("s2", "REFERENCES", "s2"), ("s3", "REFERENCES", "d#ch8"), (None, "REFERENCES", None), ("d#si:M/SI/2", "INCORPORATED_IN", "d#ch9")}


def test_lists_around_chunks_are_broadcast_only_if_few(spark, monkeypatch):
    chunks = spark.range(6).selectExpr("id AS chunk_id", "'P-12 and P-13' AS text", "'S' AS section_path")
    entities = spark.createDataFrame([("a", "p-12", "P-12", "S"), ("b", None, "P-13", None), ("c", None, "P-14", None)], "entity_uid string, canonical_tag string, name string, section string")
    aliases = spark.createDataFrame([("b", "p-12")], "entity_uid string, alias string")
    claims = spark.createDataFrame([("k1", "a", 1), ("k2", "a", 2), ("k3", "c", 1), ("k4", None, 1)], "claim_id string, entity_uid string, confidence int")
    relations = spark.createDataFrame([("a", "FEEDS", "b"), ("c", "FEEDS", "d")], "source_uid string, rel_type string, target_uid string")
    terms = spark.createDataFrame([(1, "and", "both")], "place long, term string, meaning string")
    rows = []
    for most in (index.BROADCAST_LISTS, 0):
        monkeypatch.setattr(index, "BROADCAST_LISTS", most)
        out = index.context_facets(chunks, entities, aliases, claims, relations, terms)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan, "strategy=merge" in plan) == ((True, False) if most else (True, True))  # terms are few in both
        rows.append(sorted((r.chunk_id, r.facet, r.via, r.n, ",".join(r["items"])) for r in out.collect()))
    assert rows[0] == rows[1] and [r[1:] for r in rows[0] if r[0] == 0 and r[1] in ("claim", "related")] == [("claim", "a", 2, "k2,k1"), ("related", "a", 1, "b"), ("related", "b", 1, "a")]
