"""Elements, tables and tag matching on small examples."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import elements, tagmatch


def test_imperatives_and_labels(spark):
    cases = {"1) Open the valve": True, "Slowly open it": True, "- Then the valve": False, "The pump": False, "": False, "a. never run dry": True}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", elements.is_imperative("x").alias("r")).collect()
    assert {r.x: r.r for r in rows} == cases
    labels = {"Pump change over procedure: (motor to turbine)": True, "Startup sequence": True, "A | B:": False, "Column overhead": False}
    assert {r.x: r.r for r in spark.createDataFrame([(k,) for k in labels], "x string").select("x", elements.is_procedure_label("x").alias("r")).collect()} == labels
    levels = {"3.2.1 Title": 3, "CHAPTER 5": 1, "Operating conditions": 2, "1.2.3.4.5.6.7.8 x": 6}
    assert {r.x: r.r for r in spark.createDataFrame([(k,) for k in levels], "x string").select("x", elements.heading_level("x").alias("r")).collect()} == levels


def test_element_decisions(spark):
    rows = [("d", p, "text", "Plant manual copy", "body", None) for p in range(1, 6)] + [("d", p, "heading", "CRUDE UNIT", "body", None) for p in range(1, 6)]
    rows += [("d", 1, "figure", "[Figure 3]", "body", None), ("d", 1, "text", "ab", "body", None), ("d", 2, "page_footer", "Page 2 of 9", "body", None), ("d", 2, "text", "Rev No: 4", "body", None), ("d", 2, "text", "Approved by Checked by", "body", None), ("d", 3, "text", "Open the suction valve.", "body", None)]
    frame = spark.createDataFrame(rows, "document_id string, page int, element_type string, content string, content_layer string, table_id string")
    got = elements.classify_elements(frame, ["rev no"], elements.repeated_hashes(frame.where("element_type <> 'heading'")), elements.running_titles(frame))
    by = {r.content: r.decision for r in got.collect()}
    assert by == {"Plant manual copy": "repeated_header", "CRUDE UNIT": "running_title", "[Figure 3]": "figure_placeholder", "ab": "empty", "Page 2 of 9": "repeated_footer", "Rev No: 4": "boilerplate", "Approved by Checked by": "approval_block", "Open the suction valve.": "keep"}


def test_tables(spark):
    rows = [("a", "Abbreviation, Meaning", "CDU crude unit", 9, 2, False, "abbreviation"), ("b", "Tag, Service", "11-P-01 11-P-02 11-E-01", 4, 2, False, "equipment"), ("c", "Stream", "one 5 kg/h", 4, 2, False, "material_balance"),
            ("d", "Limits", "11-P-01 5 bar", 4, 2, False, "unknown"), ("e", "Limits", "5 bar", 4, 2, False, "operating_limit"), ("f", "", "x", 1, 1, False, "decorative"), ("g", "Stream", "1 bar", 3, 2, True, "header")]
    out = elements.classify_tables(spark.createDataFrame([r[:6] for r in rows], "table_id string, header string, content string, num_rows int, num_cols int, is_repeated boolean"))
    assert {r.table_id: r.classification for r in out.collect()} == {r[0]: r[6] for r in rows}
    cells = [("d", f"t{p}", p, 0, f"Plant name: CDU page {p}") for p in range(1, 6)] + [("d", f"u{p}", p, 0, f"value {chr(96 + p)} of its own") for p in range(1, 6)]
    frame = spark.createDataFrame(cells, "document_id string, table_id string, page int, row int, content string")
    got = elements.template_tables(frame, spark.createDataFrame([("d", 5)], "document_id string, pages int"))
    assert {r.table_id for r in got.collect()} == {f"t{p}" for p in range(1, 6)}


def test_references_and_glossary(spark):
    rows = [("d", 1, 1, "s", "text", "The checklist is given in Chapter 34; refer to Section 4.2. Chapter 9 of 12. IS 4576 and ASTM D-86; the CDU (Crude Distillation Unit)."), ("d", 2, 2, "s", "text", "See Chapter 34 and IS 4576, ESD (Emergency Shut Down).")]
    frame = spark.createDataFrame(rows, "document_id string, reading_order int, page int, section_path string, element_type string, content string")
    assert {(r.kind, r.number, r.page) for r in elements.cross_references(frame).collect()} == {("chapter", "34", 1), ("section", "4.2", 1), ("chapter", "34", 2)}
    assert {(r.number, r.n) for r in elements.standards(frame).collect()} == {("IS 4576", 2), ("ASTM D-86", 1)}
    entries = spark.createDataFrame([("d", "cdu", "crude unit")], "document_id string, term string, meaning string")
    assert {(r.term, r.meaning, r.source) for r in elements.glossary(entries, frame).collect()} == {("cdu", "crude unit", "table"), ("ESD", "Emergency Shut Down", "inline")}


def test_a_longer_number_names_no_standard(spark):
    said = ["as per IS 451000", "as per IS 45100", "IS 45100-2009 and IS 451001-2009", "API 123456; ASTM D-123456", "API 610"]
    frame = spark.createDataFrame([("d", i, s) for i, s in enumerate(said)], "document_id string, reading_order int, content string")
    assert {(r.number, r.first_at, r.n) for r in elements.standards(frame).collect()} == {("IS 45100", 1, 1), ("IS 45100-2009", 2, 1), ("API 610", 4, 1)}


@pytest.mark.parametrize("mention,expect,best,adopted", [("12-3-01", "Pump", "12-P-01", None), ("12-3-01", "Exchanger", "12-E-01", None), ("11-E-1", None, "11-E-01", True), ("8.0 to 9.0", None, None, None)])
def test_tag_suggestions(spark, mention, expect, best, adopted):
    entities = spark.createDataFrame([("12-P-01", "Pump", 40), ("12-PM-01", "Pump", 2), ("12-E-01", "Exchanger", 9), ("11-E-01", "Exchanger", 5), ("11-E-02", "Exchanger", 5), ("11-P-01A", "Pump", 3)], "canonical_tag string, entity_type string, mention_count int")
    asked = spark.createDataFrame([(1, mention, expect)], "request_id int, mention string, expect_type string")
    got = tagmatch.suggest(asked, entities).orderBy("rank").collect()
    assert (got[0].canonical_tag if got else None) == best
    if best == "11-E-01":
        assert got[0].score == 1.0 or got[0].score >= 0.98
        assert got[0].adopted


def test_parts(spark):
    take = lambda x: spark.createDataFrame([(x,)], "x string").select(tagmatch.take_apart(F.col("x")).alias("r")).first().r
    assert tuple(take("pump 11P01 A/B")) == ("11", "P", "01", "A/B") and tuple(take("PIC-1105")) == ("", "PIC", "1105", "") and take("2 of 3") is None
