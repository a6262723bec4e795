"""Extraction and phrase functions on small examples."""

from pyspark.sql import functions as F

from factloom.functions import phrases
from factloom.operators import extract


def claims_of(spark, rows, hint=""):
    frame = spark.createDataFrame([("t", hint, i, r) for i, r in enumerate(rows)], "table_id string, hint string, row int, cells array<string>")
    return {(c.subject, c.predicate, c.value, c.unit) for c in extract.table_claims(frame).collect()}


def test_conditions_across(spark):
    got = claims_of(spark, [["", "Minimum", "Normal", "Maximum", "Mech. Design"], ["Pressure (Kg/cm 2 )", "3.5", "4.0", "5.0", "6.5"], ["Temperature (°C)", "Saturated", "150", "170", "190"]], "LP Steam Header")
    assert {("LP Steam Header", f"{r}_pressure", v, "kg/cm2") for r, v in (("minimum", "3.5"), ("normal", "4.0"), ("maximum", "5.0"))} <= got
    assert not any(p == "minimum_temperature" for _, p, _, _ in got) and ("LP Steam Header", "maximum_temperature", "170", "°C") in got


def test_subjects_down(spark):
    got = claims_of(spark, [["Tag No", "Description", "Operating Temp PG/BH", "Operating Pressure PG/BH"], ["", "", "°C", "kg/cm2"], ["11-V-02", "Desalter", "129,136.5", "14.0"]])
    assert {("11-V-02", "operating_temperature", "129", "°C"), ("11-V-02", "operating_temperature", "136.5", "°C"), ("11-V-02", "operating_pressure", "14.0", "kg/cm2")} == got
    assert ("RCO", "cut_range", "380+", "") in {(s, p, v, "") for s, p, v, _ in claims_of(spark, [["Product", "TBP cut range °C", "Temperature °C", "Pressure, Kg/cm 2 A"], ["RCO", "380+", "343", "14.4"]])}


def test_subjects_across(spark):
    got = claims_of(spark, [["Crude", "Basrah", "Bombay high"], ["Kg/ hr", "367647", "367647"], ["Sp. Gravity @ 15 °C", "0.848", "0.8284"], ["H2S content", "Nil", "Nil"]])
    assert ("Basrah", "mass_flow_rate", "367647", "kg/h") in got and ("Bombay high", "specific_gravity", "0.8284", "") in got and not any(v == "Nil" for *_, v, _ in got)


def test_properties_of_a_fluid_are_no_operating_pressure(spark):
    rows = [["Parameter", "Specifications"], ["Electric power requirement", "20 Kv"], ["Pressure drop across the mixed valve (kg/cm2)", "0.7 - 1.0"], ["Operating temperature °C", "120-130 ° C"], ["Operating pressure (kg/cm2)", "10.5"]]
    got = claims_of(spark, rows, "Desalter (11-V-02) Description")
    assert {("11-V-02", "operating_pressure", "10.5", "kg/cm2"), ("11-V-02", "operating_temperature", "120-130", "°C"), ("11-V-02", "generic_property", "0.7-1.0", "kg/cm2")} <= got
    assert not any(s == "Specifications" for s, *_ in got)
    frame = spark.createDataFrame([("t", "Desalter (11-V-02)", i, r) for i, r in enumerate(rows)], "table_id string, hint string, row int, cells array<string>")
    assert [c.qualifier for c in extract.table_claims(frame).where("predicate = 'generic_property'").collect()] == ["Pressure drop across the mixed valve"]


def test_a_list_of_properties_without_header(spark):
    got = claims_of(spark, [["pH", "6.5-8.0"], ["Pressure (Kg/cm 2 )at grade", "3.0"], ["Mech. Design Pressure (Kg/cm 2 )", "7.0"]], "3.5.4 Service water:")
    assert {("Service water", "operating_pressure", "3.0", "kg/cm2"), ("Service water", "design_pressure", "7.0", "kg/cm2"), ("Service water", "generic_property", "6.5-8.0", "")} == got


def test_spec_pairs_and_prose(spark):
    lines = ["Make: KSB", "Model:", "Speed:", "77", "2950", "text", "Power:", "text"]
    got = extract.spec_pairs(spark.createDataFrame([("d", i, c) for i, c in enumerate(lines)], "document_id string, reading_order int, content string"))
    assert {(r.label, r.value) for r in got.collect()} == {("Make", "KSB"), ("Model", "77"), ("Speed", "2950")}
    sentences = ["The pump 11-P-01 starts.", "The pump design pressure is 14.5 kg/cm2 and flow is about 482 m3/h.", "Normal temperature is 40 °C."]
    got = extract.prose_claims(spark.createDataFrame([("k", i, s) for i, s in enumerate(sentences)], "chunk_id string, pos int, sentence string"))
    assert {(r.subject, r.label, r.value, r.unit) for r in got.collect()} == {("11-P-01", "design pressure", "14.5", "kg/cm2"), ("11-P-01", "flow", "482", "m3/h")}


def test_rule_relations(spark):
    sentences = spark.createDataFrame([("k", "11-P-01 feeds 11-E-01."), ("k", "11-P-01 takes suction from crude tank"), ("k", "x-a is part of nowhere"), ("k", "11-P-01 and 11-E-01 stand here.")], "chunk_id string, sentence string")
    got = extract.rule_relations(sentences, spark.createDataFrame([("11-P-01",), ("11-E-01",)], "name string"))
    assert {(r.subject, r.rel_type, r.object, r.confidence) for r in got.collect()} == {("11-P-01", "FEEDS", "11-E-01", 0.75), ("11-P-01", "SUCTION_FROM", "crude tank", 0.6)}


def test_table_labels(spark):
    rows = [(1, "text", "Feed data:", None), (2, "text", "Product data", None), (3, "table", None, "t1"), (4, "table", None, "t2"), (5, "text", "Left over", None), (6, "heading", "Next", None), (7, "table", None, "t3")]
    got = extract.table_labels(spark.createDataFrame([("d", *r) for r in rows], "document_id string, reading_order int, element_type string, content string, table_id string"))
    assert {r.table_id: r.label for r in got.collect()} == {"t1": "Feed data", "t2": "Product data", "t3": ""}


def test_phrases(spark):
    one = lambda x, f, t="string": spark.createDataFrame([(x,)], f"x {t}").select(f(F.col("x")).alias("r")).first().r
    assert tuple(one("9.0 cst @ 20°C", phrases.split_value_unit)) == ("9.0", "cst", "@ 20°C") and tuple(one("1,200 kg/h (note)", phrases.split_value_unit)) == ("1,200", "kg/h", "")
    assert one("feeds the crude charge pump", lambda c: phrases.clean_alias_phrase(c, ["the", "feeds"])) == "crude charge pump"
    assert one("PIC-1105", phrases.describe_instrument) == "pressure indicator controller" and one("11-P-01", phrases.describe_instrument) is None
    assert one(["A", "a ", "", "b"], phrases.ordered_distinct, "array<string>") == "A / b"
    assert one("2 * (3 + 4) ** 2", phrases.evaluate) == 98.0 and one("__import__('os')", phrases.evaluate) is None and one("1/0", phrases.evaluate) is None
    assert one('```json\n{"a": [1, 2,], "b": {"c": "x', phrases.salvage_json) == '{"a": [1, 2], "b": {"c": "x"}}' and one("no object", phrases.salvage_json) is None
    assert one({"b": "2", "a": "1"}, phrases.canonical_json, "map<string, string>") == '{"a":"1","b":"2"}'
    assert one("discharge pressure of the pump", lambda c: phrases.supported(c, F.lit("The pump has a discharge  pressure of 5 bar"))) and not one("wholly other words", lambda c: phrases.supported(c, F.lit("nothing alike")))
    assert one("aaa " * 100 + "needle bbb", lambda c: phrases.excerpt(c, F.array(F.lit("needle")), 40)).find("needle") > 0
