"""Column functions against fixed examples."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import tags, text, units


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize("raw", ["11 V 02", "11-v-02", "11 – V – 02", "11_V_02", " 11-V-02. "])
def test_spellings_of_one_tag(spark, raw):
    assert one(spark, raw, tags.parse_tag).canonical == "11-V-02"


@pytest.mark.parametrize("raw,canonical,children,parent", [
    ("12-P-04 A/B", "12-P-04", ["12-P-04A", "12-P-04B"], None), ("10-P-01 A & B", "10-P-01", ["10-P-01A", "10-P-01B"], None),
    ("e 201 a", "E-201A", [], "E-201"), ("FCV 2001", "FCV-2001", [], None)])
def test_trains(spark, raw, canonical, children, parent):
    got = one(spark, raw, tags.parse_tag)
    assert (got.canonical, got.children, got.parent) == (canonical, children, parent)


@pytest.mark.parametrize("raw", ["Pump", "Page 8 of 562", "31-03-2012", "CDU-II", "ISO 9001", "H2S", "Rev 0", "", None])
def test_no_tags(spark, raw):
    assert one(spark, raw, tags.parse_tag) is None


def test_scanning_and_scope(spark):
    assert one(spark, "Start 11-P-01 A/B, then E-201; see ISO 9001 and 11-P-01.", tags.find_tags) == ["11-P-01", "E-201"]
    scoped = lambda c: tags.scoped(tags.parse_tag(c), F.lit("cdu (ii)"))
    assert one(spark, "P-101", scoped) == "CDU-II/P-101" and one(spark, "11-P-101", scoped) == "11-P-101"


@pytest.mark.parametrize("raw,value", [("24.45", 24.45), ("1,200 kg/h", 1200.0), ("7-9", 7.0), ("SS410", None), ("< 5", 5.0), (None, None)])
def test_leading_number(spark, raw, value):
    assert one(spark, raw, text.leading_number) == value


@pytest.mark.parametrize("raw,unit,basis", [("kg/cm2A", "kg/cm2", "absolute"), ("kg/cm2 g", "kg/cm2", "gauge"), ("barg", "barg", "gauge"), ("kg/cm2", "kg/cm2", ""), ("meters", "m", ""), ("m3/hr", "m3/h", "")])
def test_extracted_units(spark, raw, unit, basis):
    assert one(spark, raw, units.normalize_extracted) == unit and one(spark, raw, units.extracted_basis) == basis


@pytest.mark.parametrize("value,unit,to,expected", [
    (2.033, "kg/cm2a", "kg/cm2g", 1.0), (1.0, "bar", "kg/cm2", 1.01972), (100.0, "°C", "°F", 212.0), (0.0, "degC", "K", 273.15), (1.0, "t/h", "kg/hr", 1000.0), (60.0, "lpm", "m3/h", 3.6), (1.0, "bar", "°C", None)])
def test_conversion(spark, value, unit, to, expected):
    got = one(spark, unit, lambda c: units.convert(F.lit(value), c, F.lit(to)))
    assert got is None if expected is None else got == pytest.approx(expected)


def test_conversion_round_trip(spark):
    for a, b in (("bar", "psi"), ("°C", "°F"), ("m3/h", "gpm"), ("kg/s", "mtpa")):
        there = one(spark, a, lambda c, b=b: units.convert(F.lit(37.5), c, F.lit(b)))
        assert one(spark, b, lambda c, a=a, v=there: units.convert(F.lit(v), c, F.lit(a))) == pytest.approx(37.5)


def test_tokens_aliases_sentences(spark):
    assert one(spark, "The 11–P-01 pump's discharge, a B", text.tokenize) == ["11-p-01", "pump", "discharge"]
    assert one(spark, "Crude  Charge – Pumps!", text.norm_alias) == "crude charge-pump"
    assert one(spark, "glass", text.norm_alias) == "glass"
    for raw in ("Crude – Pumps", "a  b", "Class"):
        once = one(spark, raw, text.norm_alias)
        assert one(spark, once, text.norm_alias) == once or once.endswith("s")
    assert one(spark, "First one. Second (x); Third\nfourth", text.sentences) == ["First one.", "Second (x);", "Third", "fourth"]
    assert one(spark, "A b. C d! E f?", text.last_sentences) == "C d! E f?"
    assert one(spark, "one two three", text.token_estimate) == 3 and one(spark, None, text.token_estimate) == 0
    assert one(spark, "14 and 14.0 or 3", text.numbers) == [14.0, 3.0]
    assert one(spark, "10%", text.is_non_entity_name) and not one(spark, "Crude pump", text.is_non_entity_name)


def test_quantities(spark):
    got = one(spark, "keep 12,5 kg/cm2 g and 40 m3/hr at 60 rpm", units.find_quantities)
    assert [(q.value, q.unit, q.basis) for q in got] == [(12.5, "kg/cm2g", "gauge"), (40.0, "m3/h", None), (60.0, "rpm", None)]


def test_a_sentence_keeps_the_digits_of_its_place(spark):
    assert one(spark, "\n".join(f" {i} is no. {i} " for i in range(60)), text.sentences) == [f"{i} is no. {i}" for i in range(60)]
