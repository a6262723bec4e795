"""Answers held against their evidence."""

from factloom.operators import grounding


def test_figures_and_tags_beyond_the_brief(spark):
    rows = [(1, "It reads 1,250 and 482.0 m3/h at 11-pm-01, not 7.5 or 12-F-01.", "1250 at 11-PM-01; 482"), (2, None, "1"), (3, "5 at 11-C-01", None), (4, "", "")]
    out = {r.answer_id: (r.figures, r.tags) for r in grounding.unsupported(spark.createDataFrame(rows, "answer_id int, answer string, brief string")).collect()}
    assert out[1] == ([7.5, 12.0], ["12-F-01"])
    assert out[2] == ([], []) and out[3] == ([1.0, 5.0, 11.0], ["11-C-01"]) and out[4] == ([], [])


def test_names_that_the_documents_do_not_give(spark):
    entities = spark.createDataFrame([("p", "11-PM-01", "Crude charge pump", "Pump", 5), ("c", "11-C-01", "Atmospheric distillation column", "Column", 5), ("f", "12-F-01", "Vacuum heater", "Heater", 5)], "entity_uid string, canonical_tag string, name string, entity_type string, mention_count int")
    aliases = spark.createDataFrame([("p", "11-PM-01"), ("c", "11-C-01"), ("f", "12-F-01"), ("p", "crude feed pump")], "entity_uid string, alias string")
    said = [
        "The crude charge pump 11-PM-01 (boiler feed water tank) delivers 482 m3/h.", "the flow goes to the vacuum column (11-C-01) next", "the flow goes to the Atmospheric distillation column (11-C-01) next", "11-C-01 (normal) and 11-PM-01 (A/B)",
        "12-F-01 (atmospheric heater)", "99-Z-09 (ghost vessel)", None, "12-F-01 (crude tank) and 12-F-01 (water tank) and 12-F-01 (naphtha tank)", "11-PM-01A (crude feed pump)",
    ]
    rows = grounding.misnamed(spark.createDataFrame(list(enumerate(said)), "answer_id int, answer string"), aliases, entities).orderBy("answer_id", "place").collect()
    assert [(r.answer_id, r.tag, r.kind) for r in rows] == [(0, "11-PM-01", "name"), (1, "11-C-01", "qualifier"), (4, "12-F-01", "qualifier"), (7, "12-F-01", "name"), (7, "12-F-01", "name")]


def test_a_tag_of_several_means_the_one_that_the_answer_is_about(spark):
    entities = spark.createDataFrame([("a", "11-P-01", "Red valve", "Pump", 9), ("b", "11-P-01", "Crude tank", "Pump", 5), ("c", "11-P-02", "Hot drum", "Pump", 1)], "entity_uid string, canonical_tag string, name string, entity_type string, mention_count int")
    aliases = entities.selectExpr("entity_uid", "canonical_tag AS alias")
    said = [(1, "11-p-01 (crude tank)", "b"), (2, "11-P-01 (crude tank)", "a"), (3, "11-P-01 (crude tank)", None), (4, "11-P-01 (red valve)", "c"), (5, "11-P-01 (red valve)", "b"), (6, "11-P-02 (crude tank)", "b"), (7, "11-P-01 (red valve)", "none")]
    rows = grounding.misnamed(spark.createDataFrame(said, "answer_id int, answer string, entity string"), aliases, entities, about="entity").collect()
    assert sorted((r.answer_id, r.kind) for r in rows) == [(2, "name"), (3, "name"), (5, "name"), (6, "name")]
