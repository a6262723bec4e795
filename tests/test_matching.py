"""Similar sets, mentions and structural chunks, against plain loops."""

import random

import pytest

from factloom.functions import claim_rules
from factloom.operators import matching, requests, structure


@pytest.mark.parametrize("least,contained", [(0.5, None), (0.5, 2), (1 / 3, None), (0.8, 2), (1.0, None)])
def test_similar_sets_equal_all_pairs(spark, monkeypatch, least, contained):
    monkeypatch.setattr(matching, "TOKEN_ROWS", 3)  # frequent tokens are dealt over tasks
    rng = random.Random(5)
    words = [f"w{i}" for i in range(14)]
    sets = [(i, rng.sample(words[: rng.choice([4, 14])], rng.randrange(0, 4) if i % 2 else rng.randrange(0, 5))) for i in range(90)]
    df = spark.createDataFrame(sets, "id int, tokens array<string>")
    got = sorted((r.left_id, r.right_id, r.common, r.union) for r in matching.similar_sets(df, df, least, contained).collect())
    want = []
    for i, a in sets:
        for j, b in sets:
            common, union = len({*a} & {*b}), len({*a} | {*b})
            if common and (common >= union * least - 1e-9 or contained and len(a) >= contained and common == len(a)):
                want.append((i, j, common, union))
    assert got == sorted(want)


def test_classes_of_equal_sets_and_names(spark):
    rows = spark.createDataFrame([(3, ["b", "a"]), (1, ["a", "b", "a"]), (2, ["a"]), (5, []), (4, None)], "id int, tokens array<string>")
    assert {(r.id, r.class_id) for r in matching.set_classes(rows).collect()} == {(3, 1), (1, 1), (2, 2), (5, 4), (4, 4)}
    names = spark.createDataFrame([(1, "Crude Pumps"), (2, "crude pump"), (3, "Desalter"), (4, None), (2, "crude pump")], "k int, name string")
    assert {tuple(r) for r in matching.name_classes(names, "k", "name").collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 1)}
    aliases = spark.createDataFrame([("e1", "crude pump"), ("e2", "Crude Pumps"), ("e3", "drum")], "entity_uid string, alias string")
    assert {tuple(r) for r in matching.alias_classes(names, aliases).collect()} == {(1, "crude pump", "e1", 2), (2, "crude pump", "e1", 2)}


ENTITIES = [("e-11-PM-01", "11-PM-01", 40), ("e-11-C-01", "11-C-01", 60), ("e-11-V-02", "11-V-02", 10), ("e-twin", None, 300), ("e-12-PM-01", "12-PM-01", 1)]
ALIASES = [
    ("e-11-PM-01", "Crude Charge Pump"), ("e-11-PM-01", "11-PM-01"), ("e-11-PM-01", "11-PM-01A"), ("e-11-PM-01", "11-P-01"), ("e-11-C-01", "Atmospheric Distillation Column"), ("e-11-C-01", "11-C-01"),
    ("e-11-C-01", "atmos column"), ("e-11-V-02", "Desalter"), ("e-11-V-02", "11-V-02"), ("e-twin", "crude charge pump"), ("e-12-PM-01", "12-PM-01"), ("e-11-V-02", "D-2"), ("e-11-C-01", ""),
]


def test_mentions_go_through_the_tiers(spark):
    said = ["crude charge pump", "CRUDE CHARGE PUMPS", "Desalter", "11-PM-01A", "11-PM-01", "11 PM 01A", "PM-01", "", "atmos distillation column", "zzz unknown gadget", None, "the crude pump", "11-PM-01B", "V-2"]
    mentions = spark.createDataFrame(list(enumerate(said)), "request_id int, mention string")
    entities, aliases = spark.createDataFrame(ENTITIES, "entity_uid string, canonical_tag string, mention_count int"), spark.createDataFrame(ALIASES, "entity_uid string, alias string")
    out = {}
    for r in matching.resolve_mentions(mentions, aliases, entities).orderBy("request_id", "rank").collect():
        out.setdefault(r.request_id, []).append((r.entity_uid, r.tier, r.score))
    # The tag counts 0.02 and the mentions up to 0.02, so the twin of 300 mentions ties at 0.97 and the tagged one leads.
    assert out[0] == [("e-11-PM-01", "alias", 0.95), ("e-twin", "alias", 0.95)] and out[1] == out[0]
    assert out[2] == [("e-11-V-02", "alias", 0.95)] and out[3] == [("e-11-PM-01", "tag", 1.0)] and out[4][0] == ("e-11-PM-01", "tag", 1.0)
    assert out[5] == [("e-11-PM-01", "fuzzy", 0.9)]  # no tag without dashes, but the same words
    assert out[6] == [("e-11-PM-01", "suffix", 0.8), ("e-12-PM-01", "suffix", 0.8)]
    assert out[8][0][0] == "e-11-C-01" and out[8][0][1] == "fuzzy" and 9 not in out and 7 not in out and 10 not in out
    assert out[11] == [("e-11-PM-01", "fuzzy", round(0.5 + 0.4 * 2 / 3, 6)), ("e-twin", "fuzzy", round(0.5 + 0.4 * 2 / 3, 6))]
    assert out[12] == [("e-11-PM-01", "parent", 0.9)] and 13 not in out
    assert matching.resolve_mentions(mentions.limit(0), aliases, entities).count() == 0


def test_mentions_of_common_words_meet_kinds_of_names(spark, monkeypatch):
    compared, similar = [], matching.similar_sets
    monkeypatch.setattr(matching, "similar_sets", lambda *a, **k: compared.append(similar(*a, **k)) or compared[-1])
    tags = [(f"t{i:03d}", f"12-{'CE'[i % 2]}-{i:05d}", i * 7 % 50) for i in range(300)]
    names = [(f"n{i:03d}", f"{('red', 'old', 'hot')[i % 3]} valve unit {i % 90}" + " spare" * (i % 4 == 0), i % 11) for i in range(200)]
    said = [f"12 {'CE'[i % 2]} {i:05d}" for i in range(40)] + [f"12 C {i:05d}" for i in range(500, 540)] + ["valve unit", "the red valve of unit 17", "hot valve unit 3 room", "spare valve", "12 C"]
    entities = spark.createDataFrame([(u, t, n) for u, t, n in tags] + [(u, None, n) for u, _, n in names], "entity_uid string, canonical_tag string, mention_count int")
    aliases = spark.createDataFrame([(u, a) for u, a, _ in tags + names], "entity_uid string, alias string")
    out = {}
    for r in matching.resolve_mentions(spark.createDataFrame(list(enumerate(said)), "request_id int, mention string"), aliases, entities).orderBy("request_id", "rank").collect():
        out.setdefault(r.request_id, []).append((r.entity_uid, r.tier, r.score))
    for k, mention in enumerate(said):
        a, best = set(mention.lower().split()) - {"the", "of"}, []
        for (u, alias, n), extra in [(x, 0.02) for x in tags] + [(x, 0) for x in names]:
            b = set(alias.lower().replace("-", " ").split())
            if 2 * len(a & b) >= len(a | b) or len(a) >= 2 and a <= b:
                score = 0.5 + 0.4 * len(a & b) / len(a | b)
                best.append((-round(score + extra + n / 10000, 9), u, round(score, 6)))
        assert out.get(k, []) == [(u, "fuzzy", s) for _, u, s in sorted(best)[:5]], mention
    assert sum(p.count() for p in compared) < 80 * 20


def plain_chunks(rows, target=800, most=1200):
    """Chunks by lists: [(numbers of elements, heading, path)] of one document."""
    made, current, used, heading, path = [], [], 0, "", ""

    def emit():
        nonlocal current, used
        if current:
            made.append(([r["ord"] for r in current], heading, path))
            current, used = [], 0

    for i, r in enumerate(rows):
        n, ends = r["tokens"] or 0, False
        body = any(not e["is_heading"] for e in current)
        if r["is_heading"] and body and ((r["level"] or 2) <= 2 or used >= target / 2):
            ends = True
        begins = r["procedure"] is not None and (r["step"] == 0 or r["step"] == 1 and not (i and rows[i - 1]["procedure"] == r["procedure"]))
        if begins and current and used >= target / 4:
            ends = True
            if current[-1]["is_heading"] and len(current) > 1:
                moved = current.pop()
                used -= moved["tokens"]
                emit()
                current, used, ends = [moved], moved["tokens"], False
        if used + n > most and current:
            last = current[-1]
            whole = last["table"] and last["table"] == r["table"] or last["procedure"] and last["procedure"] == r["procedure"]
            if not whole or used + n > 2 * most:
                ends = True
        if ends:
            emit()
        if r["is_heading"]:
            heading, path = r["title"], r["path"]
        elif not current:
            path, heading = r["path"], r["parent_heading"] or heading
        current.append(r)
        used += n
    emit()
    return made


SCHEMA = "doc int, ord int, is_heading boolean, level int, procedure string, step int, table string, title string, path string, parent_heading string, tokens long, page int"


def elements(seed, doc, n):
    rng = random.Random(seed)
    rows, kind, left = [], None, 0
    for i in range(n):
        if left == 0:
            kind, left, name, step = rng.choice(["heading", "text", "table", "procedure", "procedure"]), rng.randrange(1, 9), f"{seed}_{i}", rng.choice([0, 1])
            left = rng.choice([1, 1, 2]) if kind == "heading" else left
        heading = kind == "heading" or kind == "procedure" and rng.random() < 0.05
        rows.append({"doc": doc, "ord": i, "is_heading": heading, "level": rng.choice([None, 1, 2, 3, 3, 4, 4]), "procedure": f"p{name}" if kind == "procedure" else None, "step": step if kind == "procedure" else None,
                     "table": f"t{name}" if kind == "table" and not heading else None, "title": f"T{i}", "path": f"S{i}", "parent_heading": rng.choice([None, f"H{i}"]), "tokens": rng.choice([5, 60, 150, 400, 900, 0]) if not heading else rng.choice([4, 9, 250]), "page": i // 7})
        step, left = step + 1, left - 1
    return rows


def test_structure_chunks_equal_a_plain_walk(spark):
    rows = [r for seed in range(12) for r in elements(seed, seed, 150)]
    rows += [{**elements(1, 50, 1)[0], "is_heading": True}, *({**r, "doc": None} for r in elements(3, 0, 20))]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], SCHEMA)
    placed = structure.chunk_elements(df, "doc", "ord")
    got = {}
    for r in placed.orderBy("ord").collect():
        got.setdefault((r.doc, r.chunk), []).append(r.ord)
    told = {(r.doc, r.chunk): (r.heading, r.path, r.n_elements) for r in structure.chunks(placed, "doc", "ord", "page").collect()}
    for doc in {r["doc"] for r in rows}:
        want = plain_chunks([r for r in rows if r["doc"] == doc])
        assert [got[doc, k] for k in range(len(want))] == [w[0] for w in want]
        assert [told[doc, k] for k in range(len(want))] == [(h, p, len(o)) for o, h, p in want]
    assert any(r.moved for r in placed.collect())
    assert structure.chunk_elements(df.limit(0), "doc", "ord").count() == 0


def test_chapters_and_small_documents(spark):
    text = lambda d, rows: [(d, i, h, 1 if h else None, None, None, None, t, "", None, n, 1) for i, (t, h, n) in enumerate(rows)]
    df = spark.createDataFrame(text(1, [("Chapter 1", True, 4), ("one", False, 260), ("Chapter 2", True, 4), ("two", False, 260)]) + text(2, [("Short heading", True, 3), ("Short", False, 3)]), SCHEMA)
    assert [(r.doc, r.chunk, r.heading) for r in structure.chunks(structure.chunk_elements(df, "doc", "ord"), "doc", "ord").orderBy("doc", "chunk").collect()] == [(1, 0, "Chapter 1"), (1, 1, "Chapter 2"), (2, 0, "Short heading")]


@pytest.mark.parametrize("said,basis", [("Vacuum 10 mm Hg g", ""), ("20 mm Hg abs", "absolute"), ("Pressure, Kg/cm2 A", "absolute"), ("kg/cm2 (g)", "gauge"), ("bar(a)", "absolute"), ("psi g", "gauge"), ("psig", "gauge"), ("bar", ""), (None, "")])
def test_pressure_basis(spark, said, basis):
    assert spark.createDataFrame([(said,)], "h string").select(claim_rules.basis_in_text("h")).first()[0] == basis


def test_questions_about_a_document_and_what_a_request_says(spark):
    asked = ["what is in the attached pdf?", "what is this file about", "What equipment does this catalogue cover?", "tell me about this document", "the contents of this catalogue", "what is the design pressure in the CDU operating manual"]
    out = requests.classify_tasks(spark.createDataFrame(list(enumerate(asked)), "i int, text string")).orderBy("i").collect()
    assert [r.task for r in out] == ["inventory"] * 5 + ["lookup"]
    said = [
        "The crude charge pump discharge pressure is dropping. What should I check?", "The atmospheric column pressure is increasing. What could be causing it?", "The crude desalter is showing poor performance. What causes are documented?",
        "what is the vacuum in the column?", "what is the vacuum heater for?", "the duty of the heater", "The crude charge pump is operating at 520 m3/h. Is this acceptable?", "can we run this at 500?", None,
    ]
    got = requests.resolve_requests(spark.createDataFrame(list(enumerate(said)), "i int, text string")).orderBy("i").collect()
    assert [r.symptom.direction if r.symptom else None for r in got] == ["low", "high", "poor", None, None, None, None, None, None]
    assert [r.parameter for r in got[3:6]] == ["vacuum", None, "duty"]
    assert [tuple(q) for q in got[6].quantities] == [(520.0, "m3/h", "flow_rate")] and [tuple(q) for q in got[7].quantities] == [(500.0, None, None)] and got[8].quantities == []
