"""Requests: tasks, turns that lean on others, what is named, severity; plans of work."""

import pytest

from factloom.operators import plans, requests

TASKS = [
    ("What is the normal flow rate of the crude charge pump?", "lookup"),
    ("Trace the crude flow from the crude charge pump to the atmospheric column.", "multi_hop"),
    ("How do I change over from the running crude charge pump to the standby pump?", "procedure"),
    ("The crude charge pump discharge pressure is dropping. What should I check?", "troubleshooting"),
    ("The crude charge pump is operating at 520 m3/h. Is this acceptable?", "limits"),
    ("Why is the crude heated before entering the atmospheric column?", "explanation"),
    ("What safety precautions are required before working on the crude charge pump?", "safety"),
    ("Compare the documented operating conditions for Basrah crude and Bombay High crude.", "comparison"),
    ("I found two different normal flow values for the crude charge pump. Which one should I trust?", "conflict"),
    ("Show me all documented values for the pump discharge pressure and their sources.", "provenance"),
    ("Prepare an engineering investigation plan for repeated trips of the vacuum heater.", "planning"),
    ("Prepare a report on the atmospheric column operating envelope.", "report"),
    ("Which documents describe the startup procedure for the atmospheric heater?", "cross_document"),
    ("How many pumps are there?", "inventory"),
]


def test_tasks(spark):
    asked = [t for t, _ in TASKS] + ["Tell me something.", "", None]
    out = requests.classify_tasks(spark.createDataFrame(list(enumerate(asked)), "i int, text string")).orderBy("i").collect()
    assert [r.task for r in out] == [t for _, t in TASKS] + ["lookup"] * 3
    assert all(0.4 <= r.confidence <= 0.98 for r in out[:14]) and [r.confidence for r in out[14:]] == [0.2] * 3
    assert requests.classify_tasks(spark.createDataFrame([], "i int, text string")).count() == 0


@pytest.fixture
def first(spark):
    def ask(*turns):
        rows = [(1, k, t) for k, t in enumerate(turns)]
        return requests.follow_ups(spark.createDataFrame(rows, "conv_id int, turn int, text string")).orderBy("turn").collect()

    return ask


def test_turns_that_lean_on_the_one_before(first):
    told = "what does pump 12-P-01 do?"
    for text in ("what if we use 11-E-01 instead", "what if we used 11-E-01 instead of that", "could we put 11-E-01 in place of it", "swap it for 11-E-01", "and 11-E-01 instead?"):
        got = first(told, text)[1]
        assert got.kind == "substitution" and got.subject == "12-P-01" and "Compare" in got.rewritten and "11-E-01" in got.rewritten
    assert first(told, "and at start-up?")[1].kind == "elaboration" and "during start-up" in first(told, "and at start-up?")[1].rewritten
    assert first(told, "why?")[1].kind == "elaboration" and first(told, "what is its discharge pressure?")[1].kind == "continuation"
    assert "12-P-01" in first(told, "is it safe?")[1].rewritten
    for text in ("What is the design pressure of the vacuum column 12-C-01?", "How do I start the crude charge pump after maintenance?"):
        assert first(told, text)[1].kind == "new"
    assert first("why?")[0].kind == "new" and first("hello there", "what if we use 11-E-01 instead")[1].kind == "new"  # nothing to take over


def test_what_a_request_names(spark):
    rows = ["bypass the interlock of 11-P-01", "discharge pressure of the pumps in the vacuum unit during start-up, Basrah", "hello", "tell me a joke", None]
    out = requests.resolve_requests(spark.createDataFrame(list(enumerate(rows)), "i int, text string")).withColumn("s", requests.scope("text")).orderBy("i").collect()
    assert out[0].restricted and out[0].tags == ["11-P-01"] and not out[1].restricted
    assert (out[1].parameter, out[1].location, out[1].action, out[1].scenario, out[1].mode, out[1].subject_type, out[1].scope) == ("pressure", "discharge", "startup", "Basrah", "startup", "Pump", "vacuum section")
    assert [r.s for r in out] == ["in_scope", "in_scope", "greeting", "out_of_scope", "in_scope"] and out[4].parameter is None
    one = spark.createDataFrame([("Never open it",), ("Isolate first",), ("Ensure gloves",), ("Turn left",)], "t string").select(requests.severity("t").alias("s")).collect()
    assert [r.s for r in one] == ["danger", "info", "caution", "info"]
    parts = spark.createDataFrame([("give the margin in excel and explain why",), ("x",)], "t string").select(requests.subtasks("t").alias("s")).collect()
    assert [r.s for r in parts] == [["calculation", "tool_agent", "summarization", "composition"], ["composition"]]


def test_procedures_and_prerequisites(spark):
    titles = [("Emergency shutdown", "", "emergency"), ("Pump", "4 > Change-over", "changeover"), ("x", "y", "procedure")]
    out = spark.createDataFrame(titles, "t string, p string, want string").select("want", requests.procedure_type("t", "p").alias("got")).collect()
    assert all(r.want == r.got for r in out)
    steps = [("p", 1, "Check the level"), ("p", 2, "Start"), ("p", 3, "Check the level"), ("p", 9, "Verify flow"), ("p", 10, "Confirm it is lined up before start")] + [("p", k, "go") for k in range(4, 9)]
    out = requests.prerequisites(spark.createDataFrame(steps, "procedure_id string, sequence int, text string"))
    assert sorted((r.sequence, r.text) for r in out.collect()) == [(1, "Check the level"), (10, "Confirm it is lined up before start")]


PLAN = "request_id int, task string, secondary array<string>, has_entity boolean, has_value boolean, has_mentions boolean, wants_report boolean"


def test_plans(spark):
    asked = [
        (1, "limits", None, True, True, False, False), (2, "poetry", [], False, False, None, None), (3, "limits", [], False, False, False, False), (4, "troubleshooting", ["procedure", "conflict", "cross_document", "provenance", "planning", "report"], False, False, False, False),
        (5, "lookup", ["procedure", "safety", "limits"], True, False, False, True), (6, "ambiguous", ["safety"], False, False, False, True), (7, "graph", ["limits"], False, False, True, False), (8, "comparison", ["troubleshooting"], False, False, False, False),
    ]
    steps = plans.plan_steps(spark.createDataFrame(asked, PLAN))
    out = {}
    for r in steps.orderBy("request_id", "place").collect():
        out.setdefault(r.request_id, []).append(r)
    names = {k: [r.step for r in v] for k, v in out.items()}
    assert names[1] == ["claims", "revision", "compare", "safety"] and names[3] == ["claims", "revision", "consequences"] and names[2] == ["lookup"]
    assert [r.place for r in out[4]] == list(range(1, 13)) and names[4][9:] == ["conf2", "refs2", "assemble2"]  # the report would be the thirteenth
    assert out[4][11].needs == ["actions", "topology", "procs", "safety", "conf2", "refs2"] and out[4][9].needs == ["identify"]
    assert {r.step for r in out[4] if r.optional} == {"normal", "topology", "procs", "conf2", "refs2", "assemble2"}
    assert names[5] == ["lookup", "conflicts", "procs2", "steps2", "safety2", "limits2", "report2"] and out[5][6].needs == names[5][:6] and out[5][3].needs == ["procs2"]
    assert names[6] == ["clarify"] and names[7] == ["lookup"] and names[8][3:] == ["upset2", "causes2"] and out[8][3].needs == ["revision"]
    assert all(set(r.needs) <= {x.step for x in v} for v in out.values() for r in v)
    assert plans.plan_steps(spark.createDataFrame([], PLAN)).count() == 0
    states = spark.createDataFrame([(1, "claims", "done"), (3, "claims", "failed")], "request_id int, step string, state string")
    assert {(r.request_id, r.step) for r in plans.ready(steps, states).collect() if r.request_id in (1, 3)} == {(1, "revision"), (1, "compare"), (3, "revision"), (3, "consequences")}


def test_a_failed_step_gets_a_fallback(spark):
    steps = plans.plan_steps(spark.createDataFrame([(1, "procedure", [], True, False, False, False), (2, "lookup", [], True, False, False, False)], PLAN))
    failed = spark.createDataFrame([(1, "find"), (2, "conflicts")], "request_id int, step string")  # the second is optional
    out = {(r.request_id, r.step): r for r in plans.replan(steps, failed).collect()}
    assert (out[1, "fb1"].agent, out[1, "fb1"].mode, out[1, "fb1"].place) == ("explanation", "support", 6) and (2, "fb1") not in out
    assert all(out[1, s].needs == ["fb1"] and out[1, s].optional for s in ("prereq", "steps", "refs")) and out[1, "safety"].needs == ["prereq", "steps"] and not out[1, "safety"].optional

def test_diagnosis(spark):
    text = "The low flow is caused by a choked strainer. Check the suction gauge of the pump. Short leak. The valve has to be opened very slowly. Check the suction gauge of the pump."
    out = requests.diagnosis(spark.createDataFrame([(1, text), (2, None)], "k int, t string"), "k", "t").collect()
    assert {(r.kind, r.rank) for r in out} == {("cause", 1), ("check", 1), ("action", 1)} and len(out) == 3
