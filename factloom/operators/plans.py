"""Plans of work for requests: templates by task, extended, pruned and cut in one projection; fallbacks; readiness by what a step needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settle

# The steps of each task, in order: name, agent, the steps that it needs, mode, and flags: o optional, s sensitive to
# safety, e only with an entity, v only with a value, n only without a value.
TEMPLATES = {
    "lookup": (("lookup", "lookup", (), "", ""), ("conflicts", "revision_conflict", ("lookup",), "check", "oe")),
    "multi_hop": (("graph", "graph", (), "", ""), ("support", "explanation", ("graph",), "support", "o")),
    "procedure": (
        ("find", "procedure", (), "find", ""), ("prereq", "procedure", ("find",), "prerequisites", ""), ("steps", "procedure", ("find",), "steps", ""),
        ("refs", "cross_document", ("find",), "for_procedure", "o"), ("safety", "safety", ("prereq", "steps"), "review_procedure", "s"),
    ),
    "troubleshooting": (
        ("identify", "lookup", (), "identify", ""), ("normal", "calculation", ("identify",), "range", "o"), ("upset", "diagnostic", ("identify",), "find_upset", ""), ("causes", "diagnostic", ("upset",), "causes", ""),
        ("checks", "diagnostic", ("causes",), "checks", ""), ("actions", "diagnostic", ("causes",), "actions", ""), ("topology", "graph", ("identify",), "neighbors", "o"), ("procs", "procedure", ("causes",), "find", "o"),
        ("safety", "safety", ("actions", "checks"), "review_actions", "s"),
    ),
    "limits": (
        ("claims", "lookup", (), "limits", ""), ("revision", "revision_conflict", ("claims",), "check", "o"), ("compare", "calculation", ("claims",), "check_value", "v"), ("safety", "safety", ("compare",), "review_limits", "sv"),
        ("consequences", "explanation", ("claims",), "consequences", "on"),
    ),
    "explanation": (("context", "explanation", (), "why", ""), ("topology", "graph", (), "neighbors", "o")),
    "safety": (("safety", "safety", (), "answer", "s"), ("procs", "procedure", ("safety",), "find", "o"), ("refs", "cross_document", ("safety",), "for_safety", "o")),
    "comparison": (("gather", "comparison", (), "gather", ""), ("diff", "comparison", ("gather",), "diff", ""), ("revision", "revision_conflict", ("gather",), "check", "o")),
    "conflict": (("claims", "revision_conflict", (), "collect", ""), ("resolve", "revision_conflict", ("claims",), "resolve", "")),
    "provenance": (("claims", "revision_conflict", (), "collect", ""), ("resolve", "revision_conflict", ("claims",), "resolve", "")),
    "planning": (
        ("scope", "lookup", (), "identify", ""), ("procs", "procedure", ("scope",), "find", ""), ("limits", "lookup", ("scope",), "limits", "o"), ("causes", "diagnostic", ("scope",), "causes", "o"), ("safety", "safety", ("scope",), "answer", "s"),
        ("gaps", "planner", ("procs", "limits", "causes", "safety"), "gaps", ""), ("plan", "planner", ("gaps",), "assemble", ""),
    ),
    "report": (
        ("scope", "lookup", (), "identify", ""), ("facts", "lookup", ("scope",), "limits", "o"), ("topology", "graph", ("scope",), "neighbors", "o"), ("text", "explanation", ("scope",), "support", ""), ("procs", "procedure", ("scope",), "find", "o"),
        ("conflicts", "revision_conflict", ("facts",), "check", "o"), ("report", "report", ("facts", "topology", "text", "procs", "conflicts"), "assemble", ""),
    ),
    "inventory": (("inventory", "lookup", (), "inventory", ""), ("scope", "cross_document", ("inventory",), "scope", "o")),
    "cross_document": (("sections", "cross_document", (), "find", ""), ("refs", "cross_document", ("sections",), "follow", "")),
    "ambiguous": (("clarify", "context_resolver", (), "clarify", ""),),
}
# What a secondary task adds unless the plan has the agent (second value) already; @ is the step that the addition hangs on.
EXTENSIONS = (
    ("procedure", "procedure", ("procs2", "procedure", ("@",), "find", "o")), ("procedure", "procedure", ("steps2", "procedure", ("procs2",), "steps", "o")), ("safety", "safety", ("safety2", "safety", ("@",), "answer", "os")),
    ("cross_document", "cross_document", ("refs2", "cross_document", ("@",), "follow", "o")), ("provenance", "cross_document", ("refs2", "cross_document", ("@",), "follow", "o")),
    ("limits", "calculation", ("limits2", "lookup", ("@",), "limits", "oe")), ("conflict", "revision_conflict", ("conf2", "revision_conflict", ("@",), "check", "o")),
    ("troubleshooting", "diagnostic", ("upset2", "diagnostic", ("@",), "find_upset", "o")), ("troubleshooting", "diagnostic", ("causes2", "diagnostic", ("upset2",), "causes", "o")),
)
# Agents that an addition hangs on, agents that need an entity, and the agent and mode that stand in for a failed agent.
ANCHORS = ("lookup", "procedure", "diagnostic")
NEEDS_ENTITY = ("graph", "procedure", "calculation")
FALLBACKS = {
    "procedure": ("explanation", "support"), "diagnostic": ("explanation", "support"), "calculation": ("explanation", "consequences"), "lookup": ("explanation", "support"), "graph": ("explanation", "support"),
    "comparison": ("explanation", "support"), "revision_conflict": ("explanation", "support"),
}
OTHER_FALLBACK = ("cross_document", "find")
#: Steps of a plan; those that an assembling step, and a report, waits for.
MOST, ASSEMBLED, REPORTED = 12, 6, 8


STEP = "struct<step: string, agent: string, needs: array<string>, mode: string, optional: boolean, safety: boolean, flags: string>"


def _row(name: str, agent: str, needs: tuple, mode: str, flags: str) -> tuple:
    return name, agent, list(needs), mode, "o" in flags, "s" in flags, flags


def _added(name: str, agent: str, needs: Column) -> Column:
    """An assembling step as a one-element array."""
    return F.array(F.struct(F.lit(name).alias("step"), F.lit(agent).alias("agent"), needs.alias("needs"), F.lit("assemble").alias("mode"), F.lit(True).alias("optional"), F.lit(False).alias("safety"), F.lit("o").alias("flags")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def plan_steps(requests: DataFrame) -> DataFrame:
    """QRY17: (request_id, place, step, agent, needs, mode, optional, safety): the plan of each request, places from 1.

    ``requests``: request_id, task, secondary (array of tasks in order), has_entity, has_value, has_mentions, wants_report (nulls: false).
    A task's template is extended by what its secondary tasks ask for and it has no agent for, each agent once; such steps hang on the
    first that looks up, finds a procedure or diagnoses, else on the last. Planning as a secondary task ends with a step that
    assembles, a report with one that reports. Without entity or mention, steps that need one are optional. A plan ends
    after 12 steps, and no step waits for one that was cut. An ambiguous request is only asked back; a task without template is a lookup.

    The templates are a table of a few rows that is broadcast. Requests of one task, flags and secondary tasks have one plan,
    so plans are made once a shape, in one projection, and meet the requests.
    """
    extra = [(task, key, _row(*step)) for task, key, step in EXTENSIONS]
    rows = [(task, [_row(*s) for s in steps], extra) for task, steps in TEMPLATES.items()]
    table = requests.sparkSession.createDataFrame(rows, f"__task string, __t array<{STEP}>, __e array<struct<task: string, key: string, step: {STEP}>>")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(f"__{c}") for c in ("has_entity", "has_value", "has_mentions", "wants_report")]
    listed = F.coalesce("secondary", F.array().cast("array<string>")).alias("__s")
    shape = [F.when(F.col("task").isin(*TEMPLATES), F.col("task")).otherwise("lookup").alias("__of"), *flags, listed]
    asked = settle(requests.select("request_id", *shape))  # requests may be costly, and are read twice
    base = asked.select(*["__of", "__has_entity", "__has_value", "__has_mentions", "__wants_report", "__s"]).distinct().join(F.broadcast(table), F.col("__of") == F.col("__task"))
    open_, second = F.col("__of") != "ambiguous", lambda task: F.array_contains("__s", task)
    fits = lambda s: (~F.contains(s["flags"], F.lit("e")) | F.col("__has_entity")) & (~F.contains(s["flags"], F.lit("v")) | F.col("__has_value")) & (~F.contains(s["flags"], F.lit("n")) | ~F.col("__has_value"))
    has = lambda steps, agent: F.exists(steps, lambda s: s["agent"] == agent)
    last = lambda steps, agent, n: F.transform(_tail(F.filter(steps, lambda s: s["agent"] != agent), n), lambda s: s["step"])

    def extended(template: Column) -> Column:
        offered = F.filter("__e", lambda e: open_ & ~has(template, e["key"]) & fits(e["step"]))
        anchor = F.coalesce(F.get(F.filter(template, lambda s: s["agent"].isin(*ANCHORS)), F.lit(0))["step"], F.element_at(template, -1)["step"])

        def brought(given: Column) -> Column:  # the first secondary task of a key brings it
            earlier = lambda key, i: F.exists(F.slice("__s", 1, i), lambda t: F.exists(given, lambda f: (f["task"] == t) & (f["key"] == key)))
            return F.flatten(F.transform("__s", lambda t, i: F.filter(given, lambda e: (e["task"] == t) & ~earlier(e["key"], i))))

        hung = _let(anchor, lambda a: F.transform(_let(offered, brought), lambda e: e["step"].withField("needs", F.when(e["step"]["needs"][0] == "@", F.array(a)).otherwise(e["step"]["needs"]))))
        return F.concat(template, hung)

    assembled = lambda steps: F.when(open_ & second("planning") & ~has(steps, "planner"), F.concat(steps, _added("assemble2", "planner", last(steps, "planner", ASSEMBLED)))).otherwise(steps)
    reported = lambda steps: F.when(open_ & (second("report") | F.col("__wants_report")) & ~has(steps, "report"), F.concat(steps, _added("report2", "report", last(steps, "report", REPORTED)))).otherwise(steps)
    whole = _let(_let(_let(F.filter("__t", fits), extended), assembled), reported)
    cut = lambda steps: _let(F.transform(steps, lambda s: s["step"]), lambda ids: F.transform(steps, lambda s: s.withField("needs", F.filter(s["needs"], lambda x: F.array_contains(ids, x)))))
    known = ["__of", "__has_entity", "__has_value", "__has_mentions", "__wants_report", "__s"]
    planned = base.select(*[F.col(c).alias(f"{c}_") for c in known], _let(F.slice(whole, 1, MOST), cut).alias("__plan"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in known]
    made = asked.join(planned, same).select("request_id", (F.col("__has_entity") | F.col("__has_mentions")).alias("__named"), F.posexplode("__plan").alias("place", "s"))
    optional = F.col("s.optional") | (F.col("s.agent").isin(*NEEDS_ENTITY) & ~F.col("__named"))
    return made.select("request_id", (F.col("place") + 1).alias("place"), "s.step", "s.agent", "s.needs", "s.mode", optional.alias("optional"), "s.safety")


def _tail(steps: Column, n: int) -> Column:
    return _let(steps, lambda x: F.slice(x, F.greatest(F.lit(1), F.size(x) - n + 1), n))


def replan(steps: DataFrame, failures: DataFrame, iteration: int = 1) -> DataFrame:
    """QRY17: the plans after required steps failed (request_id, step; one a request): each gets a fallback step at its end, and what waited for the failed step waits for that and becomes optional.

    A failed optional step changes nothing, and neither does one that the plan has not got.
    """
    told = steps.join(failures.select("request_id", F.col("step").alias("__failed")).distinct(), "request_id", "left")
    name = F.lit(f"fb{iteration}")
    waits = F.col("__failed").isNotNull() & F.array_contains("needs", F.col("__failed"))
    lost = told.where("step = __failed and not optional")
    hit = lost.select("request_id", F.lit(True).alias("__hit"))
    moved = told.join(hit, "request_id", "left").withColumn("__m", waits & F.coalesce("__hit", F.lit(False)))
    needs = F.when(F.col("__m"), F.transform("needs", lambda x: F.when(x == F.col("__failed"), name).otherwise(x))).otherwise(F.col("needs"))
    kept = moved.select("request_id", "place", "step", "agent", needs.alias("needs"), "mode", (F.col("optional") | F.col("__m")).alias("optional"), "safety")
    agent, mode = F.lit(OTHER_FALLBACK[0]), F.lit(OTHER_FALLBACK[1])
    for failed, (stand_in, way) in FALLBACKS.items():
        agent, mode = F.when(F.col("agent") == failed, stand_in).otherwise(agent), F.when(F.col("agent") == failed, way).otherwise(mode)
    sizes = steps.groupBy("request_id").agg((F.max("place") + 1).alias("place"))
    added = lost.select("request_id", "agent").join(sizes, "request_id").select("request_id", "place", name.alias("step"), agent.alias("__agent"), F.array().cast("array<string>").alias("needs"), mode.alias("mode"), F.lit(True).alias("optional"), F.lit(False).alias("safety"))
    return kept.unionByName(added.withColumnRenamed("__agent", "agent"))


def ready(steps: DataFrame, states: DataFrame) -> DataFrame:
    """QRY17: the steps (request_id, step, needs) that can run: not started, and all they need is done. ``states``: request_id, step, state.

    A failed step does not hold up the others: it counts as done, and what it would have given is missing.
    """
    over = states.where(F.col("state").isin("done", "failed")).groupBy("request_id").agg(F.collect_set("step").alias("__over"))
    begun = states.select("request_id", "step").distinct()
    waiting = steps.join(begun, ["request_id", "step"], "left_anti").join(over, "request_id", "left")
    return waiting.where(F.size(F.array_except("needs", F.coalesce("__over", F.array().cast("array<string>")))) == 0).drop("__over")
