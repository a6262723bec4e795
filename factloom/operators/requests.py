"""Requests of a conversation: what is asked for, whether a turn leans on the one before, what it names.

Rule tables become columns: one expression a rule, evaluated in one pass over the texts, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import request_rules as rules
from ..functions.tags import find_tags
from ..functions.text import sentences, text_of
from ..functions.units import family, find_quantities
from .joins import dealt


def matches(c: Column | str, pattern: str) -> Column:
    return text_of(c).rlike(f"(?i){pattern}")


def first_match(c: Column | str, table: tuple, otherwise: str | None = None, part: int = 1) -> Column:
    """The value (``part`` of the rule) of the first rule of ``table`` that matches."""
    out = None
    for rule in table:
        hit = matches(c, rule[0])
        out = F.when(hit, rule[part]) if out is None else out.when(hit, rule[part])
    return out.otherwise(F.lit(otherwise).cast("string"))


def _task_scores(c: Column | str) -> Column:
    """array of struct(score in tenths, -order, task): the weights of the rules that match, of tasks that score."""
    scored = []
    for order, (task, table) in enumerate(rules.TASK_RULES.items()):
        total = F.lit(0)
        for rule in table:
            hit = matches(c, rule[0])
            if len(rule) > 2:
                hit = hit & ~matches(c, rule[2])
            total = total + F.when(hit, round(rule[1] * 10)).otherwise(0)
        scored.append(F.struct(total.alias("score"), F.lit(-order).alias("order"), F.lit(task).alias("task")))
    return F.filter(F.array(*scored), lambda s: s["score"] > 0)


def classify_tasks(requests: DataFrame, text: str = "text") -> DataFrame:
    """QRY14: ``task``, ``score``, ``confidence`` and up to three ``secondary`` tasks of each request.

    The highest sum of weights wins, ties by the order of the tasks. Confidence grows with the score and with its lead
    over the next; without any match the task is a lookup of confidence 0.2.
    """
    ranked = dealt(requests).withColumn("__r", F.sort_array(_task_scores(F.trim(text_of(text))), asc=False))
    best, second = F.get("__r", F.lit(0)), F.coalesce(F.get("__r", F.lit(1))["score"], F.lit(0))
    score = best["score"] / 10
    sure = F.least(F.lit(0.98), 0.35 + 0.15 * F.least(score, F.lit(3.0)) + 0.3 * (best["score"] - second) / best["score"])
    others = F.filter(F.slice("__r", 2, 20), lambda s: (s["score"] * 2 >= best["score"]) & (s["score"] >= 15))
    return ranked.select(
        *requests.columns,
        F.coalesce(best["task"], F.lit("lookup")).alias("task"), F.coalesce(score, F.lit(0.0)).alias("score"),
        F.when(best.isNull(), 0.2).otherwise(F.round(sure, 4)).alias("confidence"), F.transform(F.slice(others, 1, 3), lambda s: s["task"]).alias("secondary"),
    )


def scope(c: Column | str) -> Column:
    """FLT19: out_of_scope, greeting or in_scope."""
    return F.when(matches(c, rules.OUT_OF_SCOPE), "out_of_scope").when(matches(c, rules.GREETING), "greeting").otherwise("in_scope")


def severity(c: Column | str) -> Column:
    """STR34: danger, warning, caution or info."""
    return first_match(c, rules.SEVERITIES, "info")


def subtasks(c: Column | str) -> Column:
    """QRY19: the kinds of work in a request, each once in order; several end with composition, none is composition."""
    found = F.array_distinct(F.filter(F.array(*[F.when(matches(c, p), kind) for p, kind in rules.SUBTASKS]), lambda k: k.isNotNull()))
    return F.when(F.size(found) == 0, F.array(F.lit("composition"))).when((F.size(found) > 1) & ~F.array_contains(found, "composition"), F.concat(found, F.array(F.lit("composition")))).otherwise(found)


def symptom(c: Column | str) -> Column:
    """QRY15: struct(variable, direction) of what a request says is wrong, null if nothing: a variable and how it changes, else a plainer wording."""
    found = lambda k: F.regexp_extract(text_of(c), f"(?i){rules.SYMPTOM}", k)
    variable = F.regexp_replace(F.trim(found(1)), r"(?i)^\s*(the|its|a|an)\s+", "")
    said = lambda words: F.lower(found(2)).rlike("|".join(words))
    direction = F.when(said(rules.DOWNWARD), "low").when(said(rules.UPWARD), "high").otherwise("fluctuating")
    plain = F.when(first_match(c, rules.SIMPLE_SYMPTOMS).isNotNull(), F.struct(first_match(c, rules.SIMPLE_SYMPTOMS).alias("variable"), first_match(c, rules.SIMPLE_SYMPTOMS, None, 2).alias("direction")))
    return F.when(found(2) != "", F.struct(variable.alias("variable"), direction.alias("direction"))).otherwise(plain)


def quantities(c: Column | str) -> Column:
    """QRY15: array of struct(value, unit, parameter) of a request: its quantities, or else a bare number after at, to or of, without unit."""
    named = F.transform(find_quantities(c), lambda q: F.struct(q["value"].alias("value"), q["unit"].alias("unit"), first_family(family(q["unit"])).alias("parameter")))
    bare = F.regexp_extract(text_of(c), rules.BARE_NUMBER, 1)
    alone = F.array(F.struct(bare.try_cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("parameter")))
    return F.when((F.size(named) == 0) & (bare != ""), alone).otherwise(named)


def first_family(c: Column) -> Column:
    """The parameter that quantities of a family are of, null for others."""
    out = F.when(c == rules.FAMILY_PARAMETERS[0][0], rules.FAMILY_PARAMETERS[0][1])
    for name, parameter in rules.FAMILY_PARAMETERS[1:]:
        out = out.when(c == name, parameter)
    return out


def resolve_requests(requests: DataFrame, text: str = "text") -> DataFrame:
    """QRY15: what a request names: tags, parameter and where, action, scenario, mode, class of equipment, scope, symptom, quantities, and whether it is restricted.

    Asking to get round a protection is restricted, whatever else is asked.
    """
    c = F.col(text)
    return requests.select(
        "*", find_tags(c).alias("tags"), first_match(c, rules.PARAMETERS).alias("parameter"), first_match(c, rules.PARAMETERS, None, 2).alias("location"),
        first_match(c, rules.ACTIONS).alias("action"), first_match(c, rules.REQUEST_SCENARIOS).alias("scenario"), first_match(c, rules.OPERATING_MODES).alias("mode"),
        first_match(c, rules.SUBJECT_TYPES).alias("subject_type"), first_match(c, rules.SCOPES).alias("scope"), symptom(c).alias("symptom"), quantities(c).alias("quantities"),
        F.coalesce(first_match(c, rules.ACTIONS) == "bypass", F.lit(False)).alias("restricted"),
    )


def follow_ups(turns: DataFrame, by: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """QRY16: ``kind`` of each turn (new, substitution, elaboration, continuation), the ``subject`` it takes over, and the request ``rewritten`` to stand alone.

    ``subject`` is the tag named last before the turn; a turn without one before it is new. One shuffle by conversation.
    """
    c = F.trim(text_of(text))
    w = Window.partitionBy(by).orderBy(order)
    n_words = F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    own = matches(c, rules.OWN_SUBJECT)
    kind = (
        F.when(F.lag(F.lit(1)).over(w).isNull(), "new").when(matches(c, rules.SUBSTITUTION), "substitution").when(matches(c, rules.PRONOUN) & ~own, "continuation")
        .when(matches(c, rules.ELABORATION) & (~own | (n_words <= 9)), "elaboration").when(~own & (n_words <= 8), "continuation").otherwise("new")
    )
    named = turns.withColumn("__tag", F.get(find_tags(c), F.lit(0)))
    carried = F.last("__tag", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    told = named.withColumn("__kind", kind).withColumn("__before", carried)
    leans = (F.col("__kind") != "new") & F.col("__before").isNotNull()
    stem, s = F.regexp_replace(c, r"[?.]+$", ""), F.col("__before")
    angle = first_match(c, rules.ANGLES)
    spelled = F.regexp_replace(c, F.lit(r"(?i)\b(it|that|this|these|those|they|them|the same)\b"), s)
    rewritten = (
        F.when(F.col("__kind") == "substitution", F.concat(stem, F.lit(" — instead of "), s, F.lit(". Compare the proposed item with "), s, F.lit(" and say what changes if it is used in its place.")))
        .when(F.col("__kind") == "elaboration", F.concat(stem, F.lit(" — for "), s, F.coalesce(F.concat(F.lit(", "), angle), F.lit("")), F.lit("?")))
        .otherwise(F.when(spelled != c, spelled).otherwise(F.concat(stem, F.lit(" — about "), s, F.lit("?"))))
    )
    return told.select(*turns.columns, F.when(leans, F.col("__kind")).otherwise("new").alias("kind"), F.when(leans, s).alias("subject"), F.when(leans, rewritten).alias("rewritten"))


def procedure_type(title: Column | str, section_path: Column | str) -> Column:
    """STC6: the kind of a procedure, from its title, else from its section."""
    return F.coalesce(first_match(title, rules.PROCEDURE_TYPES), first_match(section_path, rules.PROCEDURE_TYPES), F.lit("procedure"))


def prerequisites(steps: DataFrame, by: str = "procedure_id", sequence: str = "sequence", text: str = "text", most: int = 20) -> DataFrame:
    """QRY7: the steps that must hold before the others: worded so, and in the first third (three at least) or saying so outright. Equal texts once, ``most`` a procedure."""
    whole = Window.partitionBy(by)
    early = F.col(sequence) <= F.greatest(F.lit(3), F.floor(F.count(F.lit(1)).over(whole) / 3))
    found = steps.withColumn("__early", early).where(matches(text, rules.PREREQUISITE) & (F.col("__early") | matches(text, rules.PREREQUISITE_CUE)))
    first = found.withColumn("__n", F.row_number().over(Window.partitionBy(by, text).orderBy(sequence))).where("__n = 1")
    return first.withColumn("__n", F.row_number().over(whole.orderBy(sequence))).where(F.col("__n") <= most).drop("__n", "__early")


def diagnosis(chunks: DataFrame, key: str, of: str, most: int = 10) -> DataFrame:
    """QRY8: (key, sentence, kind, rank): sentences of 25 to 380 characters that give a cause, a check or an action, the first wording that fits; equal ones once, ``most`` of a kind and chunk in order."""
    told = chunks.select(key, F.posexplode(sentences(of)).alias("__pos", "sentence")).where(F.length("sentence").between(25, 380))
    kind = F.when(matches("sentence", rules.CAUSE), "cause").when(matches("sentence", rules.CHECK), "check").when(matches("sentence", rules.ACTION), "action")
    first = told.withColumn("kind", kind).where("kind is not null").groupBy(key, "kind", "sentence").agg(F.min("__pos").alias("__pos"))
    w = Window.partitionBy(key, "kind").orderBy("__pos")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(key, "sentence", "kind", "rank")
