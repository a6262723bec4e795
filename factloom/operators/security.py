"""Row-level access as joins that come before any ranking or limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import settle
from .joins import BROADCAST_KEYS, dealt, few

# The order of roles and of document tags.
ROLES = {"guest": 0, "operator": 1, "engineer": 2, "manager": 3, "admin": 4}
TAGS = {"PUBLIC": 0, "INTERNAL": 1, "CONFIDENTIAL": 2, "SECRET": 3}


def level(name: Column, levels: dict[str, int], unknown: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in levels.items() for x in pair]), name), F.lit(unknown))


def can_read(role: Column, tag: Column) -> Column:
    """SEC1: unknown roles are guests, unknown tags are secret."""
    return level(role, ROLES, 0) >= level(tag, TAGS, 3)


def secured(rows: DataFrame, documents: DataFrame, role: str, grants: DataFrame | None = None, record: str = "claim_id") -> DataFrame:
    """SEC3, FLT16: rows of readable documents, and rows granted one by one."""
    allowed = documents.where(can_read(F.lit(role), F.col("tag"))).select("document_id")
    out = rows.join(allowed, "document_id", "left_semi")
    if grants is None:
        return out
    closed = rows.join(allowed, "document_id", "left_anti")
    return out.unionByName(closed.join(grants.select(record), record, "left_semi"))


def withheld(rows: DataFrame, documents: DataFrame, role: str) -> DataFrame:
    """SEC3, SEC5: how many rows of each document stay closed."""
    closed = documents.where(~can_read(F.lit(role), F.col("tag"))).select("document_id")
    return rows.join(closed, "document_id", "left_semi").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_withheld"))


def classify_documents(documents: DataFrame, pins: DataFrame, rules: tuple[tuple[str, str], ...], upload: str = "CONFIDENTIAL") -> DataFrame:
    """SEC2: ``classified``: the tag pinned to a document (document_id, pin), else that of uploads, else the first rule (pattern, tag) that its type matches, else SECRET."""
    ruled = F.lit("SECRET")
    for pattern, tag in reversed(rules):
        ruled = F.when(F.col("document_type").rlike(pattern), tag).otherwise(ruled)
    told = documents.join(pins.select("document_id", "pin"), "document_id", "left")
    return told.withColumn("classified", F.coalesce("pin", F.when(F.col("origin") == "upload", upload).otherwise(ruled))).drop("pin")


def grant_reason(revoked: Column, spent: Column, expired: Column, wrong_requester: Column, wrong_question: Column) -> Column:
    """SEC6: why a grant cannot be redeemed, the first reason that holds; granted if none does. An unknown (null) counts against it."""
    bad = lambda c: F.coalesce(c, F.lit(True))
    return F.when(bad(revoked), "revoked").when(bad(spent), "spent").when(bad(expired), "expired").when(bad(wrong_requester), "requester").when(bad(wrong_question), "question").otherwise("granted")


def scope_hash(parts: Column) -> Column:
    """SEC6: the hash of a grant's scope, whatever the order and repetition of its parts."""
    return F.sha2(F.concat_ws("\n", F.array_sort(F.array_distinct(parts))), 256)


def release_level(rows: DataFrame, documents: DataFrame, by: str) -> DataFrame:
    """SEC7: the highest level among the documents behind each ``by``: who must release it."""
    return rows.join(documents.select("document_id", level(F.col("tag"), TAGS, 3).alias("__l")), "document_id").groupBy(by).agg(F.max("__l").alias("needs"))


def distinctive(rows: DataFrame, value: str, owner: str) -> DataFrame:
    """SEC8: values that only one owner has: a leak of one tells where it comes from."""
    return rows.groupBy(value).agg(F.countDistinct(owner).alias("n"), F.min(owner).alias("only_in")).where("n = 1").drop("n")


def leaks(rows: DataFrame, documents: DataFrame, role: str) -> DataFrame:
    """VAL16: rows shown whose document the role cannot read or that has no document at all."""
    return rows.join(documents.where(can_read(F.lit(role), F.col("tag"))).select("document_id"), "document_id", "left_anti")


def scope_probe(requests: DataFrame, records: DataFrame, documents: DataFrame, entities: DataFrame, most: dict[str, int]) -> DataFrame:
    """SEC5: (request_id, document_id, record_id): what a request's role may not read of what bears on its entities, as ids only.

    ``requests``: request_id, role, entity_uid, a row an entity. ``records``: entity_uid, document_id, kind, id, weight. ``documents``:
    document_id, tag. ``entities``: entity_uid, document_id. Of each kind the first ``most`` a request by weight, then id; other kinds are
    left out. An entity's own record joins where one of its documents is in the scope already, under the first of them. Records
    are cut to ``most`` by entity, role and kind before requests meet them, which loses none; equal ones go by document, too. Only records
    of entities that are asked for are read on, and requests are dealt over tasks before they meet lists, so an entity of many is no hot key.
    """
    limit = F.create_map(*[F.lit(x) for p in most.items() for x in p])
    asked = requests.select("request_id", F.coalesce("role", F.lit("guest")).alias("role"), "entity_uid").distinct()
    wanted = few(asked.select("entity_uid").distinct())
    tagged = (
        records.where(F.col("kind").isin(*most) & F.col("id").isNotNull()).select("entity_uid", "document_id", "kind", "id", "weight").join(wanted, "entity_uid", "left_semi").distinct()
        .join(documents.select("document_id", F.coalesce("tag", F.lit("SECRET")).alias("tag")), "document_id")
    )
    first = lambda *by: Window.partitionBy(*by, "kind").orderBy(F.desc("weight"), "id", "document_id")
    best = lambda rows, *by: rows.withColumn("__r", F.row_number().over(first(*by))).where(F.col("__r") <= max(most.values())).where(F.col("__r") <= limit[F.col("kind")])
    shut = tagged.groupBy("entity_uid", "document_id", "tag", "kind", "id").agg(F.max("weight").alias("weight")).join(asked.select("entity_uid", "role").distinct(), "entity_uid").where(~can_read(F.col("role"), F.col("tag")))
    top = settle(best(shut, "entity_uid", "role").select("entity_uid", "role", F.struct("document_id", "kind", "id", "weight").alias("x")))
    lists = top.groupBy("entity_uid", "role").agg(F.collect_list("x").alias("xs"))
    homes = settle(entities.select("entity_uid", "document_id").join(wanted, "entity_uid", "left_semi").distinct())
    each = dealt(asked, "request_id")
    listed = each.join(F.broadcast(lists), ["entity_uid", "role"]) if top.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else dealt(asked.join(lists, ["entity_uid", "role"]), "request_id")
    met = listed.select("request_id", F.explode("xs").alias("x")).groupBy("request_id", "x.document_id", "x.kind", "x.id").agg(F.max("x.weight").alias("weight"))
    found = best(met, "request_id").select("request_id", "document_id", F.concat_ws(":", "kind", "id").alias("record_id"))
    scope = found.select("request_id", "document_id").distinct()
    own = each.join(few(homes), "entity_uid").join(scope, ["request_id", "document_id"], "left_semi")
    named = own.groupBy("request_id", F.concat(F.lit("entity:"), "entity_uid").alias("record_id")).agg(F.min("document_id").alias("document_id"))
    return found.unionByName(named)
