"""Names and sets of words that mean the same: similarity joins on classes of equal sets, and what a mention refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.tags import parse_tag
from ..functions.vocabulary import STOP_WORDS
from .graph import settle

#: So many rows of one token meet the other side in one task; a token of more is dealt over several.
TOKEN_ROWS = 4_096
#: A word of more sets than this is common: sets that share only common words meet as kinds, not one by one.
COMMON_SETS = 64
#: What rounding may take from a share of a whole number.
TINY = 1e-9


def set_classes(rows: DataFrame, key: str = "id", tokens: str = "tokens") -> DataFrame:
    """(key, class_id, tokens): rows whose token sets are equal, whatever their order and repeats, share the smallest key as class. Null and empty sets are one class, too."""
    plain = rows.select(key, F.array_sort(F.array_distinct(F.coalesce(tokens, F.array().cast("array<string>")))).alias("tokens"))
    smallest = plain.groupBy("tokens").agg(F.min(key).alias("class_id"))
    return plain.join(smallest, "tokens").select(key, "class_id", "tokens")


def _spread(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` joined with ``right`` by token; the rows of a frequent token are dealt over several tasks, each with all of its other side."""
    hot = left.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / TOKEN_ROWS).cast("int").alias("__parts")).where("__parts > 1")
    dealt = left.join(hot, "token", "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("left_id"), F.col("__parts")).cast("int"))).drop("__parts")
    copied = right.join(hot, "token", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copied, ["token", "__part"]).drop("__part")


def similar_sets(left: DataFrame, right: DataFrame, least: float = 0.5, contained: int | None = None, rare: int | None = None) -> DataFrame:
    """JOI6: (left_id, right_id, common, union) of token sets (id, tokens) whose Jaccard similarity is at least ``least``.

    With ``contained``, also those whose left set has so many tokens or more and lies in the right one. Give classes
    (``set_classes``) rather than rows, or equal sets are paired one by one. In the order of global frequency two similar
    sets share one of their rarest tokens, so only these meet, within the lengths and places that the similarity
    allows; a pair meets at several tokens but is taken at the first that both have, so nothing is made distinct. A left
    set that lies in another meets it at its rarest token alone. Empty sets meet nothing. With ``rare``, only pairs that
    share a token of at most so many sets of both sides: the first that they share is one.
    """
    kinds = {"left_id": left.schema["id"].dataType, "right_id": right.schema["id"].dataType}
    own = lambda df, side: df.select(F.lit(side).alias("side"), *[(F.col("id") if c == side else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()], "tokens")
    rows = own(left, "left_id").unionByName(own(right, "right_id")).where("size(tokens) > 0")
    tokens = rows.select("side", *kinds, F.explode("tokens").alias("token"))
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ordered = tokens.join(frequency, "token").groupBy("side", *kinds).agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("t")).withColumn("n", F.size("t"))
    placed = ordered.select("side", *kinds, "t", "n", F.posexplode("t").alias("place", "token"))
    if rare is not None:
        placed = placed.join(frequency.where(F.col("df") <= rare).select("token"), "token", "left_semi")
    prefix = placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - TINY))
    a = prefix.where("side = 'left_id'").select("token", "left_id", F.col("t").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"))
    side = lambda df: df.where("side = 'right_id'").select("token", "right_id", F.col("t").alias("y"), F.col("n").alias("ny"), F.col("place").alias("py"))
    room = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))  # tokens from here on that both may share
    met = _spread(a, side(prefix)).where((F.col("nx") >= F.col("ny") * least - TINY) & (F.col("ny") >= F.col("nx") * least - TINY) & (room * (1 + least) >= (F.col("nx") + F.col("ny")) * least - TINY))
    both = F.array_intersect("x", "y")
    similar = met.withColumn("both", both).where(F.get("both", F.lit(0)) == F.col("token")).withColumn("common", F.size("both")).withColumn("union", F.col("nx") + F.col("ny") - F.col("common"))
    out = similar.where(F.col("common") >= F.col("union") * least - TINY).select("left_id", "right_id", "common", "union")
    if contained is None:
        return out
    rarest = placed.where((F.col("side") == "left_id") & (F.col("place") == 0) & (F.col("n") >= contained)).select("token", "left_id", F.col("t").alias("x"), F.col("n").alias("nx"))
    inside = _spread(rarest, side(placed)).where((F.size(F.array_except("x", "y")) == 0) & (F.col("nx") < F.col("ny") * least - TINY))
    return out.unionByName(inside.select("left_id", "right_id", F.col("nx").alias("common"), F.col("ny").alias("union")))


def words_of_key(key: Column) -> Column:
    """The distinct words of a normal name, dashes taken as spaces."""
    return F.array_distinct(F.filter(F.split(F.replace(key, F.lit("-"), F.lit(" ")), " "), lambda w: w != ""))


def _kinds(left: DataFrame, right: DataFrame, owners: DataFrame) -> DataFrame:
    """(id, tokens, entity_uid, tagged, n): the ``owners`` (id, entity_uid, tagged, n) of the sets of ``right`` (id, tokens) that have common words, by kind: these words and how many there are in all.

    A kind's set is its common words and as many blanks as it has others, so it is as long as each of its sets.
    """
    words = left.unionByName(right).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    common = words.where(F.col("df") > COMMON_SETS).select("token")
    held = right.select("id", F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(common, "token").groupBy("id", "size").agg(F.array_sort(F.collect_list("token")).alias("words"))
    blanks = F.slice(F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.concat(F.lit("\t"), i)), F.lit(1), F.col("size") - F.size("words"))
    kinds = held.select("id", F.concat("words", blanks).alias("tokens"))
    return kinds.join(owners, "id").select(F.array_join("tokens", " ").alias("id"), "tokens", "entity_uid", "tagged", "n").distinct()


def resolve_mentions(mentions: DataFrame, aliases: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """WIN5: (request_id, entity_uid, tier, score, rank): the entities that a mention (request_id, mention) may mean, the best first.

    ``aliases`` (entity_uid, alias) are all names and tags of ``entities`` (entity_uid, canonical_tag, mention_count). By
    normal name: the mention's tag counts 1, a name 0.95, the parent of a train's tag 0.9; a tag without plant
    number, unless it is a tag's name itself, every tag that ends with it 0.8. Only for a mention that all this leaves empty: names with half of its
    words in common, or with all of its two or more, 0.5 and 0.4 times their similarity; stop words of the mention and tags of
    up to two parts stay out. Of several tiers the best counts. 0.02 for a tagged entity and a ten-thousandth a
    mention, up to 200, order equal scores; ties go to the smaller uid. Blank mentions get nothing.

    The first tiers are one join of equality: a mention becomes a row a key, and tags are listed by their endings, too. The owners of
    one name count alike for a mention, so only the ``most`` of them that win a tie meet the mentions; mentions of equal words are compared once.
    So do the owners of names of one length that share the same common words with a mention, and no other: they meet it as one kind
    (``_kinds``), not name by name. One that shares a rarer word, too, is met by that, and its better score counts.
    """
    asked = mentions.select("request_id", F.trim(text.text_of("mention")).alias("mention")).where("mention <> ''").distinct()
    tag = parse_tag(F.replace(F.regexp_replace("mention", r"\s*-\s*", "-"), F.lit(" "), F.lit("")))
    read = settle(asked.withColumn("tag", tag).select("request_id", "mention", "tag.canonical", "tag.parent", (F.col("tag").isNotNull() & F.col("tag.plant").isNull()).alias("bare")))  # parsed once
    parsed = settle(read.select("request_id", "bare", text.norm_alias("mention").alias("name"), *[F.when(F.col(c).isNotNull(), text.norm_alias(c)).alias(n) for c, n in (("canonical", "own"), ("parent", "parent"))]))
    tier = lambda key, kind, score: F.struct(key.alias("key"), F.lit(kind).alias("tier"), F.lit(score).alias("score"))
    ending = F.when(F.col("bare"), F.concat(F.lit("\t"), F.col("own")))
    tiers = F.array(tier(F.col("own"), "tag", 1.0), tier(F.col("parent"), "parent", 0.9), tier(F.col("name"), "alias", 0.95), tier(ending, "suffix", 0.8))
    keys = parsed.select("request_id", F.explode(tiers).alias("t")).select("request_id", "t.*").where("key is not null and key <> ''")
    weights = entities.select("entity_uid", F.coalesce(F.col("canonical_tag") != "", F.lit(False)).alias("tagged"), F.coalesce("mention_count", F.lit(0)).alias("n"))
    first = [F.desc_nulls_last(F.when(F.col("n").isNotNull(), F.when(F.col("tagged"), 200).otherwise(0) + F.least("n", F.lit(200)))), F.col("entity_uid")]
    cut = lambda df, by="key": df.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*first))).where(F.col("__r") <= most).drop("__r")
    named = F.filter(F.array(text.norm_alias("alias")), lambda k: k != "")  # a filter of rows would be done before they are dealt out
    owned = aliases.repartition("entity_uid").select("entity_uid", F.explode(named).alias("key")).distinct()
    known = settle(cut(owned.join(weights, "entity_uid", "left")))
    parts = F.split("key", "-")
    endings = known.where(F.size(parts) > 1).select("entity_uid", "tagged", "n", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(F.lit("\t"), F.array_join(F.slice(parts, i, 64), "-")))).alias("key"))
    hits = keys.join(cut(known.unionByName(endings).distinct()), "key").select("request_id", "entity_uid", "tier", "score")
    exact = F.max(F.col("tier").isin("tag", "parent")).over(Window.partitionBy("request_id"))
    direct = settle(hits.withColumn("exact", exact).where("tier <> 'suffix' or not exact").drop("exact"))
    lacking = parsed.join(direct.select("request_id").distinct(), "request_id", "left_anti")
    wanted = set_classes(lacking.select("request_id", F.array_except(words_of_key(F.col("name")), F.array(*[F.lit(w) for w in STOP_WORDS])).alias("tokens")), "request_id").where("size(tokens) > 0")
    offered = set_classes(known.where(~F.contains("key", F.lit("-")) | (F.size(words_of_key(F.col("key"))) > 2)).select("key", words_of_key(F.col("key")).alias("tokens")).distinct(), "key")
    sets = lambda df: df.select(F.col("class_id").alias("id"), "tokens").distinct()
    left, right = settle(sets(wanted)), settle(sets(offered))
    owners = offered.select("key", F.col("class_id").alias("id")).join(known.where("n is not null"), "key").select("id", "entity_uid", "tagged", "n")
    kinds = settle(cut(_kinds(left, right, owners), "id"))
    met = lambda pairs, of: pairs.join(of.withColumnRenamed("id", "right_id"), "right_id").select("left_id", "entity_uid", "tagged", "n", "common", "union")
    near = met(similar_sets(left, right, 0.5, contained=2, rare=COMMON_SETS), owners).unionByName(met(similar_sets(left, kinds.select("id", "tokens").distinct(), 0.5, contained=2), kinds.drop("tokens")))
    order = F.round(F.col("score") + F.when(F.col("tagged"), 0.02).otherwise(0.0) + F.least("n", F.lit(200)) / 10000, 9)
    alike = near.groupBy("left_id", "entity_uid", "tagged", "n").agg(F.max(0.5 + 0.4 * F.col("common") / F.col("union")).alias("score"))
    nearest = alike.withColumn("__r", F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc(order), "entity_uid"))).where(F.col("__r") <= most)
    fuzzy = nearest.join(wanted.select("request_id", F.col("class_id").alias("left_id")), "left_id").select("request_id", "entity_uid", F.lit("fuzzy").alias("tier"), "score")
    best = direct.unionByName(fuzzy).groupBy("request_id", "entity_uid").agg(F.max("score").alias("score"), F.max_by("tier", "score").alias("tier"))
    weighed = best.join(weights, "entity_uid")
    ranked = weighed.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc(order), "entity_uid")))
    return ranked.where(F.col("rank") <= most).select("request_id", "entity_uid", "tier", F.round("score", 6).alias("score"), "rank")


def name_classes(names: DataFrame, key: str, name: str) -> DataFrame:
    """JOI9, QRY13: (key, class_id, members): what shares a normal name is one class, named by its smallest key; nameless rows are left out. No pairs are listed."""
    keyed = names.select(key, text.norm_alias(name).alias("__n")).where("__n <> ''").distinct()
    classes = keyed.groupBy("__n").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("members"))
    return keyed.join(classes, "__n").select(key, "class_id", "members")


def alias_classes(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """JOI9: (k, alias, first_uid, entities): the normal names of each k (k, name) that entities (entity_uid, alias) have, how many have it, and the smallest. Either-or becomes rows, so the join is one of equality, and a name that thousands share stays one row."""
    held = aliases.select("entity_uid", text.norm_alias("alias").alias("alias")).where("alias <> ''").distinct().groupBy("alias").agg(F.min("entity_uid").alias("first_uid"), F.count(F.lit(1)).alias("entities"))
    return names.select("k", text.norm_alias("name").alias("alias")).distinct().join(held, "alias").select("k", "alias", "first_uid", "entities")
