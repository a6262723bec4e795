"""What a composed answer says that its evidence does not: figures, tags, and names given to tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import norm_alias, text_of
from .graph import settle
from .matching import resolve_mentions

# A number and a tag in running text; a tag with a name in brackets, and a name with a tag in brackets.
NUMBER = r"(?<![\w.])\d+(?:[.,]\d+)?(?![\w.])"
TAG = r"\d{1,3}-[A-Z]{1,4}-\d{1,5}(?:[A-Z](?:/[A-Z])*)?"
NAMED_AFTER = rf"(?i)\b({TAG})\s*\(([^)]{{3,60}})\)"
NAMED_BEFORE = rf"(?i)\b((?:[A-Za-z][A-Za-z/-]*\s+){{0,3}}[A-Za-z][A-Za-z/-]*)\s*\(({TAG})\)"
# Words in brackets that name nothing; qualifiers of which one item can have only one.
EMPTY_WORDS = (
    "normal", "design", "rated", "minimum", "maximum", "page", "operating", "documented",
    "above", "below", "approximately", "about", "train", "stream", "service", "spare", "standby",
)
CONTRADICTORY = (("atmospheric", "vacuum"), ("suction", "discharge"), ("inlet", "outlet"), ("upstream", "downstream"), ("overhead", "bottom"), ("cold", "hot"))


def _numbers(c: Column | str) -> Column:
    found = F.regexp_extract_all(text_of(c), F.lit(f"({NUMBER})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull()))


def _tags(c: Column | str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text_of(c), F.lit(rf"(?i)\b({TAG})\b"), F.lit(1)), F.upper))


def unsupported(answers: DataFrame) -> DataFrame:
    """VAL15: ``answers`` (answer, brief) with ``figures`` and ``tags`` of the answer that its brief has not got, in order. Numbers compare by value, tags in upper case; null texts are empty."""
    missing = lambda f: F.array_sort(F.array_except(f("answer"), f("brief")))
    return answers.withColumn("figures", missing(_numbers)).withColumn("tags", missing(_tags))


def misnamed(answers: DataFrame, aliases: DataFrame, entities: DataFrame, most: int = 2, about: str | None = None) -> DataFrame:
    """VAL15: (answer_id, place, tag, gloss, kind): names that an answer (answer_id, answer) gives to tags and the documents do not, the first ``most`` of each.

    A name stands in brackets after a tag, or before a tag in brackets; the former come first. Of its words of four letters or
    more, those that name something, at least half must be in what the documents call the tag's entity: its name, type and
    aliases (kind name). A qualifier is also wrong if the documents only have its opposite (kind qualifier). Tags that mean no
    entity are left out: ``unsupported`` tells them. ``aliases`` and ``entities`` as in ``resolve_mentions``, with name and entity_type.
    ``about`` is the column with the entity that an answer is about: a tag that is a name of it means it, whoever else has that tag.
    """
    both = lambda pattern, tag, gloss: F.arrays_zip(F.regexp_extract_all(text_of("answer"), F.lit(pattern), F.lit(tag)).alias("tag"), F.regexp_extract_all(text_of("answer"), F.lit(pattern), F.lit(gloss)).alias("gloss"))
    own = F.col(about) if about else F.lit(None).cast("string")
    dealt = answers.select("answer_id", own.alias("own"), "answer").repartition("answer_id")  # a small file is one task, and the patterns are slow
    said = dealt.select("answer_id", "own", F.posexplode(F.concat(both(NAMED_AFTER, 1, 2), both(NAMED_BEFORE, 2, 1))).alias("place", "g")).select("answer_id", "own", "place", "g.tag", "g.gloss")
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("gloss"), F.lit("([a-z]{4,})"), F.lit(1)), lambda w: ~w.isin(*EMPTY_WORDS)))
    named = said.withColumn("words", words).where("size(words) > 0").withColumn("key", norm_alias("tag"))
    if about:
        names = aliases.groupBy(F.col("entity_uid").alias("own")).agg(F.collect_set("alias").alias("names"))
        known = F.coalesce(F.exists("names", lambda a: norm_alias(a) == F.col("key")), F.lit(False))
        named = named.join(names, "own", "left").withColumn("own", F.when(known, F.col("own"))).drop("names")
    named = settle(named)
    others = named.where("own is null")
    meant = resolve_mentions(others.select(F.col("tag").alias("request_id"), F.col("tag").alias("mention")).distinct(), aliases, entities, 1).select(F.col("request_id").alias("tag"), "entity_uid")
    called = aliases.select("entity_uid", "alias").unionByName(entities.select("entity_uid", F.explode(F.array("name", "entity_type")).alias("alias"))).where("alias is not null").distinct()
    read = others.join(meant, "tag").unionByName(named.where("own is not null").withColumn("entity_uid", F.col("own")))
    wanted = called.join(read.select("entity_uid").distinct(), "entity_uid", "left_semi").groupBy("entity_uid").agg(F.lower(F.concat_ws(" ", F.array_sort(F.collect_set("alias")))).alias("documented"))
    judged = read.join(wanted, "entity_uid")
    shared = F.size(F.filter("words", lambda w: F.contains(F.col("documented"), w)))
    opposed = F.lit(False)
    for a, b in CONTRADICTORY:
        in_words, in_documents = (lambda w: F.array_contains("words", w)), (lambda w: F.contains("documented", F.lit(w)))
        opposed = opposed | (in_words(a) & in_documents(b) & ~in_documents(a)) | (in_words(b) & in_documents(a) & ~in_documents(b))
    wrong = judged.withColumn("kind", F.when(shared * 2 < F.size("words"), "name").when(opposed, "qualifier")).where("kind is not null")
    first = wrong.withColumn("__r", F.row_number().over(Window.partitionBy("answer_id").orderBy("place")))
    return first.where(F.col("__r") <= most).select("answer_id", "place", "tag", "gloss", "kind")
