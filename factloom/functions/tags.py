"""Asset tags: parsing, scope, scanning, trains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_of
from .vocabulary import NON_TAG_PREFIXES

#: A fixed value: plant, prefix, number and suffix letters of a cleaned tag.
PATTERN = r"^(?:([0-9]{1,3})-)?([A-Z]{1,4})-([0-9]{1,5})([A-Z](?:/[A-Z])*)?$"
#: A fixed value: the same to the very end, a line's end not passed over: what cleaning would leave as it is.
CLEAN = PATTERN[:-1] + r"\z"
#: A fixed value: what may be a tag in running text.
SCAN = r"(?<![A-Za-z0-9])(?:\d{1,3}\s*[-–—_]\s*)?[A-Za-z]{1,4}\s*[-–—_]\s*\d{1,5}(?:\s*[A-Za-z](?:\s*[/&,]\s*[A-Za-z])*)?(?![A-Za-z0-9])"


def cleaned(c: Column | str) -> Column:
    """Upper case, one kind of dash, no space about dashes and slashes, suffix letters joined to the number."""
    t = F.upper(F.trim(text_of(c)))
    for pattern, to in (
        ("[–—−‐‑‒_]", "-"), (r"\s*-\s*", "-"), (r"\s*/\s*", "/"), (r"\s*[&,]\s*", "/"), (r"\s+", " "),
        (r"""^[ .,:;()\[\]{}"']+|[ .,:;()\[\]{}"']+$""", ""), (r"([0-9]) ([A-Z](?:/[A-Z])*)$", "$1$2"),
    ):
        t = F.regexp_replace(t, pattern, to)
    return t


def parse_tag(c: Column | str) -> Column:
    """STR9: struct(canonical, plant, prefix, number, suffixes, parent, children), null for what is no tag.

    Several suffixes name the trains of one item: the item is canonical and the trains are children. One suffix makes
    a child of its own. Only a letter before a digit can be a tag, and one in its clean form needs no cleaning; each step
    is a lambda's variable, so it is done once.
    """
    once = lambda x, step: F.element_at(F.transform(F.array(x), step), 1)
    dashed = lambda t: F.when(t.rlike(CLEAN), t).when(t.rlike("(?s)[A-Z].*[0-9]"), F.regexp_replace(cleaned(t), "(?<=[A-Z0-9]) (?=[A-Z0-9])", "-"))
    return once(once(once(F.upper(F.trim(text_of(c))), dashed), _split), _parsed)


def is_tag(c: Column | str) -> Column:
    """STR9: whether ``parse_tag`` reads a tag here, by one pattern where the text is clean; false for null."""
    t = F.upper(F.trim(text_of(c)))
    return F.when(t.rlike(CLEAN), (F.length(t) <= 32) & ~t.rlike(f"^(?:{'|'.join(NON_TAG_PREFIXES)})-[0-9]")).when(t.rlike("(?s)[A-Z].*[0-9]"), parse_tag(c).isNotNull()).otherwise(False)


def _split(dashed: Column) -> Column:
    groups = [F.regexp_extract(dashed, PATTERN, k).alias(name) for k, name in enumerate(("plant", "prefix", "number", "suffix"), 1)]
    return F.when((F.length(dashed) <= 32) & dashed.rlike(PATTERN), F.struct(*groups))


def _parsed(parts: Column) -> Column:
    plant, prefix, number, suffix = (parts[name] for name in ("plant", "prefix", "number", "suffix"))
    base = F.concat(F.when(plant != "", F.concat(plant, F.lit("-"))).otherwise(""), prefix, F.lit("-"), number)
    suffixes = F.filter(F.split(suffix, "/"), lambda s: s != "")
    n = F.size(suffixes)
    return F.when(
        parts.isNotNull() & ~((plant == "") & prefix.isin(*NON_TAG_PREFIXES)),
        F.struct(
            F.when(n == 1, F.concat(base, suffix)).otherwise(base).alias("canonical"),
            F.when(plant != "", plant).alias("plant"), prefix.alias("prefix"), number.alias("number"), suffixes.alias("suffixes"),
            F.when(n == 1, base).alias("parent"),
            F.when(n > 1, F.transform(suffixes, lambda s: F.concat(base, s))).otherwise(F.array().cast("array<string>")).alias("children"),
        ),
    )


def unit_slug(c: Column | str) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.upper(text_of(c)), "[^A-Z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug != "", slug)


def scoped(tag: Column, unit: Column, plant: Column | None = None) -> Column:
    """STR10: the canonical tag, under the unit's name where it carries no plant number of its own."""
    scope = F.coalesce(unit_slug(unit), unit_slug(plant)) if plant is not None else unit_slug(unit)
    return F.when(tag["plant"].isNull() & scope.isNotNull(), F.concat(scope, F.lit("/"), tag["canonical"])).otherwise(tag["canonical"])


def find_tags(c: Column | str) -> Column:
    """STR11: the canonical tags of a text, each once, in order."""
    found = F.regexp_extract_all(text_of(c), F.lit(SCAN), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda x: parse_tag(x)["canonical"]), lambda x: x.isNotNull()))
