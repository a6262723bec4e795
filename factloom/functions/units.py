"""Units. Extraction and query use different spellings and families; they are kept apart on purpose."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import text_of
from .vocabulary import ATMOSPHERE, FAMILY_UNITS, MASS_FLOW_FACTORS, PRESSURE_FACTORS, UNIT_SPELLINGS, VOLUME_FLOW_FACTORS


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def _spellings() -> dict[str, str]:
    out = dict(UNIT_SPELLINGS)
    for units in FAMILY_UNITS.values():
        for u in units:
            if len(u) > 1:
                out.setdefault(u.lower(), u)
    return out


def _families() -> dict[str, str]:
    out: dict[str, str] = {}
    for family, units in FAMILY_UNITS.items():
        for u in units:
            out.setdefault(u, family)
    return out


def normalize_extracted(c: Column | str) -> Column:
    """STR16: the canonical spelling of a unit found by extraction."""
    u = F.regexp_replace(F.trim(text_of(c)), "[\\x20\\x09-\\x0D]+", " ")
    return F.coalesce(F.try_element_at(_map(_spellings()), F.lower(u)), u)


def extracted_family(c: Column | str) -> Column:
    """STR17: the family of such a unit: text without one, unknown for one that no family has."""
    return F.when(F.trim(text_of(c)) == "", "text").otherwise(F.coalesce(F.try_element_at(_map(_families()), normalize_extracted(c)), F.lit("unknown")))


def extracted_basis(c: Column | str) -> Column:
    """STR18: absolute or gauge, from a pressure unit's ending; empty where it says neither."""
    u = F.lower(F.regexp_replace(F.trim(text_of(c)), "[\\x20\\x09-\\x0D]+", " "))
    letter = F.regexp_extract(u, r"^(?:kg ?/ ?cm ?[2²]|kgf ?/ ?cm ?[2²]|ksc|bar|psi|kpa|mpa|atm) ?[( ]? ?([ag]) ?\)?$", 1)
    return F.when(letter == "a", "absolute").when(letter == "g", "gauge").otherwise("")


def normalize(c: Column | str) -> Column:
    """STR19: the query side's spelling: lower case, no spaces, digits for powers."""
    u = F.translate(F.regexp_replace(F.lower(F.trim(text_of(c))), " ", ""), "²³", "23")
    u = F.replace(F.replace(F.replace(u, F.lit("kgf"), F.lit("kg")), F.lit("deg"), F.lit("")), F.lit("°"), F.lit(""))
    known = {"c": "°C", "f": "°F", "k": "K", "m3/hr": "m3/h", "kg/hr": "kg/h", "m3h": "m3/h", "℃": "°C"}
    return F.coalesce(F.try_element_at(_map(known), u), u)


def basis(c: Column | str) -> Column:
    """STR19: absolute or gauge, null where the unit says neither."""
    u = F.regexp_replace(F.lower(text_of(c)), " ", "")
    absolute = (u.endswith("a") & ~u.isin("mpa", "kpa", "ata")) | u.contains("ata")
    return F.when(absolute, "absolute").when(u.endswith("g"), "gauge")


def _pressure_key(u: Column) -> Column:
    return F.when(u.isin(list(PRESSURE_FACTORS)), u).otherwise(F.regexp_replace(u, "[ag]+$", ""))


def family(c: Column | str) -> Column:
    """STR19: the family of a query-side unit."""
    u = F.lower(normalize(c))
    return (
        F.when(u == "", "unknown").when(u.isin("c", "°c", "℃", "f", "°f", "k"), "temperature").when(_pressure_key(u).isin(list(PRESSURE_FACTORS)), "pressure")
        .when(u.isin(list(VOLUME_FLOW_FACTORS)), "volumetric_flow").when(u.isin(list(MASS_FLOW_FACTORS)), "mass_flow")
        .when(u.isin("%", "percent", "vol%", "wt%"), "percentage").when(u.isin("m", "mm", "cm", "km", "ft", "in"), "length")
        .when(u == "rpm", "speed").when(u.isin("kw", "mw", "hp"), "power").otherwise("unknown")
    )


def convert(value: Column, unit: Column | str, to: Column | str, known_basis: Column | None = None) -> Column:
    """STR20: the value in another unit of the same family, unrounded; null across families.

    Pressure goes through kg/cm2, and by an atmosphere between absolute and gauge where both bases are known.
    """
    a, b = F.lower(normalize(unit)), F.lower(normalize(to))
    celsius = F.when(a.isin("°c", "c"), value).when(a.isin("°f", "f"), (value - 32) * 5 / 9).otherwise(value - 273.15)
    temperature = F.when(b.isin("°c", "c"), celsius).when(b.isin("°f", "f"), celsius * 9 / 5 + 32).otherwise(celsius + 273.15)
    factor = lambda table, u: F.try_element_at(_map(table), u)
    own = F.coalesce(F.when(known_basis != "", known_basis), basis(unit)) if known_basis is not None else basis(unit)
    shift = F.when(own.isNotNull() & basis(to).isNotNull() & (own != basis(to)), F.when(basis(to) == "gauge", -ATMOSPHERE).otherwise(ATMOSPHERE)).otherwise(0.0)
    pressure = (value * factor(PRESSURE_FACTORS, _pressure_key(a)) + shift) / factor(PRESSURE_FACTORS, _pressure_key(b))
    volume = value * factor(VOLUME_FLOW_FACTORS, a) / factor(VOLUME_FLOW_FACTORS, b)
    mass = value * factor(MASS_FLOW_FACTORS, a) / factor(MASS_FLOW_FACTORS, b)
    kind = family(unit)
    return F.when(kind == family(to), F.when(kind == "temperature", temperature).when(kind == "pressure", pressure).when(kind == "volumetric_flow", volume).when(kind == "mass_flow", mass).when(a == b, value))


def with_converted(rows: DataFrame, value: str, unit: str, to: str, name: str, known_basis: str | None = None) -> DataFrame:
    """``rows`` with ``name``, the value in unit ``to``, as ``convert`` gives it for a constant target.

    The source unit is worked out in projections of its own, once a row, so the expressions of a plan do not multiply.
    """
    target, base = _plain(to), _plain_basis(to)
    key = target if target in PRESSURE_FACTORS else target.rstrip("ag")
    out = rows.withColumn("__a", F.lower(normalize(unit))).withColumn("__p", _pressure_key(F.col("__a")))
    v = F.col(value)
    if target in ("°c", "c", "°f", "f", "k"):
        celsius = F.when(F.col("__a").isin("°c", "c"), v).when(F.col("__a").isin("°f", "f"), (v - 32) * 5 / 9).when(F.col("__a") == "k", v - 273.15)
        made = out.withColumn("__m", celsius)
        done = F.col("__m") if target in ("°c", "c") else F.col("__m") * 9 / 5 + 32 if target in ("°f", "f") else F.col("__m") + 273.15
    elif key in PRESSURE_FACTORS:
        own = F.coalesce(F.when(F.col(known_basis) != "", F.col(known_basis)), basis(unit)) if known_basis else basis(unit)
        made = out.withColumn("__b", own).withColumn("__m", v * F.try_element_at(_map(PRESSURE_FACTORS), F.col("__p")))
        shift = F.when(F.col("__b") != base, -ATMOSPHERE if base == "gauge" else ATMOSPHERE).otherwise(0.0) if base else F.lit(0.0)
        done = (F.col("__m") + F.coalesce(shift, F.lit(0.0))) / PRESSURE_FACTORS[key]
    else:
        table = next((t for t in (VOLUME_FLOW_FACTORS, MASS_FLOW_FACTORS) if target in t), None)
        made = out
        done = v * F.try_element_at(_map(table), F.col("__a")) / table[target] if table else F.when(F.col("__a") == target, v)
    return made.withColumn(name, done).drop("__a", "__p", "__b", "__m")


def _plain(unit: str) -> str:
    """A constant unit in the query side's spelling, lower case."""
    u = unit.strip().lower().replace(" ", "").replace("²", "2").replace("³", "3").replace("kgf", "kg").replace("deg", "").replace("°", "")
    return {"c": "°c", "f": "°f", "k": "k", "m3/hr": "m3/h", "kg/hr": "kg/h", "m3h": "m3/h", "℃": "°c"}.get(u, u)


def _plain_basis(unit: str) -> str | None:
    u = unit.lower().replace(" ", "")
    if (u.endswith("a") and u not in ("mpa", "kpa", "ata")) or "ata" in u:
        return "absolute"
    return "gauge" if u.endswith("g") else None


#: A fixed value: a number and a unit in running text.
QUANTITY = (
    r"(?i)(?<![\w.])(-?\d+(?:[.,]\d+)?)\s*(kg/cm2\s*[ag]?|kg/cm²\s*[ag]?|kgf/cm2|bar[ag]?|kpa|mpa|psi[ag]?|mmhg|mmwc|m3/h|m³/h|m3/hr|kg/h|kg/hr|t/h|tph|mtpa|mmtpa|"
    r"°c|deg\s*c|℃|°f|rpm|kw|mw|%|percent|mm|m)\b"
)


def find_quantities(c: Column | str) -> Column:
    """STR21: array of struct(value, unit, basis)."""
    at = lambda k: F.regexp_extract_all(text_of(c), F.lit(QUANTITY), F.lit(k))
    return F.transform(F.arrays_zip(at(1).alias("v"), at(2).alias("u")), lambda x: F.struct(
        F.replace(x["v"], F.lit(","), F.lit(".")).cast("double").alias("value"), normalize(F.regexp_replace(x["u"], "\\s+", "")).alias("unit"), basis(x["u"]).alias("basis")))
