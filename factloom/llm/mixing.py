"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with target weight w and size s (bytes of text) is to be repeated T * w / s times on average, T being the
size of the mix. Each document's number of copies is a Poisson number with that mean, found by inverting the
distribution at a point of [0, 1) that a hash of seed and document id gives: the same document always gets the same
number, whatever the partitioning or a retry. A large mean is the sum of equal parts, each drawn at a point of its own
(a sum of independent Poisson numbers is one). Copies are exploded and dealt out by a hash of seed, id and copy, then
sorted by it inside each partition: a uniform global shuffle in one exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_sizes, own_names, same, table, unit_interval

#: Up to so many sources, the table of rates is broadcast (about 1 KB a row, at most 7); beyond, it is joined with hot sources dealt by document.
BROADCAST_SOURCES = 5_000
#: The largest mean of one draw: beyond it exp(-mean) nears the end of double precision, so a larger rate is drawn in parts.
MAX_RATE = 500.0
#: Parts and copies are listed in blocks of so many, so that no array grows with the rate.
BLOCK = 1_000


def rates(df: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, rate, parts, cdf): each source's mean repetition rate, in how many equal parts it is drawn, and a part's Poisson distribution function.

    Without ``weights``, a source's weight is its size to the power ``temperature``. The mix has ``epochs`` times
    the input's bytes. A source that ``weights`` does not name gets weight 0; one without any text has rate 1.
    """
    # Written once: a row a source, read for the totals and for the rates, so the texts are not measured again.
    sizes = cut(df.groupBy(F.col("source").alias("__source")).agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).alias("__size")))
    if weights is None:
        weight = F.sqrt(F.col("__size").cast("double")) if temperature == 0.5 else F.pow(F.col("__size").cast("double"), F.lit(float(temperature)))
    elif not weights or min(weights.values()) < 0:
        raise ValueError("weights must be given and not be negative")
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(same(F.col("__source"), F.lit(name)), float(value)).otherwise(weight)
    weighed = sizes.withColumn("__weight", weight)
    total = weighed.agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("size"), F.coalesce(F.sum("__weight"), F.lit(0.0)).alias("weight")).first()
    rate = F.when(F.col("__size") == 0, 1.0).otherwise(F.lit(float(total.size) * epochs) * F.col("__weight") / F.lit(total.weight or 1.0) / F.col("__size"))
    out = weighed.select("__source", "__size", rate.alias("__rate"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("__rate") / F.lit(MAX_RATE))).cast("long")
    return out.withColumn("__parts", parts).withColumn("__mean", F.col("__rate") / F.col("__parts")).withColumn("__cdf", F.expr(
        """aggregate(sequence(1, cast(ceil(__mean + 12 * sqrt(__mean) + 20) as int)),
                     struct(array(exp(-__mean)) as cdf, exp(-__mean) as p),
                     (a, k) -> struct(concat(a.cdf, array(element_at(a.cdf, -1) + a.p * __mean / k)) as cdf, a.p * __mean / k as p),
                     a -> a.cdf)"""
    )).drop("__mean")


def blocks(n: Column) -> Column:
    """The numbers of the blocks that 1 to ``n`` lie in, from 0."""
    return F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / F.lit(BLOCK)))


def block(k: Column, n: Column) -> Column:
    """The numbers of block ``k`` of 1 to ``n``."""
    return F.sequence(k * BLOCK + 1, F.least(n, (k + 1) * BLOCK))


def draws(seed: str, parts: Column, cdf: Column, point: Column) -> Column:
    """How many copies a row with its source's rate gets: the first part is drawn at ``point``, the hash of seed and id, part k at that of seed, id and k."""
    at = lambda u: F.size(F.filter(cdf, lambda c: c <= u)).cast("long")
    part = lambda k: F.when(k == 1, at(point)).otherwise(at(unit_interval(F.lit(seed), F.col("doc_id"), k)))
    zero = F.lit(0).cast("long")
    several = F.aggregate(blocks(parts), zero, lambda a, b: a + F.aggregate(block(b, parts), zero, lambda n, k: n + part(k)))
    return F.when(parts == 1, at(point)).otherwise(several)


def mix(df: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: str = "mix-1", copy_name: str = "copy", n_copies_name: str = "n_copies") -> DataFrame:
    """The mixed rows: all columns of ``df``, the copy's number from 1, and how many copies its document has.

    A null source is a source of its own. Null texts have no bytes. Rows with one id (or null ids) of one source share
    their number of copies. No rate is too large: a tiny source beside a huge one is repeated as often as its weight
    says. Columns with the names of the two numbers are replaced by them, so give other names to keep those. An empty
    table gives an empty table.
    """
    name = own_names(df)
    inner = [name(c) for c in ("source", "size", "rate", "parts", "cdf")]
    source, _, _, parts, cdf = inner
    number, point, n, at, copy, order = (name(c) for c in ("name", "point", "n", "block", "copy", "order"))
    table_of_rates = rates(df, weights, temperature, epochs).toDF(*inner)
    few = len(table_of_rates.select(source).limit(BROADCAST_SOURCES + 1).collect()) <= BROADCAST_SOURCES
    if few:
        rated = df.join(F.broadcast(table_of_rates), same(F.col("source"), F.col(source)))
    else:
        named = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("null"))
        rated = join_sizes(df.withColumn(number, named("source")), number, "doc_id", table_of_rates.select(named(source).alias(number), name("size"), parts, cdf)).drop(number)
    drawn = rated.withColumn(point, unit_interval(F.lit(seed), F.col("doc_id")))
    counted = drawn.withColumn(n, draws(seed, F.col(parts), F.col(cdf), F.col(point))).drop(point, *inner)
    listed = counted.where(F.col(n) > 0).withColumn(at, F.explode(blocks(F.col(n))))
    copies = listed.withColumn(copy, F.explode(block(F.col(at), F.col(n)))).drop(at)
    keyed = copies.withColumn(order, F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(copy).cast("string"))))
    shuffled = keyed.repartition(F.col(order)).sortWithinPartitions(order)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (copy_name, n_copies_name)]
    return shuffled.select(*kept, F.col(copy).cast("long").alias(copy_name), F.col(n).cast("long").alias(n_copies_name))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed so that a source counts with the square root of its bytes, to one epoch's bytes in all."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


OP9_SQL = r"""
WITH sizes AS (SELECT source, sum(strlen(coalesce(text, '')))::BIGINT AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN size = 0 THEN 1.0 ELSE (SELECT sum(size) FROM sizes)::DOUBLE * sqrt(size::DOUBLE)
                 / (SELECT sum(sqrt(size::DOUBLE)) FROM sizes) / size END AS rate FROM sizes),
cdf AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM rates, range(0, 200) AS t(k)),
points AS (
  SELECT doc_id, text, lang, source,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents),
counted AS (
  SELECT p.doc_id, p.text, p.lang, p.source, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM p.source AND c.c <= p.u) AS n
  FROM points p)
SELECT doc_id, text, lang, source, unnest(range(1, n + 1))::BIGINT AS copy, n::BIGINT AS n_copies FROM counted
"""

QUERIES: dict[str, Callable] = {"op9_mixing": op9_mixing}
SQL: dict[str, str] = {"op9_mixing": OP9_SQL}
