"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with weight w gets the mean repetition rate ``w * total / size of the source``, so that the expected share of
the mixture is w while its expected size stays that of the input.  A document's count is the Poisson quantile of a
uniform number that a hash of the seed and its id gives: the same in every run, on any cluster, for any partitioning.
Each document is exploded by its count and the copies are dealt out by a hash.  A document of a tiny source may have any
number of copies, so it is exploded in steps of bounded size: its rate into parts, then each part by its own count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, saved

CHUNK = 16.0  # a rate above this is the sum of equal parts below it, each with a hash of its own
DIGITS = 13  # hexadecimal digits of a hash in a uniform number: 52 bits
TERMS = 96  # thresholds of the distribution, the most copies of a part; beyond, P < 1e-40 at rate 16
RUN = 4_096  # parts that a row is exploded into at once
PARTITION = 128 << 20  # bytes of the mixture that are dealt to a partition


def hashed(digits: int, *parts: Column) -> Column:
    """The first hexadecimal digits of an md5, which any SQL engine can repeat, as a LONG."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """In [0, 1)."""
    return hashed(DIGITS, *parts).cast("double") / float(16**DIGITS)


def thresholds(rate: Column) -> Column:
    """P(X <= k) for k from 0, as an array."""
    step = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), (acc["c"] + acc["p"] * rate / k).alias("c"), F.concat(acc["all"], F.array(acc["c"] + acc["p"] * rate / k)).alias("all"))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda k: k.cast("double")), start, step, lambda acc: acc["all"])


def rates(df: DataFrame, source: Column, amount: Column, weights: dict[str, float] | None, temperature: float) -> DataFrame:
    """A row for each source: _source, _rate.

    ``weights`` names target weights (sources without one get none of the mixture); without them a source's weight is
    its size to the power ``temperature``: 1 keeps the proportions, 0 makes all sources equal.
    """
    sizes = df.groupBy(source.alias("_source")).agg(F.sum(amount).cast("double").alias("_size"))
    if weights is None:
        weight = F.pow(F.col("_size"), F.lit(float(temperature)))
    else:
        if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
            raise ValueError("weights must be at least 0 and not all 0")
        pairs = [F.lit(x) for k, w in weights.items() for x in (k, float(w))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("_source")), F.lit(0.0))
    all_sizes, all_weights = F.sum("_size").over(Window.partitionBy()), F.sum("_weight").over(Window.partitionBy())  # a row a source
    sized = sizes.filter("_size > 0").withColumn("_weight", weight)
    rated = sized.withColumn("_rate", F.when(all_weights > 0, F.col("_weight") / all_weights * all_sizes / F.col("_size")).otherwise(0.0))
    parts = F.greatest(F.ceil(F.col("_rate") / CHUNK), F.lit(1)).cast("long")
    return rated.select("_source", "_size", "_rate", parts.alias("_parts"), thresholds(F.col("_rate") / parts).alias("_cdf"))


def replicate(df: DataFrame, *, weights: dict[str, float] | None = None, temperature: float = 0.5, seed: int = 7, source: str = "source", text: str = "text", doc_id: str = "doc_id", told: bool = False) -> DataFrame:
    """Each document as often as its Poisson count says, dealt out over all partitions in an order that hashes give.

    Returns the columns of ``df``; with ``told`` also ``copy`` (from 1; at a rate above 16 the numbers have gaps) and ``deal``
    (48 bits that give the order).  The size of a document is its bytes plus 1, so empty and null texts count a little.  Null
    sources are one source.  Repeated rows have equal counts.  No rows give no rows.
    """
    counted, total = _drawn(df, weights, temperature, seed, source, text, doc_id)
    number = F.col("_part") * TERMS + F.col("_k")
    copies = counted.filter("_n > 0").select("_doc", "_id", "_part", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k")).withColumn("_copy", F.when(number < 1 << 31, number.cast("int")).otherwise(F.raise_error(F.lit("more copies of a document than an int counts")).cast("int")))
    dealt = copies.withColumn("_deal", hashed(12, F.lit(seed), F.col("_id"), F.lit("deal"), F.col("_copy")))
    width = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // PARTITION))
    mixed = dealt.repartition(width, "_deal").sortWithinPartitions("_deal")
    if not told:
        return mixed.select("_doc.*")
    rest = [F.col(f"_doc.`{c}`").alias(c) for c in df.columns if c not in ("copy", "deal")]  # these two names mean its own
    return mixed.select(*rest, F.col("_copy").alias("copy"), F.col("_deal").alias("deal"))


def copy_counts(df: DataFrame, *, weights: dict[str, float] | None = None, temperature: float = 0.5, seed: int = 7, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, source, rate, n_copies) of every row, 0 copies included."""
    drawn, _ = _drawn(df.select(source, text, doc_id), weights, temperature, seed, source, text, doc_id)
    parts = drawn.groupBy("_id", "_source", "_part").agg(F.max("_rate").alias("_rate"), F.max("_n").alias("_n"))
    each = parts.groupBy("_id", "_source").agg(F.round(F.max("_rate"), 9).alias("rate"), F.sum("_n").alias("n_copies"))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _source_name(source).alias("name"))
    joined = rows.join(each, rows["doc_id"].eqNullSafe(each["_id"]) & (rows["name"] == each["_source"]), "left")
    return joined.select(F.col("doc_id").alias(doc_id), F.col("source").alias(source), "rate", F.coalesce("n_copies", F.lit(0)).alias("n_copies"))


def _source_name(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def _drawn(df: DataFrame, weights: dict[str, float] | None, temperature: float, seed: int, source: str, text: str, doc_id: str) -> tuple[DataFrame, float]:
    """A row for each part of each document's rate with its count _n, and the expected size of the mixture."""
    name = _source_name(source)
    named = None if weights is None else {f"={k}": w for k, w in weights.items()}
    amount = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 1
    table = saved(rates(df, name, amount, named, temperature))
    sources, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_size") * F.col("_rate")), F.lit(0.0))).first()
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_doc"), name.alias("_source"), F.col(doc_id).alias("_id"))
    joined = rows.join(F.broadcast(table) if sources <= 10_000 else table, "_source")  # a row takes about a kilobyte
    runs = joined.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("_parts") - 1, F.lit(RUN)))))
    last = F.least(F.col("_run") * RUN + RUN, F.col("_parts")) - 1
    parts = runs.withColumn("_part", F.explode(F.sequence(F.col("_run") * RUN, last)))
    drawn = F.aggregate(F.col("_cdf"), F.struct(F.lit(0).alias("n"), uniform(F.lit(seed), F.col("_id"), F.col("_part")).alias("u")), lambda a, c: F.struct((a["n"] + (a["u"] >= c).cast("int")).alias("n"), a["u"].alias("u")), lambda a: a["n"])
    return parts.withColumn("_n", drawn), total


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture in which sources weigh as the square root of their bytes: every copy, with its place in the order."""
    return replicate(documents(spark, sf_dir), told=True)


OP5_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(SUM(coalesce(strlen(text), 0) + 1) AS DOUBLE) AS size FROM documents GROUP BY source
), rated AS (
  SELECT source, sqrt(size) / SUM(sqrt(size)) OVER () * SUM(size) OVER () / size AS rate FROM sizes
), cdf(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rated
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < {TERMS}
), sorted AS (
  SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source
), counted AS (
  SELECT d.*, len(list_filter(cs, lambda c: u >= c)) AS n FROM (
    SELECT *, CAST(concat('0x', substr(md5(concat('7:', doc_id, ':0')), 1, {DIGITS})) AS BIGINT) / {float(16**DIGITS)!r} AS u FROM documents
  ) d JOIN sorted ON sorted.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, CAST(concat('0x', substr(md5(concat('7:', doc_id, ':deal:', copy)), 1, 12)) AS BIGINT) AS deal
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted)
"""
