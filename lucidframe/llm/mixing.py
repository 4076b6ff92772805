"""Mixing sources to target weights by Poisson replication.

Each source s has a rate r_s = target weight x output size / rows of s. A row's count is a Poisson(r_s)
variable, obtained by inverting its distribution function at a uniform number hashed from seed and id:
no state, any order, the same on every retry. Rows are then exploded by count and shuffled globally: a
row goes to the partition its random key names, and each partition is sorted by that key, so
reading the partitions in order is one random permutation.

Statistics (rows by source) cover all rows; the per-source table holds one row a source.

Defined results: a null source is a source of its own; a null id hashes like the empty string; rows that
repeat an id get the same count; null, empty and very long texts are mixed like any other; rows of equal random keys (a tie) lie in any order; an empty table gives an
empty table; sources missing from given weights, or of weight 0, get rate 0 and leave no rows. Extra columns pass through, and
internal names are chosen not to clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidframe.llm.common import c, ensure_workers, fresh, shuffle_partitions

SEED = "mix-1"
BROADCAST_SOURCES = 2_000  # the table of sources is broadcast up to this many rows
ALPHA = 0.5  # target weight of a source where none are given: rows ** ALPHA


def uniform(seed: str, key) -> F.Column:
    """52 hash bits as a number in (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), key)), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def cumulated(rate: float) -> np.ndarray:
    """P(X <= k) of a Poisson variable for k = 0, 1, ... as far as 12 standard deviations beyond the mean; P(X <= 0) = 1 at rate 0."""
    if not rate > 0:
        return np.ones(1)
    k = np.arange(math.ceil(rate + 12 * math.sqrt(rate) + 20) + 1, dtype=float)
    # log-space terms, so that large means don't underflow
    return np.cumsum(np.exp(k * math.log(rate) - rate - np.cumsum(np.log(np.maximum(k, 1)))))


def poisson_cdf(rate: F.Column) -> F.Column:
    @F.pandas_udf("array<double>")
    def run(rates: pd.Series) -> pd.Series:  # a row a source
        return rates.map(cumulated)

    return run(rate)


def rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, size: float = 1.0, alpha: float = ALPHA) -> DataFrame:
    """One row a source: source, rows, rate, cdf. size: rows of the output as a multiple of the input's."""
    per = docs.groupBy(c(source).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        weight = F.pow(F.col("rows").cast("double"), F.lit(alpha))
    else:
        pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    per = per.withColumn("weight", weight)
    total = per.agg(F.sum("rows").alias("n"), F.sum("weight").alias("w"))
    per = per.crossJoin(F.broadcast(total))  # one row
    rate = F.when(F.col("weight") > 0, F.col("weight") / F.col("w") * F.col("n") * F.lit(float(size)) / F.col("rows")).otherwise(F.lit(0.0))
    per = per.withColumn("rate", rate)
    return per.select("source", "rows", "rate", poisson_cdf(F.col("rate")).alias("cdf"))


def poisson_mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: dict[str, float] | None = None, size: float = 1.0, alpha: float = ALPHA, seed: str = SEED, copy_col: str | None = "copy") -> DataFrame:
    """docs replicated to the target weights and shuffled; copy_col, if given, numbers a row's copies from 0."""
    spark = docs.sparkSession
    ensure_workers(spark)
    n_src, n_cdf, n_copy, n_key, n_u = fresh(docs, "mix_source", "mix_cdf", "mix_copy", "mix_key", "mix_u")
    per = rates(docs, source, weights, size, alpha).select(F.col("source").alias(n_src), F.col("cdf").alias(n_cdf))
    known = per.limit(BROADCAST_SOURCES + 1).collect()
    if len(known) <= BROADCAST_SOURCES:  # else a shuffled join, whose hot sources AQE splits
        per = F.broadcast(spark.createDataFrame(known, per.schema))
    key = F.coalesce(c(id_col).cast("string"), F.lit(""))
    joined = docs.withColumn(n_u, uniform(seed, key)).join(per, c(source).eqNullSafe(c(n_src)))
    times = F.size(F.filter(c(n_cdf), lambda x: x <= c(n_u)))
    copies = joined.withColumn(n_copy, F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1))))
    spread = F.xxhash64(F.lit(seed), c(id_col), c(n_copy), c(text) if text in docs.columns else F.lit(""))
    copies = copies.select(*[c(x) for x in docs.columns], c(n_copy), spread.alias(n_key))
    mixed = copies.repartition(shuffle_partitions(spark), c(n_key)).sortWithinPartitions(c(n_key))
    out = [c(x) for x in docs.columns]
    if copy_col:
        out.append(c(n_copy).alias(fresh(docs, copy_col)[0]))
    return mixed.select(*out)


ORACLE_SQL = f"""
WITH per AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {ALPHA}) AS w FROM documents GROUP BY source),
tot AS (SELECT sum(n)::BIGINT AS n, sum(w) AS w FROM per),
rate AS (SELECT per.source, per.w / tot.w * tot.n * 1.0::DOUBLE / per.n AS r FROM per, tot),
terms AS (SELECT source, r, k, exp(k * ln(r) - r - CASE WHEN k < 2 THEN 0.0 ELSE lgamma(k + 1.0) END) AS p FROM rate, range(0, 200) t(k) WHERE k <= ceil(r + 12 * sqrt(r) + 20)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM terms),
u AS (SELECT *, (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents)
SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, cdf.k::INTEGER AS copy
FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.below <= u.u
"""
