"""Mixing sources to target weights by temperature.

With token shares p of the sources, the mixture takes weights proportional to
p**a.  A smaller exponent a flattens the mixture.  ``a`` is bisected

* to the smallest value at which no source is read more than ``max_repeats``
  times (``target_entropy`` None), or
* to the value at which the mixture's entropy (nats) is ``target_entropy``;
  beyond what a in [0, 1] can reach, the nearer end.

The budget is the smallest at which no source is cut: the source least
favoured is read exactly once, every other one ``repeats`` >= 1 times.  Whole
passes take every document; the last, partial pass takes blocks of documents,
in a permutation of the source's blocks drawn anew, until the budget is met
(the block that crosses it is still taken).

Everything is DataFrame operations; only one row of sums per bisection round
reaches the driver.

Defined results: a null source is a source of its own; texts without words
have no tokens, and every row is in each whole pass; repeated rows are rows
of their own; an empty table gives an empty mixture.  Sources without any
token get weight 0 and one pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlens.llm.common import WORD, written

ROUND_CUTS = 16  # bisection points tried in one job (four halvings)


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    """(source, tokens, rows_in) per source; a hot source is summed map-side."""
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows_in"))


def _moments(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(largest number of repeats, entropy) of each exponent, in one job."""
    log_p = F.log("share")
    cols = []
    for k, a in enumerate(exponents):
        cols += [F.sum(F.exp(log_p * a)).alias(f"z{k}"), F.sum(F.exp(log_p * a) * log_p * a).alias(f"e{k}")]
    row = shares.where("share > 0").agg(F.min("share").alias("least"), F.max("share").alias("most"), *cols).first()
    if row["least"] is None:
        return [(1.0, 0.0)] * len(exponents)
    spread = row["most"] / row["least"]
    return [(spread ** (1 - a), math.log(row[f"z{k}"]) - row[f"e{k}"] / row[f"z{k}"]) for k, a in enumerate(exponents)]


def bisect_exponent(shares: DataFrame, max_repeats: float = 2.0, target_entropy: float | None = None, rounds: int = 8) -> float:
    """The exponent in [0, 1]: repeats and entropy both fall as it grows."""
    def high_enough(repeats: float, entropy: float) -> bool:
        return repeats <= max_repeats if target_entropy is None else entropy <= target_entropy

    low, high = 0.0, 1.0
    if high_enough(*_moments(shares, [0.0])[0]):
        return 0.0
    for _ in range(rounds):
        cuts = [low + (high - low) * k / ROUND_CUTS for k in range(1, ROUND_CUTS)]
        for a, moment in zip(cuts, _moments(shares, cuts), strict=True):
            if high_enough(*moment):
                high = a
                break
            low = a
        else:
            low = cuts[-1]
    return high


def plan(docs: DataFrame, max_repeats: float, target_entropy: float | None, block_tokens: int) -> DataFrame:
    """Per source: tokens, share, weight, repeats (budget / tokens), blocks."""
    totals = written(source_totals(docs), "source-totals")
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.withColumn("share", F.col("tokens") / F.lit(float(max(everything, 1))))
    a = bisect_exponent(shares, max_repeats, target_entropy)
    scaled = F.when(F.col("share") > 0, F.pow("share", F.lit(a))).otherwise(0.0)
    sums = shares.agg(F.sum(scaled).alias("z"), F.max("share").alias("most")).first()
    z, most = sums["z"] or 1.0, sums["most"] or 1.0
    weight = scaled / F.lit(z)
    repeats = F.when(F.col("share") > 0, F.pow(F.col("share") / F.lit(most), F.lit(a - 1.0))).otherwise(1.0)
    return shares.select(
        "source", "tokens", "rows_in", "share", weight.alias("weight"), F.lit(a).alias("exponent"), repeats.alias("repeats"),
        F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).alias("n_blocks"))


def mix(docs: DataFrame, max_repeats: float = 2.0, target_entropy: float | None = None, block_tokens: int = 20_000, seed: int = 17) -> DataFrame:
    """Per input row: the input columns and ``n_tokens``, ``weight`` (target
    of its source), ``repeats`` and ``copies`` (times it is taken); these four
    replace input columns of the same name."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source").cast("string").alias("source"),
                       F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("text_hash"), token_count().alias("n_tokens"))
    plans = written(plan(rows.select("source", "n_tokens"), max_repeats, target_entropy, block_tokens), "mixing-plan")
    plans = written(_with_last_block(rows, plans, seed), "mixing-cuts")  # one row a source
    rows = rows.join(plans.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source")), "left")
    taken = _place(seed) <= F.col("last")
    copies = (F.floor("repeats") + F.coalesce(taken, F.lit(False)).cast("int")).cast("long")
    added = {"n_tokens", "weight", "repeats", "copies"}
    return rows.select(*[F.col(f"row.`{c}`") for c in names if c not in added], "n_tokens", "weight", "repeats", copies.alias("copies"))


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "id", "text_hash"), F.col("n_blocks"))


def _place(seed: int, block: Column | None = None) -> Column:
    """Place of a block in the permutation of the partial pass: (bin, key, block)."""
    block = _block(seed) if block is None else block
    key = F.xxhash64(F.lit(seed), F.floor("repeats"), "source", block)
    return F.struct(F.shiftrightunsigned(key, 54).alias("bin"), key.alias("key"), block.alias("block"))


def _with_last_block(rows: DataFrame, plans: DataFrame, seed: int) -> DataFrame:
    """``plans`` with ``last``, the place of the last block that the partial
    pass of a source takes (null: none).

    The running sum over a source's permuted blocks goes through the 1024
    bins of the places, so that no source's blocks meet in one task."""
    plan_of = plans.select(F.col("source").alias("plan_source"), "tokens", "repeats", "n_blocks")
    sums = (rows.join(plan_of, F.col("source").eqNullSafe(F.col("plan_source")))
            .groupBy("source", "tokens", "repeats", _block(seed).alias("block")).agg(F.sum("n_tokens").alias("block_tokens")))
    blocks = sums.select("source", "block_tokens", _place(seed, F.col("block")).alias("place"),
                         ((F.col("repeats") - F.floor("repeats")) * F.col("tokens")).alias("budget"))
    blocks = blocks.withColumn("bin", F.col("place.bin"))
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (blocks.groupBy("source", "bin").agg(F.sum("block_tokens").alias("bin_tokens"))
            .select(F.col("source").alias("bin_source"), F.col("bin").alias("bin_no"), F.coalesce(F.sum("bin_tokens").over(earlier), F.lit(0)).alias("before_bin")))
    inside = Window.partitionBy("source", "bin").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = (blocks.withColumn("within", F.coalesce(F.sum("block_tokens").over(inside), F.lit(0)))
            .join(bins, F.col("source").eqNullSafe(F.col("bin_source")) & (F.col("bin") == F.col("bin_no")))
            .where(F.col("before_bin") + F.col("within") < F.col("budget") - 1e-6)
            .groupBy("source").agg(F.max("place").alias("last")).select(F.col("source").alias("last_source"), "last"))
    return plans.join(last, F.col("source").eqNullSafe(F.col("last_source")), "left").drop("last_source")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row as often as it is taken, input columns only."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "text")
    taken = mix(rows, **options)
    return (taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
            .select(*[F.col(f"row.`{c}`") for c in docs.columns]))
