"""Donor profile: lifetime gift statistics per partner.

Computed for all partners in one pass instead of once per partner: each gift
source is folded per partner first (partial aggregation before the
shuffle, so a partner with a third of all gifts costs no more than any other),
the partial rows are kept only for partners that exist (booked gifts) or
that exist with a known country (payment history), and the two partial sets
are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..plans.facts import history_lines, posted_lines
from ..plans.joins import lookup

TOTAL = "decimal(18,2)"


def _partials(df: DataFrame, source: str) -> DataFrame:
    return df.groupBy("partner_id").agg(
        F.min("jaar").alias("y0"),
        F.max("jaar").alias("y1"),
        F.count("partner_id").alias("n"),
        F.sum("amount").alias("s"),
        F.max("amount").alias("mx"),
    ).select("partner_id", F.lit(source).alias("bron"), "y0", "y1", "n", "s", "mx")


def profile_parts(t, partner_id: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """Partial statistics per partner and source ('erp', 'npca'), read from
    the gifts; of one partner, or of those whose ids ``only`` lists."""
    booked = posted_lines(t, codes=R.GIFT_ACCOUNTS, with_move=False, projects=False)
    booked = booked.select("partner_id", R.year_of("date").alias("jaar"), R.gift_amount().alias("amount"))
    hist = history_lines(t).select(
        "partner_id", R.year_of("date").alias("jaar"), F.col("amount").cast("decimal(16,2)").alias("amount")
    )
    if partner_id is not None:
        booked = booked.where(F.col("partner_id") == partner_id)
        hist = hist.where(F.col("partner_id") == partner_id)
    parts = _partials(booked, "erp").unionByName(_partials(hist, "npca"))
    return parts if only is None else parts.join(only, F.col("partner_id") == F.col(only.columns[0]), "left_semi")


def donor_profile(t, partner_id: int | None = None, parts: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """The profile of every donor, or of one.  ``parts`` are partial statistics
    kept elsewhere (``plans.store.ProfileStore``), so that no gift is read."""
    if parts is None:
        parts = profile_parts(t, partner_id, only)
    elif partner_id is not None:
        parts = parts.where(F.col("partner_id") == partner_id)
    # booked gifts count for every partner, payment history only with a known country
    partners = lookup(t.res_partner.select("id", "country_id"), t.res_country.select(F.col("id").alias("c_id")),
                      F.col("country_id") == F.col("c_id"), "left").select(F.col("id").alias("k_id"), F.col("c_id").isNotNull().alias("known"))
    parts = parts.join(partners, F.col("partner_id") == F.col("k_id"), "inner").where((F.col("bron") == "erp") | F.col("known"))
    agg = parts.groupBy("partner_id").agg(
        F.min("y0").alias("jaareerstegift"),
        F.max("y1").alias("jaarlaatstegift"),
        F.sum("n").alias("aantalgiften"),
        F.sum("s").alias("total"),
        F.max("mx").alias("grootstegift"),
    )
    return agg.select(
        "partner_id",
        F.col("jaareerstegift").cast("int").alias("jaareerstegift"),
        F.col("jaarlaatstegift").cast("int").alias("jaarlaatstegift"),
        (F.col("jaarlaatstegift") - F.col("jaareerstegift") + 1).cast("int").alias("jarendonateur"),
        F.col("aantalgiften").cast("bigint").alias("aantalgiften"),
        F.col("total").cast(TOTAL).alias("totaalgiften"),
        F.col("grootstegift").cast("decimal(16,2)").alias("grootstegift"),
        R.per_year("aantalgiften", "jaareerstegift", "jaarlaatstegift").alias("avggiftenperjaar"),
        R.per_year("total", "jaareerstegift", "jaarlaatstegift").alias("avgbedragperjaar"),
    )
