"""Joins on bit masks, written as equi-joins on the single bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LAST_BIT = 63  # of a long; negative masks have it set
NO_BIT = -1


def _bits(mask: str):
    """Positions of the set bits, lowest first."""
    value = F.col(mask).cast("long")
    return F.filter(F.sequence(F.lit(0), F.lit(LAST_BIT)), lambda i: F.getbit(value, i) == 1)


def covering_pairs(masks: DataFrame, mask: str, lookup: DataFrame, bits: str) -> DataFrame:
    """(mask, lookup row) pairs where the lookup's bits contain every bit of the mask.

    A mask meets the lookup rows that have its lowest bit, and the plain test decides. Mask 0 is
    covered by every row; it alone meets them under a key of its own. Works on the distinct masks.
    NULL masks and NULL lookup bits match nothing; repeated lookup rows all match.
    """
    wanted = masks.select(mask).where(F.col(mask).isNotNull()).distinct()
    left = wanted.select(mask, F.coalesce(F.get(_bits(mask), F.lit(0)), F.lit(NO_BIT)).alias("_bit"))
    keyed = lookup.where(F.col(bits).isNotNull()).select(
        F.struct(*lookup.columns).alias("_row"), F.col(bits).cast("long").alias("_has"), _bits(bits).alias("_at")
    )
    right = keyed.select("_row", "_has", F.explode(F.concat(F.array(F.lit(NO_BIT)), "_at")).alias("_bit"))
    wants = F.col(mask).cast("long")
    met = left.join(right, "_bit").where(F.col("_has").bitwiseAND(wants) == wants)
    return met.select(mask, "_row.*")


def join_covering(
    df: DataFrame, mask: str, lookup: DataFrame, bits: str, domain: DataFrame | None = None
) -> DataFrame:
    """Inner join on ``lookup.bits & mask = mask``.

    ``domain`` names a cheaper frame that holds every mask ``df`` can have.
    """
    return df.join(covering_pairs(df if domain is None else domain, mask, lookup, bits), mask)
