"""Cleaning of activity tables: numbers, units, potency, labels, deterministic deduplication."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Activity threshold in nM, property limits, and spellings of micromolar.
ACTIVE_NM, MAX_WEIGHT, MAX_LOGP = 10_000.0, 900.0, 8.0
MICROMOLAR = ("um", "µm", "micromolar", "micromole", "micromoles", "micromol")


def compound_id(written: Column) -> Column:
    """``CHEMBL`` plus digits without leading zeros, however written; null if there is none."""
    digits = F.regexp_extract(F.upper(written), r"^\s*CHEMBL[\s_:#-]*0*([1-9]\d*)\s*$", 1)
    return F.when(digits != "", F.concat(F.lit("CHEMBL"), digits))


def stripped(text: Column) -> Column:
    """Text without the blanks and tabs around it; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def compound_key(identifier: Column, structure: Column) -> Column:
    """What a record says of its compound: its identifier, else ``=`` and its structure; null if it says neither."""
    return F.coalesce(compound_id(identifier), F.concat(F.lit("="), stripped(structure)))


def both_keys(space: DataFrame, key: str, identifier: str, structure: str) -> DataFrame:
    """(compound_key, key): the two keys that records may know a registered compound by; the smallest key if several share one."""
    keys = F.array(compound_id(F.col(identifier)), F.concat(F.lit("="), stripped(F.col(structure))))
    known = space.select(F.col(key).alias("key"), F.explode(keys).alias("compound_key")).where("compound_key is not null and key is not null")
    return known.groupBy("compound_key").agg(F.min("key").alias("key"))


def number(text: Column) -> Column:
    """A plain decimal number; null where the text is anything else."""
    plain = F.regexp_extract(text, r"^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*$", 1)
    return F.when(plain != "", plain.try_cast("double"))


def mass_to_nm(value: Column, units: Column, weight: Column) -> Column:
    """ug.mL-1 to nM by molecular weight (missing or 0: null); every other unit passes unchanged."""
    return F.when(units == "ug.mL-1", value / F.nullif(weight, F.lit(0.0)) * 1e6).otherwise(value)


def micromolar_to_nm(value: Column, units: Column) -> Column:
    """A missing unit means nM."""
    return F.when(F.coalesce(F.lower(F.trim(units)), F.lit("nm")).isin(*MICROMOLAR), value * 1000).otherwise(value)


def pic50(nm: Column) -> Column:
    """-log10(mol/L); null for 0 and below."""
    return F.when(nm > 0, -F.log10(nm * 1e-9))


def flag_lt(nm: Column, threshold: float = ACTIVE_NM) -> Column:
    """``active`` strictly below the threshold; null counts as inactive."""
    return F.when(nm < threshold, "active").otherwise("inactive")


def label_ge(p: Column, threshold: float = ACTIVE_NM) -> Column:
    """1 at or above the threshold on the p scale."""
    return (p >= 9 - math.log10(threshold)).cast("int")


def own_id(identifier: Column) -> Column:
    """Prefix of custom identifiers; empty ones stay without."""
    return F.when(identifier.isNotNull() & ~identifier.isin("", "nan", "None"), F.concat(F.lit("OWN_"), identifier))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in a total order. Filtered by rank, so each map task sends one row per key."""
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def prefer_active(df: DataFrame, keys: Sequence[str], flag: str, value: str, row_id: str) -> DataFrame:
    """One row per group of equivalent structures: active first, then the lowest value (null last), then row_id."""
    active = (F.lower(F.trim(F.coalesce(F.col(flag), F.lit("")))) == "active").cast("int")
    return keep_first(df, keys, [active.desc(), F.col(value).asc_nulls_last(), F.col(row_id)])


def snake_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().replace(" ", "_") for c in df.columns])


def validation_report(df: DataFrame, structure: str, p: str) -> DataFrame:
    """One row: counts of rows, usable structures and responses, share of actives and whether the set can be modelled."""
    usable = F.col(p).isNotNull() & ~F.isnan(p)
    share = F.avg(F.when(usable, label_ge(F.col(p)).cast("double")))
    report = df.agg(F.count("*").alias("n_rows"), F.count(F.when(F.trim(structure) != "", 1)).alias("n_structures"), F.count(F.when(usable, 1)).alias("n_responses"), share.alias("active_ratio"))
    balanced = F.coalesce(F.col("active_ratio").between(0.05, 0.95), F.lit(False))
    return report.withColumn("is_balanced", balanced).withColumn("has_two_classes", F.coalesce((F.col("active_ratio") > 0) & (F.col("active_ratio") < 1), F.lit(False)))
