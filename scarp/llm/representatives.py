"""Best representative of each group of duplicate records.

Records are ranked with window ordering (trust, recency, a deterministic last
tie-break) and the top row of each group and field is kept. A filter on rank 1
lets Spark cut every map task's rows to one per group before the shuffle, so a
compound with a third of all records costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.preparation import compound_id, compound_key, stripped

#: Readings at or beyond this are stand-ins (-999, 99.99), not pIC50 values on any scale.
STAND_IN_LIMIT = 50.0

FIELDS = ("activity_flag", "standard_value", "pic50")


def flag_class(written: Column) -> Column:
    """1 for active, 0 for inactive in any spelling, null for everything else."""
    t = F.regexp_replace(F.lower(F.trim(written)), r"[\s._-]+", "")
    return F.when(t.rlike("^(?:active|act|1)$"), 1).when(t.rlike("^(?:inactive|inact|(?:not|non)act(?:ive)?|0)$"), 0)


def usable(field: str) -> Column:
    """Whether a record has a usable reading of one of FIELDS."""
    if field == "activity_flag":
        return flag_class(F.col(field)).isNotNull()
    number = F.col(field).isNotNull() & ~F.isnan(field)
    return number & ((F.col(field) > 0) if field == "standard_value" else (F.abs(field) < STAND_IN_LIMIT))


def _order() -> list[Column]:
    return [F.col("trust_rank").asc_nulls_last(), F.col("curated_at").desc_nulls_last(), F.col("record_id").asc_nulls_last()]


def _trusted(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Records with the trust rank of their source (one row per source, so it is broadcast)."""
    # The list of sources is fixed by those who curate the records; it does not grow with them.
    trust = sources.groupBy("source_name").agg(F.min("trust_rank").alias("trust_rank"))
    return records.join(F.broadcast(trust), "source_name", "left")


def _raw_key() -> Column:
    """The compound as far as the record itself says: its identifier, else its structure."""
    return compound_key(F.col("chembl_id"), F.col("canonical_smiles"))


def _compounds(keyed: DataFrame, space: DataFrame) -> DataFrame:
    """Replace structure keys by the identifier that the registry gives; one row per key and field comes in, so no key is hot."""
    registry = (
        space.select(F.concat(F.lit("="), stripped(F.col("canonical_smiles"))).alias("raw_key"), compound_id(F.col("chembl_id")).alias("found"))
        .where("found is not null")
        .groupBy("raw_key")
        .agg(F.min("found").alias("found"))
    )
    named = keyed.where(~F.col("raw_key").startswith("=")).withColumn("compound", F.col("raw_key"))
    unnamed = keyed.where(F.col("raw_key").startswith("=")).join(registry, "raw_key", "left").withColumn("compound", F.coalesce("found", "raw_key")).drop("found")
    return named.unionByName(unnamed)


def best_readings(records: DataFrame, space: DataFrame, sources: DataFrame) -> DataFrame:
    """(compound, chembl_id, field_name, record_id, reading) of the surviving reading of each field.

    Lowest trust rank wins (no or unknown source: last), then the latest curated_at (null: last),
    then the smallest record_id. Compounds with one record_id only, records with neither
    identifier nor structure and fields without a usable reading give no row; exact repeats
    change nothing. A structure that the registry does not know forms a compound without chembl_id.
    """
    base = _trusted(records, sources).withColumn("raw_key", _raw_key()).where("raw_key is not null and record_id is not null")
    readings = base.select(
        "raw_key",
        "trust_rank",
        "curated_at",
        "record_id",
        F.explode(F.filter(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("reading"), usable(f).alias("ok")) for f in FIELDS]), lambda x: x.ok)).alias("f"),
    ).select("raw_key", "trust_rank", "curated_at", "record_id", "f.field_name", "f.reading")
    rank = F.row_number().over(W.partitionBy("raw_key", "field_name").orderBy(*_order()))
    first = readings.withColumn("rank", rank).where("rank = 1").drop("rank")
    ids = base.groupBy("raw_key").agg(F.min("record_id").alias("lo"), F.max("record_id").alias("hi"))
    several = _compounds(ids, space).groupBy("compound").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("compound")
    rank = F.row_number().over(W.partitionBy("compound", "field_name").orderBy(*_order()))
    best = _compounds(first, space).withColumn("rank", rank).where("rank = 1")
    chembl = F.when(~F.col("compound").startswith("="), F.col("compound"))
    return best.join(several, "compound", "left_semi").select("compound", chembl.alias("chembl_id"), "field_name", "record_id", "reading")


def merged_records(records: DataFrame, space: DataFrame, sources: DataFrame) -> DataFrame:
    """One built record per compound: each field from its best record, with the record that supplied it."""
    best = best_readings(records, space, sources)
    pick = lambda field, col: F.max(F.when(F.col("field_name") == field, F.col(col)))
    return best.groupBy("compound").agg(
        F.max("chembl_id").alias("chembl_id"),
        F.max(F.when(F.col("field_name") == "activity_flag", flag_class(F.col("reading")))).alias("is_active"),
        pick("standard_value", "reading").cast("double").alias("standard_value"),
        pick("pic50", "reading").cast("double").alias("pic50"),
        *[pick(f, "record_id").alias(f"{f}_from") for f in FIELDS],
    )


def top_records(records: DataFrame, space: DataFrame, sources: DataFrame) -> DataFrame:
    """One whole record per compound: most usable fields first, then trust, recency, record_id."""
    complete = sum(usable(f).cast("int") for f in FIELDS)
    base = _trusted(records, sources).withColumn("raw_key", _raw_key()).where("raw_key is not null and record_id is not null")
    slim = base.select("raw_key", complete.alias("n_usable"), "trust_rank", "curated_at", "record_id")
    order = [F.col("n_usable").desc(), *_order()]
    first = slim.withColumn("rank", F.row_number().over(W.partitionBy("raw_key").orderBy(*order))).where("rank = 1").drop("rank")
    best = _compounds(first, space).withColumn("rank", F.row_number().over(W.partitionBy("compound").orderBy(*order))).where("rank = 1")
    return best.select("compound", "record_id", F.col("n_usable").cast("int").alias("n_usable"))
