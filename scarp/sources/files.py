"""Readers and writers at the edges: delimited text, own compounds, lists, libraries, resumable stages."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import preparation as P

# Columns of an own-compound file and other spellings of their headers.
OWN_SCHEMA = "ID string, SMILES string, activity_flag string, standard_value string, standard_units string"
#: Column that holds a line which does not fit the schema.
BAD = "__bad_line"
ALIASES = {"chembl_id": "ID", "canonical_smiles": "SMILES", "smiles": "SMILES", "id": "ID", "value": "standard_value", "units": "standard_units", "flag": "activity_flag"}


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A delimited file with a header and a given schema, quotes doubled inside; lines that do not fit are left to ``read_rejects``."""
    rows = _permissive(spark, path, schema, sep)
    return rows.where(F.col(BAD).isNull() | (_parsed(rows) < 0)).drop(BAD)


def read_rejects(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """(line): the lines of a delimited file that ``read_csv`` leaves out, so that none is lost unseen."""
    rows = _permissive(spark, path, schema, sep)
    return rows.where(F.col(BAD).isNotNull() & (_parsed(rows) >= 0)).select(F.col(BAD).alias("line"))


def _parsed(rows: DataFrame) -> Column:
    """The number of columns, as an expression that needs them all: a line is only known to be bad once all of it is parsed."""
    return F.size(F.array(*[F.col(c).cast("string") for c in rows.columns]))


def _permissive(spark: SparkSession, path: str, schema: str, sep: str) -> DataFrame:
    return spark.read.schema(f"{schema}, `{BAD}` string").option("header", True).option("sep", sep).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).csv(path)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the paths that is there, in the order given."""
    for path in paths:
        try:
            spark.read.format("binaryFile").load(path)
        except AnalysisException:
            continue
        return path
    return None


def read_config(spark: SparkSession, path: str) -> dict:
    """A small configuration file: JSON, or YAML where its reader is installed."""
    text = "\n".join(r.value for r in spark.read.text(path).collect())  # one small file
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def best_model(spark: SparkSession, path: str, field: str = "best_model") -> str | None:
    """The best model that a summary file (one JSON object) names."""
    row = spark.read.option("multiLine", True).json(path).limit(1)
    return row.first()[field] if field in row.columns and not row.isEmpty() else None


def read_key_values(spark: SparkSession, path: str, sep: str = ":") -> DataFrame:
    """(key, value) of lines such as ``Backbone: ecfp``; other lines give no row."""
    at = F.instr("value", sep)
    return spark.read.text(path).where(at > 1).select(F.trim(F.expr(f"substring(value, 1, instr(value, '{sep}') - 1)")).alias("key"), F.trim(F.expr(f"substring(value, instr(value, '{sep}') + {len(sep)})")).alias("value"))


def read_tagged(spark: SparkSession, paths: dict[str, str], schema: str, tag: str = "origin") -> DataFrame:
    """Several files of one schema under each other, with the name of each as a column."""
    parts = [read_csv(spark, path, schema).withColumn(tag, F.lit(name)) for name, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def read_own_compounds(spark: SparkSession, path: str) -> DataFrame:
    """(id, smiles, activity_flag, nm, pic50) of an own-compound file, with or without a header (also under other names).

    Rows without a structure are dropped; a value of 0 or less, or none, has no pic50.
    """
    head = spark.read.text(path).limit(1).collect()  # one line
    names = [c.strip().strip('"').lstrip("﻿") for c in head[0].value.split(";")] if head else []
    canonical = [ALIASES.get(c.lower(), c) for c in names]
    headed = "SMILES" in canonical
    schema = ", ".join(f"`{c}` string" for c in canonical) if headed else OWN_SCHEMA
    rows = spark.read.schema(schema).option("sep", ";").option("header", headed).option("enforceSchema", True).option("escape", '"').csv(path)
    for column in ("ID", "activity_flag", "standard_value", "standard_units"):
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast("string"))
    nm = P.micromolar_to_nm(P.number(F.col("standard_value")), F.col("standard_units"))
    return rows.where(F.trim("SMILES") != "").select(P.own_id(F.trim("ID")).alias("id"), F.trim("SMILES").alias("smiles"), F.lower(F.trim("activity_flag")).alias("activity_flag"), nm.alias("nm"), P.pic50(nm).alias("pic50"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def write_without_empty_columns(df: DataFrame, path: str, sep: str = ",") -> list[str]:
    """Write CSV without the columns that are null everywhere; gives the columns written."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    kept = [c for c in df.columns if counts[c]]
    df.select(*kept).write.option("header", True).option("sep", sep).option("escape", '"').mode("overwrite").csv(path)
    return kept


def write_rounded(df: DataFrame, path: str, digits: int = 3) -> None:
    """CSV with doubles in a fixed number of digits."""
    text = [F.format_string(f"%.{digits}f", f.name).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema.fields]
    df.select(*text).write.option("header", True).mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line; nulls are left out."""
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").write.mode("overwrite").text(path)


def write_library(df: DataFrame, column: str, path: str) -> None:
    """The distinct values of a column as CSV, sorted over all files (a file per range, not one task)."""
    df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).write.option("header", True).mode("overwrite").csv(path)


def report_lines(ranked: DataFrame) -> DataFrame:
    """(value): a row per line as ``name: value`` pairs, for a text report."""
    return ranked.select(F.concat_ws("; ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("N/A"))) for c in ranked.columns]).alias("value"))


def tagged_fragments(fragments, added):
    """An array column as ``a; b (AC)``: those in the array ``added`` are marked."""
    return F.array_join(F.transform(fragments, lambda f: F.when(F.array_contains(added, f), F.concat(f, F.lit(" (AC)"))).otherwise(f)), "; ")


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; built and written first if no complete one is there."""
    if first_existing(spark, [f"{path.rstrip('/')}/_SUCCESS"]) is None:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
