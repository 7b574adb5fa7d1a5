"""Dataset preparation over raw_activities, chemical_space and removed_compounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import preparation as P
from ..skew import lookup_join
from ..tables import table


def merge_space(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "raw_activities").select("activity_id", "chembl_id", "standard_type", "standard_value", "standard_units")
    space = table(spark, folder, "chemical_space").select("chembl_id", "mol_id", "mol_wt", "alogp")
    return lookup_join(raw, space, "chembl_id", "inner")


def clean_compounds(spark: SparkSession, folder: str) -> DataFrame:
    """Filter, convert, label and keep the first row of each molecule."""
    ic50 = merge_space(spark, folder).where(F.upper(F.trim("standard_type")) == "IC50").withColumn("value", P.number(F.col("standard_value")))
    small = ic50.where((F.col("mol_wt") < P.MAX_WEIGHT) & (F.col("alogp") < P.MAX_LOGP) & F.col("value").isNotNull())
    nm = P.mass_to_nm(F.col("value"), F.col("standard_units"), F.col("mol_wt"))
    first = P.keep_first(small.withColumn("nm", nm).where("nm > 0"), ["mol_id"], [F.col("activity_id"), F.col("nm")])
    return first.select("mol_id", "activity_id", F.round("nm", 6).alias("nm"), F.round(P.pic50(F.col("nm")), 6).alias("pic50"), P.flag_lt(F.col("nm")).alias("activity_flag"), P.label_ge(P.pic50(F.col("nm"))).alias("label"))


def tautomer_pick(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "removed_compounds").select(F.trim("canonical_smiles").alias("structure"), "record_id", "activity_flag", F.nanvl("standard_value", F.lit(None).cast("double")).alias("standard_value")).where("structure <> ''")
    return P.prefer_active(records.dropDuplicates(["record_id", "structure"]), ["structure"], "activity_flag", "standard_value", "record_id").select("structure", "record_id")


def union_custom(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned compounds and, under them, own ones: measured compounds that the registry does not know, in nM or micromolar."""
    clean = clean_compounds(spark, folder).select(F.concat(F.lit("MOL_"), F.col("mol_id").cast("string")).alias("id"), "nm", "pic50")
    known = table(spark, folder, "chemical_space").select("chembl_id").where("chembl_id is not null").distinct()
    raw = table(spark, folder, "raw_activities").where(F.upper(F.trim("standard_type")) == "IC50").select("activity_id", "chembl_id", "standard_value", "standard_units").dropDuplicates(["activity_id"])
    strange = raw.where("chembl_id is not null").join(known, "chembl_id", "left_anti").unionByName(raw.where("chembl_id is null"))
    own = strange.select(P.own_id(F.col("activity_id").cast("string")).alias("id"), P.micromolar_to_nm(P.number(F.col("standard_value")), F.col("standard_units")).alias("nm")).where("nm > 0")
    return clean.unionByName(own.select("id", F.round("nm", 6).alias("nm"), F.round(P.pic50(F.col("nm")), 6).alias("pic50")))


def removed_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    """Molecules without a removed record, be it known by identifier, however written, or by structure alone."""
    space = table(spark, folder, "chemical_space").select("mol_id", "chembl_id", "canonical_smiles")
    named = table(spark, folder, "removed_compounds").select(P.compound_key(F.col("chembl_id"), F.col("canonical_smiles")).alias("compound_key")).where("compound_key is not null").distinct()
    gone = P.both_keys(space, "mol_id", "chembl_id", "canonical_smiles").join(named, "compound_key", "left_semi").select(F.col("key").alias("mol_id")).distinct()
    return space.select("mol_id", "canonical_smiles").join(gone, "mol_id", "left_anti")


def dataset_validation(spark: SparkSession, folder: str) -> DataFrame:
    report = P.validation_report(table(spark, folder, "removed_compounds").withColumn("p", P.pic50(F.col("standard_value"))), "canonical_smiles", "p")
    return report.withColumn("active_ratio", F.round("active_ratio", 6))


QUERIES = {f.__name__: f for f in (merge_space, clean_compounds, tautomer_pick, union_custom, removed_antijoin, dataset_validation)}

_MERGED = "SELECT r.activity_id, r.chembl_id, r.standard_type, r.standard_value, r.standard_units, s.mol_id, s.mol_wt, s.alogp FROM raw_activities r JOIN chemical_space s ON r.chembl_id = s.chembl_id"
_CLEAN = rf"""SELECT mol_id, activity_id, round(nm, 6) AS nm, round(-log10(nm * 1e-9), 6) AS pic50,
    CASE WHEN nm < 10000 THEN 'active' ELSE 'inactive' END AS activity_flag, CAST(-log10(nm * 1e-9) >= 9 - log10(10000) AS INT) AS label
  FROM (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY activity_id, nm) AS rn FROM (
    SELECT mol_id, activity_id, CASE WHEN standard_units = 'ug.mL-1' THEN v / nullif(mol_wt, 0) * 1e6 ELSE v END AS nm FROM (
      SELECT *, TRY_CAST(nullif(regexp_extract(standard_value, '^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*$', 1), '') AS DOUBLE) AS v FROM ({_MERGED}) WHERE upper(trim(standard_type)) = 'IC50' AND mol_wt < 900 AND alogp < 8)
    WHERE v IS NOT NULL) WHERE nm > 0) WHERE rn = 1"""
#: SQL of ``preparation.compound_id``, ``stripped`` and ``compound_key``.
SQL_STRIP = r"nullif(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '')"
SQL_ID = r"'CHEMBL' || nullif(regexp_extract(upper({c}), '^\s*CHEMBL[\s_:#-]*0*([1-9]\d*)\s*$', 1), '')"
SQL_KEY = f"coalesce({SQL_ID.format(c='chembl_id')}, '=' || {SQL_STRIP.format(c='canonical_smiles')})"
SQL_BOTH = f"(SELECT mol_id, unnest([{SQL_ID.format(c='chembl_id')}, '=' || {SQL_STRIP.format(c='canonical_smiles')}]) AS compound_key FROM chemical_space)"
ORACLE_SQL = {
    "merge_space": _MERGED,
    "clean_compounds": _CLEAN,
    "tautomer_pick": """SELECT structure, record_id FROM (SELECT trim(canonical_smiles) AS structure, record_id,
        row_number() OVER (PARTITION BY trim(canonical_smiles) ORDER BY CASE WHEN lower(trim(coalesce(activity_flag, ''))) = 'active' THEN 0 ELSE 1 END, CASE WHEN isnan(standard_value) THEN NULL ELSE standard_value END ASC NULLS LAST, record_id) AS rn
        FROM removed_compounds WHERE trim(canonical_smiles) <> '') WHERE rn = 1""",
    "union_custom": rf"""SELECT 'MOL_' || mol_id AS id, nm, pic50 FROM ({_CLEAN}) UNION ALL SELECT 'OWN_' || activity_id, round(nm, 6), round(-log10(nm * 1e-9), 6) FROM (
        SELECT activity_id, v * CASE WHEN lower(trim(standard_units)) IN ({', '.join(f"'{u}'" for u in P.MICROMOLAR)}) THEN 1000 ELSE 1 END AS nm FROM (
          SELECT DISTINCT activity_id, chembl_id, standard_units, TRY_CAST(nullif(regexp_extract(standard_value, '^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*$', 1), '') AS DOUBLE) AS v FROM raw_activities WHERE upper(trim(standard_type)) = 'IC50')
        WHERE chembl_id IS NULL OR chembl_id NOT IN (SELECT chembl_id FROM chemical_space WHERE chembl_id IS NOT NULL)) WHERE nm > 0""",
    "removed_antijoin": f"SELECT mol_id, canonical_smiles FROM chemical_space WHERE mol_id NOT IN (SELECT mol_id FROM {SQL_BOTH} WHERE compound_key IN (SELECT {SQL_KEY} FROM removed_compounds))",
    "dataset_validation": """SELECT n_rows, n_structures, n_responses, round(r, 6) AS active_ratio, coalesce(r BETWEEN 0.05 AND 0.95, false) AS is_balanced, coalesce(r > 0 AND r < 1, false) AS has_two_classes FROM (
        SELECT count(*) AS n_rows, count(*) FILTER (WHERE trim(canonical_smiles) <> '') AS n_structures, count(p) AS n_responses, avg(CASE WHEN p >= 5 THEN 1.0 WHEN p IS NOT NULL THEN 0.0 END) AS r
        FROM (SELECT canonical_smiles, CASE WHEN standard_value > 0 AND NOT isnan(standard_value) THEN -log10(standard_value * 1e-9) END AS p FROM removed_compounds))""",
}
