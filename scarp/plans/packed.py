"""Queries of the two general data problems: packed fields and mixed units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units
from ..functions.units import convert_p_values, convert_potencies
from ..operators.packed_fields import explode_packed
from ..tables import table

#: table, row id, column, kind of value
PACKED_FIELDS = (
    ("hits", "hit_id", "fragments", "value"),
    ("ac_enrichment", "row_id", "cliff_pairs", "pair"),
    ("ac_enrichment", "row_id", "cliff_pair_indices", "index"),
    ("selected_fragments", "row_id", "cliff_pairs_that_added", "pair"),
)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the four packed fields: (field_name, row_id, pos, item)."""
    parts = [explode_packed(table(spark, folder, t), row_id, column, f"{t}.{column}", kind) for t, row_id, column, kind in PACKED_FIELDS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Potencies whose number is not yet in nM or -log10(mol/L): (origin, row_key, pic50_x100)."""
    read = lambda name: table(spark, folder, name)
    sources = read("data_sources")
    raw = convert_potencies(read("raw_activities"), read("chemical_space").select("chembl_id", "mol_wt"), sources, spark)
    moved = raw.where("abs(nm - written) > 0.001 * abs(written)").select(F.lit("raw_activities").alias("origin"), F.col("activity_id").alias("row_key"), "pic50")
    kept = convert_p_values(read("removed_compounds"), sources)
    shifted = kept.where("abs(pic50 - written) > 1e-9").select(F.lit("removed_compounds").alias("origin"), F.col("record_id").alias("row_key"), "pic50")
    return moved.unionByName(shifted).select("origin", "row_key", F.rint(F.col("pic50") * 100).cast("long").alias("pic50_x100"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _key_sql(x: str) -> str:
    """``unit_key`` in SQL."""
    x = f"lower(translate(trim({x}), 'µμ', 'uu'))"
    for pattern, to in ((r"\s*\bper\b\s*|\s*/\s*", "/"), (r"lit(?:er|re)s?$", "l"), (r"[ .*·]([mu]?)l(?:-1|\^-1)$", r"/\1l"), (r"\bmc([gm])", r"u\1"), (r"\s+", "")):
        x = f"regexp_replace({x}, {_text(pattern)}, {_text(to)}, 'g')"
    return x


def _stated_sql(x: str) -> str:
    """``stated_unit`` in SQL."""
    return f"nullif(regexp_extract(regexp_replace(translate({x}, 'µμ', 'uu'), {_text(units._STATED_AMOUNT)}, ' ', 'g'), {_text(units._IN_TEXT)}, 0), '')"


def _part_sql(i: int) -> str:
    return f"regexp_extract(standard_value, {_text(units.VALUE_PATTERN)}, {i})"


def _said_sql(x: str) -> str:
    """``p_statement`` in SQL."""
    return f"nullif(array_to_string(list_filter(string_split_regex(regexp_replace(lower(translate({x}, 'µμ', 'uu')), '\\s+', ' ', 'g'), '[.;] '), lambda part: regexp_matches(part, {_text(units._SPEAKS_OF_P)})), ' '), '')"


_NUMBER = f"CASE WHEN {_part_sql(1)} LIKE '%,%.%' THEN replace({_part_sql(1)}, ',', '') ELSE replace({_part_sql(1)}, ',', '.') END"
_POWER = f"{_part_sql(2)} || {_part_sql(3)}"
_P3 = f"""WITH alias AS (SELECT * FROM (VALUES {', '.join(f"({_text(k)}, '{kind}', {e})" for k, kind, e in units.unit_aliases())}) AS a(unit_key, unit_kind, unit_power)),
  notes AS (SELECT source_name, any_value({_stated_sql(f"regexp_replace(unit_note, {_text(units._P_CLAUSE)}, ' ', 'g')")}) AS note_unit, any_value({_said_sql('unit_note')}) AS noted FROM data_sources GROUP BY 1),
  v AS (SELECT *, regexp_matches(lower(trim(standard_type)), '^(?:p(?:ic|ec|ac|gi|xc|ki|kd|d2|a2)|-\\s*log)') AS is_p,
      TRY_CAST(nullif({_NUMBER}, '') || CASE WHEN {_POWER} <> '' THEN 'e' || {_POWER} ELSE '' END AS DOUBLE) AS written, nullif({_part_sql(4)}, '') AS value_unit,
      CASE WHEN lower(trim(standard_units)) NOT IN ({', '.join(map(_text, units.NO_UNIT))}) THEN standard_units END AS field_unit FROM raw_activities),
  w AS (SELECT v.*, {_key_sql(f"coalesce(field_unit, value_unit, CASE WHEN NOT is_p THEN {_stated_sql('assay_description')} END, note_unit, 'nM')")} AS unit_key FROM v LEFT JOIN notes USING (source_name)
      WHERE written IS NOT NULL AND NOT isnan(written) AND (is_p OR regexp_matches(lower(trim(standard_type)), '^(?:(?:ic|ec|ac|gi|xc|ed|cc|lc)50|ki|kd|km|potency)$'))),
  mw AS (SELECT chembl_id, max(mol_wt) AS mol_wt FROM chemical_space WHERE mol_wt > 0 AND NOT isnan(mol_wt) GROUP BY 1),
  c AS (SELECT activity_id, written, CASE WHEN is_p THEN written WHEN unit_kind = 'molar' AND written > 0 THEN -(log10(CASE WHEN written > 0 THEN written END) + unit_power) WHEN unit_kind = 'mass' AND written > 0 THEN -(log10(CASE WHEN written > 0 THEN written / mol_wt END) + unit_power) END AS pic50,
      CASE WHEN is_p THEN pow(10.0::DOUBLE, 9 - written) WHEN unit_kind = 'molar' THEN written * pow(10.0::DOUBLE, unit_power + 9) ELSE written / mol_wt * pow(10.0::DOUBLE, unit_power + 9) END AS nm
      FROM w LEFT JOIN alias USING (unit_key) LEFT JOIN mw USING (chembl_id)),
  raw AS (SELECT * FROM c WHERE pic50 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY activity_id ORDER BY pic50, written) = 1),
  rules AS (SELECT * FROM (VALUES {', '.join(f"({i}, {_text(p)}, {f})" for i, (p, f) in enumerate(units.SCALE_RULES))}) AS r(rule, pattern, factor)),
  s AS (SELECT record_id, source_name, pic50 AS written, {_said_sql('remark')} AS own FROM removed_compounds WHERE NOT isnan(pic50) AND abs(pic50) < {units.STAND_IN_LIMIT}),
  said AS (SELECT own AS said FROM s WHERE own IS NOT NULL UNION SELECT noted FROM notes WHERE noted IS NOT NULL),
  scales AS (SELECT said, arg_min(factor, rule) AS factor, -any_value(unit_power) AS shift FROM (SELECT said, {_key_sql(f"coalesce(nullif(regexp_extract(said, {_text(units._P_UNIT)}, 0), ''), 'm')")} AS unit_key FROM said) JOIN rules ON regexp_matches(said, pattern) JOIN alias USING (unit_key) WHERE unit_kind = 'molar' GROUP BY 1),
  p AS (SELECT record_id, written, coalesce(a.factor, b.factor, 1) * written + coalesce(a.shift, b.shift, 0) AS pic50 FROM s LEFT JOIN notes USING (source_name) LEFT JOIN scales a ON a.said = own LEFT JOIN scales b ON b.said = noted),
  kept AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY pic50, written) = 1)
  SELECT 'raw_activities' AS origin, activity_id AS row_key, round_even(pic50 * 100, 0)::BIGINT AS pic50_x100 FROM raw WHERE abs(nm - written) > 0.001 * abs(written)
  UNION ALL SELECT 'removed_compounds', record_id, round_even(pic50 * 100, 0)::BIGINT FROM kept WHERE abs(pic50 - written) > 1e-9"""
ORACLE_SQL = {"p3_found": _P3}
