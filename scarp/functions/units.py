"""Potencies on one scale: nM and -log10(mol/L), in plain SQL expressions.

The number and the unit are cut out of text with regular expressions, the unit's
spelling is reduced to one form and looked up in a small alias table (its size is
fixed by the rules below, so it is broadcast), and the first source that states a
unit wins: unit field, value text, description, note of the source, default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..skew import lookup_join
from ..store import Scratch

#: Power of ten of each prefix, and the long names of molar units.
PREFIXES = {"": 0, "m": -3, "u": -6, "n": -9, "p": -12, "f": -15}
LONG_NAMES = {"": "molar", "m": "millimolar", "u": "micromolar", "n": "nanomolar", "p": "picomolar", "f": "femtomolar"}
VOLUMES = {"": 0, "m": -3, "u": -6}
#: Spellings of a unit field that states nothing.
NO_UNIT = ("", "nan", "-", "--", "none", "null", "n/a", "na", "?")
#: Readings that stand for a missing number.
STAND_IN_LIMIT = 50.0  # no potency on any log scale comes near; -999, 99.99 and the like lie beyond

_BEFORE_NUMBER = r"^\s*(?:(?:>=|<=|[=<>~≈≥≤]+|ca\.?|approx\.?|circa|about)\s*)*"
_NUMBER = r"([+-]?(?:\d{1,3}(?:,\d{3})+\.\d+|\d+(?:[.,]\d+)?|\.\d+))"
_POWER = r"(?:\s*[x×*]\s*10\s*\^\s*([+-]?\d+)|[eE]([+-]?\d+))?"
VALUE_PATTERN = _BEFORE_NUMBER + _NUMBER + _POWER + r"\s*(.*?)\s*$"

_LITRE = r"l(?:it(?:er|re)s?)?"
_IN_TEXT = (
    r"(?:\b(?i:(?:femto|pico|nano|micro|milli)?molar)\b"
    r"|\b(?i:(?:mc|[fpnum])?mol\s?(?:/|per)\s?" + _LITRE + r")\b|\b(?i:(?:mc|[fpnum])?mol[. ]" + r"l-1)"
    r"|\b(?i:(?:mc|[pnum])?g\s?(?:/|per)\s?[mu]?" + _LITRE + r")\b|\b(?i:(?:mc|[pnum])?g[. ][mu]?l-1)"
    r"|\b(?:mc|[fpnum])?M\b|\b[npf]m\b|\bu[mM]\b)"
)
_STATED_AMOUNT = r"\d+(?:[.,]\d+)?\s?" + _IN_TEXT
_P_CLAUSE = r"(?i)[^.;]*\bp(?:ic50|ec50|ki|kd|\s+figures?|\s+values?)\b[^.;]*[.;]?"


_SPEAKS_OF_P = r"\bp(?:ic50|ec50|ki|kd)?\b"
_P_UNIT = r"\b(?:(?:femto|pico|nano|micro|milli)?molar|[fpnum]?mol/l|[fpnum]?m)\b"
#: Sign of a stated p scale: the first pattern found counts. A plain log is negative below 1 mol/L, so it is turned around.
SCALE_RULES = (
    (r"\bsign\b.*\b(?:not|never|un)\s?(?:flipped|changed|turned|inverted)", -1),
    (r"\bminus sign\b|\(negative\)|\bleft negative\b", -1),
    (r"-\s?(?:log|lg)|\b(?:negative|minus)\s(?:log|lg)", 1),
    (r"\b(?:lg|log(?:10)?)\b", -1),
    (r"\b(?:computed|calculated|derived|taken|made) from\b|\brelative to\b|\brefers? to\b|\bbased on\b|\bin terms of\b", 1),
    (r"\bmolar scale\b|\busual scale\b", 1),
)


def unit_aliases() -> list[tuple[str, str, int]]:
    """(spelling, kind, power of ten to mol/L or g/L), built from the prefix rules."""
    rows: dict[str, tuple[str, int]] = {}
    for prefix, power in PREFIXES.items():
        for form in (f"{prefix}m", f"{prefix}mol/l", LONG_NAMES[prefix]):
            rows[form] = ("molar", power)
            for e in range(-15, 7):
                for times in (f"10^{e}", f"10'{e}", f"1e{e}", f"x10^{e}", f"x{10**e}" if e > 0 else f"10**{e}"):
                    rows[f"{times}{form}"] = ("molar", power + e)
        if prefix != "f":
            for volume, litre in VOLUMES.items():
                rows[f"{prefix}g/{volume}l"] = ("mass", power - litre)
    return [(form, kind, power) for form, (kind, power) in rows.items()]


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(unit_aliases(), "unit_key string, unit_kind string, unit_power int")


def unit_key(text: Column) -> Column:
    """Reduce a unit's spelling: ``µmol.L-1``, ``umol per litre`` and ``UMOL/L`` become ``umol/l``."""
    t = F.lower(F.translate(F.trim(text), "µμ", "uu"))
    t = F.regexp_replace(t, r"\s*\bper\b\s*|\s*/\s*", "/")
    t = F.regexp_replace(t, r"lit(?:er|re)s?$", "l")
    t = F.regexp_replace(t, r"[ .*·]([mu]?)l(?:-1|\^-1)$", "/$1l")
    t = F.regexp_replace(t, r"\bmc(?=g|m)", "u")
    return F.regexp_replace(t, r"\s+", "")


def stated_unit(text: Column) -> Column:
    """The unit that a sentence gives for the reported values; amounts such as ``ATP at 1 mM`` are not meant."""
    t = F.translate(text, "µμ", "uu")
    t = F.regexp_replace(t, _STATED_AMOUNT, " ")
    return F.nullif(F.regexp_extract(t, _IN_TEXT, 0), F.lit(""))


def parse_value(text: Column) -> Column:
    """The number and the unit text of a value as struct<number, unit>; a relation sign is ignored.

    One pass of one pattern cuts the text into its parts. The number is null where none is readable.
    """
    parts = F.split(F.regexp_replace(text, VALUE_PATTERN, "$1\u0001$2$3\u0001$4"), "\u0001")
    number = F.regexp_replace(F.get(parts, F.lit(0)), r",(?=\d{3}(?:,|\.))", "")
    plain = F.concat(F.translate(number, ",", "."), F.when(F.get(parts, F.lit(1)) != "", F.concat(F.lit("e"), F.get(parts, F.lit(1)))).otherwise(F.lit("")))
    return F.struct(F.when(F.size(parts) == 3, plain.try_cast("double")).alias("number"), F.nullif(F.get(parts, F.lit(2)), F.lit("")).alias("unit"))


def is_p_type(standard_type: Column) -> Column:
    """The type says that the number is -log10(mol/L) already (pIC50, pKi, -log(IC50))."""
    return F.lower(F.trim(standard_type)).rlike(r"^(?:p(?:ic|ec|ac|gi|xc|ki|kd|d2|a2)|-\s*log)")


def is_potency_type(standard_type: Column) -> Column:
    return F.lower(F.trim(standard_type)).rlike(r"^(?:(?:ic|ec|ac|gi|xc|ed|cc|lc)50|ki|kd|km|potency)$")


def convert_potencies(raw: DataFrame, weights: DataFrame, sources: DataFrame, spark: SparkSession) -> DataFrame:
    """Every interpretable potency of ``raw`` as (activity_id, written, nm, pic50, unit_from).

    Rows without a readable number or with a percentage, another quantity or an unknown unit
    give no row; mass concentrations need a weight above 0. A number of 0 or less has no
    logarithm and gives no row unless it is one already. Repeats of an activity_id give one row.
    ``sources`` has one row per source and is broadcast.
    """
    field = F.lower(F.trim(F.col("standard_units")))
    notes = sources.select("source_name", stated_unit(F.regexp_replace("unit_note", _P_CLAUSE, " ")).alias("note_unit")).dropDuplicates(["source_name"])
    base = (
        raw.withColumn("is_p", is_p_type(F.col("standard_type")))
        .where(F.col("is_p") | is_potency_type(F.col("standard_type")))
        .withColumn("value", parse_value(F.col("standard_value")))
        .withColumn("field_unit", F.when(~field.isin(*NO_UNIT), F.col("standard_units")))
        .where("value.number is not null and not isnan(value.number)")
    )
    unstated = F.col("field_unit").isNull() & F.col("value.unit").isNull() & ~F.col("is_p")
    united = (
        base.withColumn("described_unit", F.when(unstated, stated_unit(F.col("assay_description"))))
        .join(F.broadcast(notes), "source_name", "left")
        .select(
            "activity_id",
            "chembl_id",
            F.col("value.number").alias("written"),
            "is_p",
            unit_key(F.coalesce("field_unit", "value.unit", "described_unit", "note_unit", F.lit("nM"))).alias("unit_key"),
            F.when(F.col("is_p"), "type")
            .when(F.col("field_unit").isNotNull(), "field")
            .when(F.col("value.unit").isNotNull(), "value")
            .when(F.col("described_unit").isNotNull(), "description")
            .when(F.col("note_unit").isNotNull(), "source")
            .otherwise("default")
            .alias("unit_from"),
        )
        .join(F.broadcast(alias_table(spark)), "unit_key", "left")
        .drop("unit_key")
    )
    united = Scratch(spark, "units").save(united, "united")  # the text is read once, the joins below read numbers
    # Whatever the unit field says, a p-type is on the molar scale already.
    molar = united.where("is_p or (unit_kind = 'molar' and written > 0)").select(
        "activity_id",
        "written",
        F.when(F.col("is_p"), F.col("written")).otherwise(-(F.log10(F.when(~F.col("is_p"), F.col("written"))) + F.col("unit_power"))).alias("pic50"),
        F.when(F.col("is_p"), F.pow(F.lit(10.0), 9 - F.col("written"))).otherwise(F.col("written") * F.pow(F.lit(10.0), F.col("unit_power") + 9)).alias("nm"),
        "unit_from",
    )
    massive = united.where("not is_p and unit_kind = 'mass' and written > 0 and chembl_id is not null")
    known = weights.where("mol_wt > 0 and not isnan(mol_wt)").groupBy("chembl_id").agg(F.max("mol_wt").alias("mol_wt"))
    mass = lookup_join(massive, known, "chembl_id", "inner").select(
        "activity_id",
        "written",
        (-(F.log10(F.col("written") / F.col("mol_wt")) + F.col("unit_power"))).alias("pic50"),
        (F.col("written") / F.col("mol_wt") * F.pow(F.lit(10.0), F.col("unit_power") + 9)).alias("nm"),
        "unit_from",
    )
    return molar.unionByName(mass).groupBy("activity_id").agg(F.min_by(F.struct("written", "nm", "pic50", "unit_from"), F.struct("pic50", "written")).alias("r")).select("activity_id", "r.*")


def p_statement(text: Column) -> Column:
    """The parts of a remark or note that speak of p values, reduced to small letters and single blanks; null if there is none."""
    plain = F.regexp_replace(F.lower(F.translate(text, "µμ", "uu")), r"\s+", " ")
    return F.nullif(F.array_join(F.filter(F.split(plain, r"[.;] "), lambda part: part.rlike(_SPEAKS_OF_P)), " "), F.lit(""))


def scale_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *rule) for i, rule in enumerate(SCALE_RULES)], "rule int, pattern string, factor int")


def p_scales(statements: DataFrame, spark: SparkSession) -> DataFrame:
    """(said, factor, offset) that take a written p value to -log10(mol/L); ``statements`` has one column ``said`` of distinct texts.

    The unit is cut out of the statement and looked up in the alias table, none meaning mol/L; the first rule whose pattern
    is found gives the sign. For a unit of 10**e mol/L a negative log becomes p - e, a plain one -p - e. Statements that no
    rule reads give no row.
    """
    unit = F.nullif(F.regexp_extract("said", _P_UNIT, 0), F.lit(""))
    keyed = statements.withColumn("unit_key", unit_key(F.coalesce(unit, F.lit("m"))))
    signs = keyed.join(F.broadcast(scale_rules(spark)), F.rlike(F.col("said"), F.col("pattern"))).groupBy("said", "unit_key").agg(F.min_by("factor", "rule").alias("factor"))
    powers = alias_table(spark).where("unit_kind = 'molar'")
    return signs.join(F.broadcast(powers), "unit_key").select("said", "factor", (-F.col("unit_power")).alias("offset"))


def usable_p(p: Column) -> Column:
    """A reading is usable when it is a number and no stand-in for a missing one."""
    return p.isNotNull() & ~F.isnan(p) & (F.abs(p) < STAND_IN_LIMIT)


def convert_p_values(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Usable pic50 of ``records`` on the molar scale: (record_id, written, pic50). Repeats give one row.

    A record's remark counts before the note of its source; without a statement the value is molar. ``sources`` has one row
    per source and is broadcast; statements are converted once each, however many records carry them.
    """
    spark = records.sparkSession
    notes = sources.select("source_name", p_statement(F.col("unit_note")).alias("noted")).dropDuplicates(["source_name"])
    told = records.where(usable_p(F.col("pic50"))).select("record_id", "source_name", F.col("pic50").alias("written"), p_statement(F.col("remark")).alias("own"))
    scratch = Scratch(spark, "scales")
    told, seen = scratch.save_measured(told, "told")
    scales = scratch.save(p_scales(told.select(F.col("own").alias("said")).where("said is not null").distinct().unionByName(notes.select(F.col("noted").alias("said")).where("said is not null")).distinct(), spark), "scales")
    own = lookup_join(told, scales.toDF("own", "own_factor", "own_offset"), "own", rows=seen["n"])
    noted = F.broadcast(notes.join(scales, notes.noted == scales.said).select("source_name", "factor", "offset"))
    joined = own.join(noted, "source_name", "left")
    p = F.coalesce("own_factor", "factor", F.lit(1)) * F.col("written") + F.coalesce("own_offset", "offset", F.lit(0))
    return joined.groupBy("record_id").agg(F.min_by(F.struct("written", p.alias("pic50")), F.struct(p, "written")).alias("r")).select("record_id", "r.*")
