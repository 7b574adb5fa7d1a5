"""Fragments of fragment_membership, their importance (selected_fragments) and enrichment at cliffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fragments as R
from ..operators import preparation as P
from ..store import Scratch
from ..tables import table
from .cliffs import _BASE, attached_fragment, cliff_pairs, potency


def _members(spark: SparkSession, folder: str) -> DataFrame:
    return R.membership(table(spark, folder, "fragment_membership"), "mol_id", attached_fragment(F.col("fragment")))


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return potency(spark, folder).select("key", P.label_ge(F.col("p"), 1000.0).alias("y"))


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Importance is merged over spellings of a fragment by its maximum."""
    merged = table(spark, folder, "selected_fragments").select(attached_fragment(F.col("fragment_smiles")).alias("fragment"), "importance").where("fragment is not null").groupBy("fragment").agg(F.max("importance").alias("importance"))
    return Scratch(spark, "ranked").save(R.ranked_importance(merged), "ranked")


def _clipped(spark: SparkSession, folder: str) -> DataFrame:
    return R.clipped_sali(Scratch(spark, "cliffs").save(cliff_pairs(spark, folder), "cliffs"))


def _enrichment(spark: SparkSession, folder: str) -> DataFrame:
    return R.cliff_enrichment(_clipped(spark, folder), _members(spark, folder))


def fragment_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _members(spark, folder).groupBy("fragment").agg(F.count("*").alias("n_molecules")).where("n_molecules >= 2")


def fragment_presence(spark: SparkSession, folder: str) -> DataFrame:
    """The presence matrix in long form: one row per molecule and fragment."""
    return _members(spark, folder).select(F.col("key").alias("mol_id"), "fragment")


def fragment_freq_by_class(spark: SparkSession, folder: str) -> DataFrame:
    return R.frequencies(_members(spark, folder), _labels(spark, folder))


def active_only_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments of active molecules that no inactive one has."""
    held = _members(spark, folder).join(_labels(spark, folder), "key")
    return held.where("y = 1").select("fragment").distinct().join(held.where("y = 0").select("fragment").distinct(), "fragment", "left_anti")


def ac_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    return _enrichment(spark, folder).select("fragment", F.round("enrichment", 5).alias("enrichment"), "n_pairs", "n_up", "n_down")


def importance_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder).select("fragment", "rn", F.round("cum_share", 6).alias("cum_share"), F.round("drop", 6).alias("drop"))


def ac_enrichment_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs behind each fragment's enrichment, as ``i|j``, a row each."""
    pairs = R.enrichment_pairs(_clipped(spark, folder), _members(spark, folder))
    return pairs.select("fragment", R.pair_text(F.col("a"), F.col("b")).alias("pair"), F.round("signed", 5).alias("signed"))


def cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """How many fragments each mode keeps; ``gap`` is the knee mode where the curve has no knee."""
    ranked = _ranked(spark, folder)
    rows = [(R.cutoff(ranked, mode), mode) for mode in R.CUTOFFS] + [(R.knee_cutoff(ranked, with_knee=False), "gap")]
    parts = [df.select(F.lit(name).alias("mode"), "n_selected") for df, name in rows]
    return reduce(DataFrame.unionByName, parts)


def stability_flags(spark: SparkSession, folder: str) -> DataFrame:
    return R.stability_flags(_ranked(spark, folder)).select("fragment", "stability")


def fdr_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments that actives have more often than permuted labels would give."""
    return R.label_fdr(_members(spark, folder), _labels(spark, folder)).select("fragment", "n", "n_active", F.round("p_value", 6).alias("p_value"), "is_accepted")


def important_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Importance from 0 to 1, of all fragments of the molecules; those without one have 0. Kept from a tenth on."""
    ranked = _ranked(spark, folder)
    ends = F.broadcast(ranked.agg(F.min("importance").alias("lo"), F.max("importance").alias("hi")))  # one row
    scaled = ranked.crossJoin(ends).select("fragment", ((F.col("importance") - F.col("lo")) / (F.col("hi") - F.col("lo") + R.TINY)).alias("scaled"))
    whole = _members(spark, folder).select("fragment").distinct().unionByName(scaled.select("fragment")).distinct().join(scaled, "fragment", "left")
    told = whole.select("fragment", F.coalesce("scaled", F.lit(0.0)).alias("scaled"))
    return told.select("fragment", F.round("scaled", 6).alias("importance"), (F.col("scaled") >= 0.1).alias("is_important"))


def fragment_selection(spark: SparkSession, folder: str) -> DataFrame:
    """By the knee of the importance curve, without the negatively and with the positively enriched."""
    ranked = _ranked(spark, folder)
    return R.select_fragments(ranked, R.cutoff(ranked, "knee"), _enrichment(spark, folder))


def fragment_library(spark: SparkSession, folder: str) -> DataFrame:
    """Selected fragments and the hydrogen cap, each once."""
    cap = spark.range(1).select(F.lit("[H][*]").alias("fragment"))
    chosen = table(spark, folder, "selected_fragments").where("selected_by = 'threshold' or was_added_by_cliff_pairs").select(attached_fragment(F.col("fragment_smiles")).alias("fragment"))
    return chosen.where("fragment is not null").unionByName(cap).distinct()


QUERIES = {f.__name__: f for f in (fragment_counts, fragment_presence, fragment_freq_by_class, active_only_fragments, ac_enrichment, ac_enrichment_pairs, importance_ranks, cutoffs, stability_flags, fdr_fragments, important_fragments, fragment_selection, fragment_library)}

_STAR = "SELECT mol_id, tok FROM t WHERE contains(tok, '[*]')"
_PLAIN = r"nullif(regexp_replace(trim({c}), '\[(?:\d+\*|\*:\d+|\d+\*:\d+)\]', '[*]', 'g'), '')"
_Y = "y AS (SELECT mol_id, CAST(p >= 6 AS INT) AS y FROM p)"
_ENRICH = """st AS (SELECT mol_id, tok FROM t WHERE contains(tok, '[*]')), q AS (SELECT quantile_cont(sali, 0.99) AS lim FROM (SELECT delta / (1 - sim + 1e-6) AS sali FROM k)),
  c AS (SELECT a, b, least(delta / (1 - sim + 1e-6), lim) AS sali, x.p AS pa, z.p AS pb FROM k, q, p x, p z WHERE x.mol_id = a AND z.mol_id = b),
  h AS (SELECT a, b, sali, pa > pb AS up, tok FROM c JOIN st t ON t.mol_id = a UNION ALL SELECT a, b, sali, pb > pa, tok FROM c JOIN st t ON t.mol_id = b),
  u AS (SELECT a, b, tok, max(sali) AS sali, bool_or(up) AS up FROM h GROUP BY 1, 2, 3 HAVING count(*) = 1),
  ac AS (SELECT tok AS fragment, sum(CASE WHEN up THEN sali ELSE -sali END) AS enrichment, count(*) AS n_pairs, count(*) FILTER (WHERE up) AS n_up, count(*) FILTER (WHERE NOT up) AS n_down FROM u GROUP BY 1)"""
_RANKED = f"""f AS (SELECT {_PLAIN.format(c='fragment_smiles')} AS fragment, greatest(coalesce(max(importance), 0), 0) AS importance FROM selected_fragments GROUP BY 1 HAVING contains({_PLAIN.format(c='fragment_smiles')}, '[*]')),
  g AS (SELECT fragment, importance, row_number() OVER w AS rn, sum(importance) OVER (w ROWS UNBOUNDED PRECEDING) / sum(importance) OVER () AS cum_share, (importance - lead(importance) OVER w) / (importance + 1e-9) AS drop_, count(*) OVER () AS n FROM f WINDOW w AS (ORDER BY importance DESC, fragment))"""
_CUT = "coalesce((SELECT min(rn) FROM g WHERE cum_share >= 0.8 - 1e-12), (SELECT count(*) FROM g))"
_KNEE = """kd AS (SELECT rn, 1 - (importance - min(importance) OVER ()) / (max(importance) OVER () - min(importance) OVER () + 1e-9) - (rn - 1) * (1.0::DOUBLE / nullif(n - 1, 0)) AS d, 1.0::DOUBLE / nullif(n - 1, 0) AS step FROM g),
  kt AS (SELECT *, CAST(coalesce(d >= lag(d) OVER w, true) AND coalesce(d >= lead(d) OVER w, true) AS INT) AS peak, CAST(coalesce(d <= lag(d) OVER w, true) AND coalesce(d <= lead(d) OVER w, true) AS INT) AS valley FROM kd WINDOW w AS (ORDER BY rn)),
  kr AS (SELECT *, sum(peak) OVER w - peak AS after_peak, sum(valley) OVER w - valley AS past FROM kt WINDOW w AS (ORDER BY rn ROWS UNBOUNDED PRECEDING)),
  ks AS (SELECT r.rn AS pos, r.d, r.step, p.rn AS peak_rn, p.d AS top_d, r.past > p.past AS dipped FROM kr r JOIN kr p ON p.peak = 1 AND p.after_peak + 1 = r.after_peak),
  kk AS (SELECT s, arg_min(peak_rn, pos) AS knee FROM ks, (VALUES (0.5), (1.0), (2.0)) AS v(s) WHERE d < CASE WHEN dipped THEN 0 ELSE top_d - s * step END GROUP BY s),
  x AS (SELECT count(*) AS n, (SELECT rn FROM g WHERE rn > 15 AND drop_ IS NOT NULL ORDER BY drop_ DESC, rn LIMIT 1) AS gap, (SELECT min(rn) FROM g WHERE cum_share >= 0.8 - 1e-12) AS cut, (SELECT arg_min(knee, s) FROM kk WHERE knee > 15) AS knee FROM g),
  xx AS (SELECT *, coalesce(CASE WHEN n >= 17 AND gap <= n * 0.8 THEN gap END, least(greatest(coalesce(cut, 1), 15), n // 2)) AS gapped FROM x)"""
ORACLE_SQL = {
    "fragment_counts": f"WITH {_BASE} SELECT tok AS fragment, count(*) AS n_molecules FROM ({_STAR}) GROUP BY 1 HAVING count(*) >= 2",
    "fragment_presence": f"WITH {_BASE} SELECT mol_id, tok AS fragment FROM ({_STAR})",
    "fragment_freq_by_class": f"""WITH {_BASE}, {_Y}, z AS (SELECT count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0 FROM y)
        SELECT tok AS fragment, count(*) AS n_total, count(*) FILTER (WHERE y = 1) AS n_active, count(*) FILTER (WHERE y = 0) AS n_inactive,
        round_even(count(*) FILTER (WHERE y = 1) * 100.0::DOUBLE / greatest(1, max(n1)), 2) AS active_pct, round_even(count(*) FILTER (WHERE y = 0) * 100.0::DOUBLE / greatest(1, max(n0)), 2) AS inactive_pct
        FROM ({_STAR}) LEFT JOIN y USING (mol_id), z GROUP BY 1""",
    "active_only_fragments": f"WITH {_BASE}, {_Y} SELECT DISTINCT tok AS fragment FROM ({_STAR}) JOIN y USING (mol_id) WHERE y = 1 AND tok NOT IN (SELECT tok FROM t JOIN y USING (mol_id) WHERE y = 0)",
    "ac_enrichment": f"WITH {_BASE}, {_ENRICH} SELECT fragment, round(enrichment, 5) AS enrichment, n_pairs, n_up, n_down FROM ac",
    "importance_ranks": f"WITH {_RANKED} SELECT fragment, rn, round(cum_share, 6) AS cum_share, round(drop_, 6) AS \"drop\" FROM g",
    "ac_enrichment_pairs": f"WITH {_BASE}, {_ENRICH} SELECT tok AS fragment, a || '|' || b AS pair, round(CASE WHEN up THEN sali ELSE -sali END, 5) AS signed FROM u",
    "cutoffs": f"""WITH {_RANKED}, {_KNEE}
        SELECT 'cumulative' AS mode, coalesce(cut, n) AS n_selected FROM xx UNION ALL SELECT 'knee', CASE WHEN n <= 15 THEN n ELSE coalesce(knee, gapped) END FROM xx UNION ALL
        SELECT 'gap', CASE WHEN n <= 15 THEN n ELSE gapped END FROM xx UNION ALL SELECT 'stability', greatest(1, n // 2) FROM xx UNION ALL
        SELECT 'rank_step_up', coalesce((SELECT max(rn) FROM g WHERE rn / (n + 1) <= 0.05 * rn / n), greatest(1, n // 10)) FROM xx""",
    "stability_flags": f"WITH {_RANKED} SELECT fragment, CASE WHEN rn <= greatest(1, n // 2) THEN 1.0::DOUBLE ELSE 0 END AS stability FROM g",
    "fdr_fragments": f"""WITH {_BASE}, {_Y}, z AS (SELECT sum(y) AS m, count(*) AS n FROM y), c AS (SELECT tok AS fragment, count(*) AS k, sum(y) AS x FROM ({_STAR}) JOIN y USING (mol_id) GROUP BY 1),
        h AS (SELECT fragment, k, x, least(1, sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(n - m + 1) - lgamma(k - i + 1) - lgamma(n - m - k + i + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1)))) AS p
          FROM (SELECT *, unnest(range(greatest(x, k + m - n, 0)::BIGINT, least(k, m)::BIGINT + 1)) AS i FROM c, z) GROUP BY 1, 2, 3),
        bh AS (SELECT *, row_number() OVER (ORDER BY p, fragment) AS rn, count(*) OVER () AS tests FROM h)
        SELECT fragment, k AS n, x::BIGINT AS n_active, round(p, 6) AS p_value, coalesce(p <= (SELECT max(p) FROM bh WHERE p <= 0.05 * rn / tests), false) AS is_accepted FROM bh""",
    "important_fragments": f"""WITH {_BASE}, {_RANKED}, i AS (SELECT fragment, (importance - min(importance) OVER ()) / (max(importance) OVER () - min(importance) OVER () + 1e-9) AS s FROM g),
        w AS (SELECT tok AS fragment FROM ({_STAR}) UNION SELECT fragment FROM i) SELECT fragment, round(coalesce(s, 0), 6) AS importance, coalesce(s, 0) >= 0.1 AS is_important FROM w LEFT JOIN i USING (fragment)""",
    "fragment_selection": f"""WITH {_BASE}, {_ENRICH}, {_RANKED}, {_KNEE}, top AS (SELECT fragment FROM g WHERE rn <= (SELECT CASE WHEN n <= 15 THEN n ELSE coalesce(knee, gapped) END FROM xx))
        SELECT fragment, 'threshold' AS selected_by FROM top WHERE fragment NOT IN (SELECT fragment FROM ac WHERE enrichment < 0)
        UNION ALL SELECT fragment, 'AC_added' FROM ac WHERE enrichment > 0 AND fragment IN (SELECT fragment FROM g) AND fragment NOT IN (SELECT fragment FROM top)""",
    "fragment_library": f"SELECT {_PLAIN.format(c='fragment_smiles')} AS fragment FROM selected_fragments WHERE (selected_by = 'threshold' OR was_added_by_cliff_pairs) AND contains({_PLAIN.format(c='fragment_smiles')}, '[*]') UNION SELECT '[H][*]'",
}
