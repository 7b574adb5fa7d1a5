"""Similarity, cliffs and splits: molecules of fragment_membership with the potency of removed_compounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import preparation as P
from ..operators import similarity as S
from ..operators import splits
from ..store import Scratch
from ..tables import table
from .preparation import SQL_BOTH, SQL_KEY


def plain_fragment(fragment: Column) -> Column:
    """Every numbering of an attachment point reads ``[*]``; fragments without one stay as they are."""
    return F.nullif(F.regexp_replace(F.trim(fragment), r"\[(?:\d+\*|\*:\d+|\d+\*:\d+)\]", "[*]"), F.lit(""))


def attached_fragment(fragment: Column) -> Column:
    """As ``plain_fragment``, but a fragment without an attachment point is none."""
    plain = plain_fragment(fragment)
    return F.when(plain.contains("[*]"), plain)


def molecule_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(key, tok): fragments as they are spelled; ``plain_fragment`` takes them to tokens."""
    return S.tokens(table(spark, folder, "fragment_membership"), "mol_id", F.col("fragment"))


def numbered_molecules(spark: SparkSession, folder: str) -> DataFrame:
    """(key, toks): as ``molecule_sets``, with a number for each token."""
    return S.numbered_sets(molecule_tokens(spark, folder), Scratch(spark, "numbered"), plain_fragment).withColumnRenamed("s", "toks")


def molecule_sets(spark: SparkSession, folder: str) -> DataFrame:
    return S.item_sets(table(spark, folder, "fragment_membership"), "mol_id", plain_fragment(F.col("fragment")))


def potency(spark: SparkSession, folder: str) -> DataFrame:
    """(key, p): mean pIC50 of a molecule's records, found by identifier, however written, else by structure.

    Records are summed up by what they say of their compound before they meet the registry, so no key is hot.
    """
    said = P.compound_key(F.col("chembl_id"), F.col("canonical_smiles")).alias("compound_key")
    records = table(spark, folder, "removed_compounds").where("standard_value > 0 and not isnan(standard_value)").select("record_id", said, "standard_value").where("compound_key is not null").distinct()
    sums = records.groupBy("compound_key").agg(F.sum(P.pic50(F.col("standard_value"))).alias("s"), F.count("*").alias("n"))
    known = P.both_keys(table(spark, folder, "chemical_space"), "mol_id", "chembl_id", "canonical_smiles")
    return sums.join(known, "compound_key").groupBy("key").agg((F.sum("s") / F.sum("n")).alias("p"))


def similar_molecules(spark: SparkSession, folder: str) -> S.Similar:
    return S.similar_classes(molecule_tokens(spark, folder), S.CLIFF_SIMILARITY, plain_fragment)


def cliff_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return S.cliffs(molecule_tokens(spark, folder), potency(spark, folder), clean=plain_fragment)


def activity_cliffs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cliff_pairs(spark, folder)
    return pairs.select(F.col("a").alias("mol_i"), F.col("b").alias("mol_j"), *[F.round(c, 6).alias(n) for c, n in (("sim", "sim"), ("delta", "delta_p"), ("sali", "sali"))])


def sali_landscape(spark: SparkSession, folder: str) -> DataFrame:
    """Every molecule whose mol_id is divisible by 20 against all molecules, however dissimilar, with SALI."""
    rows = Scratch(spark, "landscape").save(numbered_molecules(spark, folder).join(S.known_response(potency(spark, folder)), "key").select("key", "toks", "p"), "rows")
    queries = rows.where("key % 20 = 0").toDF("q", "qtoks", "qp")
    delta = F.abs(F.col("qp") - F.col("p"))
    met = S.against_all(queries, rows)
    return met.select(F.col("q").alias("mol_i"), F.col("key").alias("mol_j"), F.round("sim", 6).alias("sim"), F.round(delta, 6).alias("delta"), F.round(S.sali(F.col("sim"), delta), 6).alias("sali"))


def similarity_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return S.neighbor_counts(similar_molecules(spark, folder)).withColumnRenamed("key", "mol_id")


def similarity_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every molecule with a fragment, its class of equal sets, the copies in it and its number of similar molecules."""
    found = similar_molecules(spark, folder)
    counts = S.neighbor_counts(found)
    return found.members.join(counts, "key", "left").select(F.col("key").alias("mol_id"), F.col("rep").alias("class_id"), "copies", F.coalesce("n_neighbors", F.lit(0)).alias("n_links"))


def cliff_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Every molecule with a potency, and whether it is an end of a cliff."""
    marked = S.ends(cliff_pairs(spark, folder)).withColumn("hit", F.lit(1))
    return potency(spark, folder).join(marked, "key", "left").select(F.col("key").alias("mol_id"), F.col("hit").isNotNull().alias("in_cliff"))


def cliff_components(spark: SparkSession, folder: str) -> DataFrame:
    return S.class_components(similar_molecules(spark, folder)).select(F.col("key").alias("mol_id"), F.col("group_key").alias("group_id"))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return potency(spark, folder).withColumn("y", P.label_ge(F.col("p"), 1000.0))


def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.stratified(_labelled(spark, folder), "key", "y", 0.2).select(F.col("key").alias("mol_id"), "y", "part")


def cliff_train_max(spark: SparkSession, folder: str) -> DataFrame:
    flagged = _labelled(spark, folder).join(cliff_nodes(spark, folder).withColumnRenamed("mol_id", "key"), "key")
    return splits.cliffs_in_train(flagged, "key", "y", "in_cliff", 0.2).select(F.col("key").alias("mol_id"), "in_cliff", "part")


def labelled_groups(spark: SparkSession, folder: str, found: S.Similar | None = None) -> DataFrame:
    """(key, p, y, group_id): labelled molecules and their components; a molecule without one is its own."""
    groups = S.class_components(found or similar_molecules(spark, folder)).withColumnRenamed("group_key", "group_id")
    return _labelled(spark, folder).join(groups, "key", "left").withColumn("group_id", F.coalesce("group_id", "key"))


def group_split(spark: SparkSession, folder: str) -> DataFrame:
    """Train and test parts that share no component, of the best of 256 draws."""
    return splits.grouped(labelled_groups(spark, folder), "key", "y", "group_id", 0.2).select(F.col("key").alias("mol_id"), "group_id", "part")


QUERIES = {f.__name__: f for f in (activity_cliffs, sali_landscape, similarity_neighbors, similarity_classes, cliff_nodes, cliff_components, stratified_split, cliff_train_max, group_split)}

_HASH = "(({k} * 7919 + 104729) % 1000003)"
_BASE = (
    r"""m AS (SELECT DISTINCT mol_id, nullif(regexp_replace(trim(fragment), '\[(?:\d+\*|\*:\d+|\d+\*:\d+)\]', '[*]', 'g'), '') AS tok FROM fragment_membership WHERE mol_id IS NOT NULL),
  t AS (SELECT * FROM m WHERE tok IS NOT NULL), n AS (SELECT mol_id, count(*) AS n FROM t GROUP BY mol_id),
  o AS (SELECT a.mol_id AS a, b.mol_id AS b, count(*) AS o FROM t a JOIN t b ON a.tok = b.tok AND a.mol_id < b.mol_id GROUP BY 1, 2),
  s AS (SELECT a, b, o / (x.n + y.n - o) AS sim FROM o JOIN n x ON x.mol_id = a JOIN n y ON y.mol_id = b),
  """
    + f"""r AS (SELECT DISTINCT record_id, {SQL_KEY} AS compound_key, standard_value FROM removed_compounds WHERE standard_value > 0 AND NOT isnan(standard_value)),
  p AS (SELECT mol_id, avg(-log10(standard_value * 1e-9)) AS p FROM {SQL_BOTH} JOIN r USING (compound_key) GROUP BY 1),
  d AS (SELECT a, b, sim, abs(x.p - y.p) AS delta FROM s JOIN p x ON x.mol_id = a JOIN p y ON y.mol_id = b),
  k AS (SELECT * FROM d WHERE sim >= 0.8 - 1e-12 AND delta >= 1)"""
)
COMPONENTS_SQL = """e AS (SELECT a, b FROM s WHERE sim >= 0.8 - 1e-12 UNION SELECT b, a FROM s WHERE sim >= 0.8 - 1e-12),
        c AS (SELECT a AS mol_id, a AS g FROM e UNION SELECT e.b, c.g FROM c JOIN e ON e.a = c.mol_id WHERE c.g < e.b)"""
_TEST = "(((group_id * 7919 + 104729 + 15485863 * {t}) % 1000003) * ((group_id * 7919 + 104729 + 15485863 * {t}) % 1000003)) % 1000003 < 200000"
_ENDS = "(SELECT a AS mol_id FROM k UNION SELECT b FROM k)"
_SPLIT = "CASE WHEN row_number() OVER (PARTITION BY y ORDER BY {h}, mol_id) <= floor(count(*) OVER (PARTITION BY y) * 0.2) THEN 'test' ELSE 'train' END"
ORACLE_SQL = {
    "activity_cliffs": f"WITH {_BASE} SELECT a AS mol_i, b AS mol_j, round(sim, 6) AS sim, round(delta, 6) AS delta_p, round(delta / (1 - sim + 1e-6), 6) AS sali FROM k",
    "sali_landscape": f"""WITH {_BASE}, w AS (SELECT a, b, sim FROM s UNION ALL SELECT b, a, sim FROM s), h AS (SELECT p.* FROM p JOIN n USING (mol_id)),
        g AS (SELECT x.mol_id AS a, y.mol_id AS b, coalesce(sim, 0) AS sim, abs(x.p - y.p) AS delta FROM h x JOIN h y ON x.mol_id % 20 = 0 AND x.mol_id <> y.mol_id LEFT JOIN w ON w.a = x.mol_id AND w.b = y.mol_id)
        SELECT a AS mol_i, b AS mol_j, round(sim, 6) AS sim, round(delta, 6) AS delta, round(delta / (1 - sim + 1e-6), 6) AS sali FROM g""",
    "similarity_classes": f"""WITH {_BASE}, f AS (SELECT mol_id, list(tok ORDER BY tok) AS toks FROM t GROUP BY 1), g AS (SELECT mol_id, min(mol_id) OVER (PARTITION BY toks) AS class_id, count(*) OVER (PARTITION BY toks) AS copies FROM f),
        e AS (SELECT a AS mol_id FROM s WHERE sim >= 0.8 - 1e-12 UNION ALL SELECT b FROM s WHERE sim >= 0.8 - 1e-12)
        SELECT g.*, (SELECT count(*) FROM e WHERE e.mol_id = g.mol_id) AS n_links FROM g""",
    "similarity_neighbors": f"WITH {_BASE} SELECT mol_id, count(*) AS n_neighbors FROM (SELECT a AS mol_id FROM s WHERE sim >= 0.8 - 1e-12 UNION ALL SELECT b FROM s WHERE sim >= 0.8 - 1e-12) GROUP BY 1",
    "cliff_nodes": f"WITH {_BASE} SELECT mol_id, mol_id IN (SELECT mol_id FROM {_ENDS}) AS in_cliff FROM p",
    "cliff_components": f"WITH RECURSIVE {_BASE}, {COMPONENTS_SQL} SELECT mol_id, min(g) AS group_id FROM c GROUP BY 1",
    "cliff_train_max": f"""WITH {_BASE}, l AS (SELECT mol_id, CAST(p >= 6 AS INT) AS y, mol_id IN (SELECT mol_id FROM {_ENDS}) AS in_cliff FROM p),
        q AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_HASH.format(k='mol_id')}, mol_id) AS rn, count(*) OVER (PARTITION BY y) AS n FROM l WHERE NOT in_cliff),
        f AS (SELECT least(1.0::DOUBLE, floor(count(*) * 0.2) / nullif(count(*) FILTER (WHERE NOT in_cliff), 0)) AS share FROM l)
        SELECT mol_id, in_cliff, CASE WHEN rn <= floor(n * share) THEN 'test' ELSE 'train' END AS part FROM q, f UNION ALL SELECT mol_id, in_cliff, 'train' FROM l WHERE in_cliff""",
    "group_split": f"""WITH RECURSIVE {_BASE}, {COMPONENTS_SQL}, gid AS (SELECT mol_id, min(g) AS group_id FROM c GROUP BY 1), lab AS (SELECT mol_id, CAST(p >= 6 AS BIGINT) AS y, coalesce(group_id, mol_id) AS group_id FROM p LEFT JOIN gid USING (mol_id)),
        gs AS (SELECT group_id, sum(y) AS y, count(*) AS n FROM lab GROUP BY 1), tr AS (SELECT x AS trial, round(abs(sum(y) / sum(n) - (SELECT avg(y) FROM lab)), 9) AS off FROM gs, range(256) AS r(x) WHERE {_TEST.format(t='x')} GROUP BY 1),
        bt AS (SELECT trial FROM tr ORDER BY CASE WHEN off <= 0.02 THEN 0 ELSE off END, trial LIMIT 1)
        SELECT mol_id, group_id, CASE WHEN {_TEST.format(t='trial')} THEN 'test' ELSE 'train' END AS part FROM lab, bt""",
    "stratified_split": f"WITH {_BASE}, l AS (SELECT mol_id, CAST(p >= 6 AS INT) AS y FROM p) SELECT mol_id, y, {_SPLIT.format(h=_HASH.format(k='mol_id'))} AS part FROM l",
}
