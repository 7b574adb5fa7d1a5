"""Queries of the training-data operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Scratch
from ..tables import table
from . import groups, mixing, packing, personal, representatives, set_join, tokens, varied_subset
from .oracle import ORACLE_SQL  # noqa: F401 (read by the entry module)

#: How many molecules the varied subset asks for.
SUBSET_SIZE = 500


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The record that supplies the surviving value of each compound and field."""
    read = lambda name: table(spark, folder, name)
    best = representatives.best_readings(read("removed_compounds"), read("chemical_space"), read("data_sources"))
    return best.select("chembl_id", "field_name", "record_id")


def p1_merged_records(spark: SparkSession, folder: str) -> DataFrame:
    read = lambda name: table(spark, folder, name)
    merged = representatives.merged_records(read("removed_compounds"), read("chemical_space"), read("data_sources")).drop("compound")
    return merged.select(*[F.col(c).cast("double").alias(c) if c == "is_active" or c.endswith("_from") else c for c in merged.columns])


def p1_top_records(spark: SparkSession, folder: str) -> DataFrame:
    read = lambda name: table(spark, folder, name)
    return representatives.top_records(read("removed_compounds"), read("chemical_space"), read("data_sources"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Series of linked molecules: (group_mol, mol)."""
    return groups.consolidate(table(spark, folder, "activity_cliffs"), "mol_i", "mol_j")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Molecules whose fragment sets are similar: (mol_a, mol_b)."""
    pairs = set_join.similar_pairs(table(spark, folder, "fragment_membership"), "mol_id", F.col("fragment"), clean=set_join.fragment_token)
    return pairs.select(F.col("mol_i").alias("mol_a"), F.col("mol_j").alias("mol_b"))


def p6_similar_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return set_join.similar_pairs(table(spark, folder, "fragment_membership"), "mol_id", F.col("fragment"), clean=set_join.fragment_token)


def p6_similar_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Every molecule with its class of equal fragment sets, the copies in it and its number of similar molecules."""
    return set_join.linked_members(table(spark, folder, "fragment_membership"), "mol_id", F.col("fragment"), clean=set_join.fragment_token)


def p5_varied_subset(spark: SparkSession, folder: str) -> DataFrame:
    """SUBSET_SIZE hits of good score that cover the variety of structures and cores."""
    return varied_subset.varied_subset(table(spark, folder, "hits"), SUBSET_SIZE)


def p5_checks(spark: SparkSession, folder: str) -> DataFrame:
    """One row: how many molecules were drawn, how many different ones, and how many hits hold none of the drawn rows."""
    hits = table(spark, folder, "hits").select("hit_id", "smiles").distinct()
    drawn = p5_varied_subset(spark, folder).select("hit_id", F.col("smiles").alias("drawn"))
    same = F.coalesce(F.trim("smiles") == F.col("drawn"), F.lit(False))
    return drawn.join(hits, "hit_id", "left").agg(F.countDistinct("hit_id").alias("n"), F.countDistinct("drawn").alias("n_structures"), F.count(F.when(~same, 1)).alias("n_strange"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text, or of each piece of one, under every budget."""
    return packing.pack(tokens.token_lengths(table(spark, folder, "documents")), table(spark, folder, "pack_budgets"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, folder), table(spark, folder, "pack_budgets"))


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per budget: texts placed, containers beyond their capacity, texts cut without need, texts with a piece missing or twice."""
    packed = Scratch(spark, "checks").save(p7_containers(spark, folder), "packed")
    budgets = F.broadcast(table(spark, folder, "pack_budgets"))  # a row per budget
    boxes = packed.groupBy("budget_name", "container_no").agg(F.sum("n_tokens").alias("n")).join(budgets, "budget_name")
    texts = packed.groupBy("budget_name", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.countDistinct("start_token").alias("starts"), F.max(F.col("start_token") + F.col("n_tokens")).alias("stop")).join(budgets, "budget_name")
    over = boxes.groupBy("budget_name").agg(F.count(F.when(F.col("n") > F.col("capacity_tokens"), 1)).alias("n_overfull"))
    kept = texts.groupBy("budget_name").agg(
        F.count("*").alias("n_texts"), F.count(F.when((F.col("n") <= F.col("capacity_tokens")) & (F.col("pieces") > 1), 1)).alias("n_cut"), F.count(F.when((F.col("stop") != F.col("n")) | (F.col("starts") != F.col("pieces")), 1)).alias("n_broken")
    )
    return kept.join(over, "budget_name").select("budget_name", "n_texts", "n_overfull", "n_cut", "n_broken")


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Posts in the order and number in which they enter the mixture."""
    return mixing.mix(tokens.token_lengths(table(spark, folder, "documents"), keep=("source",)), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.share_report(p8_mixture(spark, folder), table(spark, folder, "mix_targets"))


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per target: posts repeated beyond the cap, copies that occur twice, and posts that are no posts of the source."""
    mixed = Scratch(spark, "checks").save(p8_mixture(spark, folder), "mixture")
    posts = table(spark, folder, "documents").where("text <> ''").select("doc_id", F.col("source").alias("own"))
    told = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("repeat_no").alias("k")).join(posts, "doc_id", "left")
    targets = table(spark, folder, "mix_targets")
    wrong = told.join(F.broadcast(targets.select(F.col("doc_source").alias("source"), "max_repeats")), "source").groupBy("source").agg(
        F.count(F.when(F.col("n") > F.col("max_repeats"), 1)).alias("n_beyond"), F.count(F.when(F.col("n") != F.col("k"), 1)).alias("n_twice"), F.count(F.when(~F.coalesce(F.col("own") == F.col("source"), F.lit(False)), 1)).alias("n_strange")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return targets.select("doc_source").join(wrong.withColumnRenamed("source", "doc_source"), "doc_source", "left").select("doc_source", zero("n_beyond"), zero("n_twice"), zero("n_strange"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Personal items of every document: (doc_id, pii_type, pii_text)."""
    return personal.personal_items(table(spark, folder, "documents"))


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with placeholders in place of personal items."""
    return personal.redacted_texts(table(spark, folder, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_merged_records": p1_merged_records,
    "p1_top_records": p1_top_records,
    "p4_found": p4_found,
    "p5_varied_subset": p5_varied_subset,
    "p5_checks": p5_checks,
    "p6_found": p6_found,
    "p6_similar_pairs": p6_similar_pairs,
    "p6_similar_sets": p6_similar_sets,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p7_checks": p7_checks,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_checks": p8_checks,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}
