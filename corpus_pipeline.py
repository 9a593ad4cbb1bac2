"""Corpus pipeline over ``documents``: quality rules, language ID, near-dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns rows that are written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``docs`` as they came. Columns that a stage adds for its own use
have names that ``docs`` doesn't have. An empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortroll.llm import language_id, packing, quality_rules, similar_texts
from cohortroll.session import keep

MAX_DISTANCE = 0.8  # of a document to the nearest language profile, as a share of the largest, where the learned documents set no lower one


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, with as many leading underscores as it takes for none to be a column of ``docs``."""
    taken, start = {c.lower() for c in docs.columns}, "_"
    while any(f"{start}{n}".lower() in taken for n in names):
        start += "_"
    return [f"{start}{n}" for n in names]


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules and all documents of hosts that mostly fail.

    Documents are judged once, one by one, and written with their verdict. Null texts fail, null hosts don't.
    """
    start = _free(docs, *quality_rules.NAMES)[0].removesuffix(quality_rules.NAMES[0])
    bad, of, host = _free(docs, "failed", "source_text", "host")
    judged = quality_rules.measured(docs, F.col("text"), start).withColumn(bad, quality_rules.failed(start))
    judged = keep(judged.select(*[F.col(f"`{c}`") for c in docs.columns], bad), "judged")
    hosts = quality_rules.host_verdicts(judged.select(F.col("source").cast("string").alias(host), bad), host, bad)
    rejected = hosts.where("host_failed").select(F.col("host").alias(host))
    kept = judged.where(~F.col(bad)).withColumn(of, F.col("source").cast("string"))
    return _back(quality_rules.join_hosts(kept, of, rejected, host, "left_anti"), docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that are far from every language's profile.

    Far is what lies beyond the nearest language's bound, which follows from the distances of the documents that its profile
    was learned from (``language_id.bounds``). Profiles are learned from all of the stage's documents whose language isn't null. If there are none, no document is
    far from any, and all stay.
    """
    found = _free(docs, "language")[0]
    profiles = language_id.learn(docs, "text", "lang")
    if not profiles.names:
        return docs
    result = F.col(found)
    most = {name: min(bound, MAX_DISTANCE) for name, bound in language_id.bounds(docs, profiles, "text", "lang").items()}
    bound = F.coalesce(F.create_map(*[F.lit(x) for pair in most.items() for x in pair])[result["lang_pred"]], F.lit(MAX_DISTANCE)) if most else F.lit(MAX_DISTANCE)
    named = docs.withColumn(found, language_id.identified(F.col("text"), profiles))
    return _back(named.where((result["lang_pred"] != language_id.UNKNOWN) & (result["distance"] <= bound)), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one of the smallest id, null ids last.

    Candidates are documents whose SimHash fingerprints hang together within two bits, found by pigeonring filtering as in
    ``op8_simhash``, and those that share a min-hash band. Of them those are linked whose distinct shingles of five words have a
    similarity of 0.8 or more; texts without words are one group. Rows that share the smallest id are told apart by a hash of the row, and rows that are equal in every column
    count once.
    """
    own, copies, id_of, hash_of, node = _free(docs, "hash", "copies", "id_of", "hash_of", "node")
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), hashed.alias("hash"))
    rows = keep(docs.select(key.alias("key"), similar_texts.sketched(F.col("text")).alias("s")).select("key", "s.*"), "sketches")
    alike = rows.groupBy("node", "key").agg(F.count("*").alias("n"))
    first = keep(alike.groupBy("node").agg(F.min(F.struct("key", "n")).alias("k")), "first")

    def of_rows(which: DataFrame) -> DataFrame:
        same = F.col("doc_id").eqNullSafe(F.col(id_of)) & (F.col(own) == F.col(hash_of))
        return docs.withColumn(own, hashed).join(which, same)

    members = similar_texts.key_members(rows)
    found = members.select("node").distinct().join(first, "node").select(
        F.col("k.key.doc_id").alias(id_of), F.col("k.key.hash").alias(hash_of), F.col("node").alias(node))
    texts = keep(of_rows(found).groupBy(F.col(node).alias("node")).agg(F.min("text").alias("text")), "candidate-texts")
    roots = keep(similar_texts.similar_roots(members, texts), "roots")
    chosen = keep(first.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("k").alias("k")).select(
        F.col("k.key.doc_id").alias(id_of), F.col("k.key.hash").alias(hash_of), F.col("k.n").alias(copies)), "chosen")
    repeated = chosen.where(F.col(copies) > 1)
    kept = _back(of_rows(chosen.where(F.col(copies) == 1)), docs)
    return kept if repeated.isEmpty() else kept.unionByName(_back(of_rows(repeated), docs).dropDuplicates())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, with_ids=False)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

# Fingerprints, components and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
