"""The corpus pipeline: from documents to token ids, in stages that each work on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and rereads as the next one's docs. All but the last return the columns of documents.
SQL cannot express tokenisers, so there is no ORACLE_SQL; tests hold run() against the stages' brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontamination, near_dedup, pii, quality
from palimpsest.llm.common import ascii_lower, cut, ship


def beside(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one, `_row`: whatever they are called, what an operator adds does not meet them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, (F.struct(*others) if others else F.lit(True)).alias("_row"))


def back(frame: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of docs, in their order."""
    return frame.select(*[F.col(c) if c in needed else F.col("_row").getField(c).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject: null and empty texts too, which have no words. Each row is judged alone, so repeated rows stay or go together; an empty table stays empty, other columns as they are."""
    ship(spark)
    return back(quality.judge(beside(docs, "text", "lang")).where("kept"), docs, "text", "lang")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, and one row of those with equal doc_id and words (in lower case).

    Rows without doc_id are compared by their words alone: they go where a row with doc_id has the same, else one of them stays. Texts without words are near nothing and stay, once a doc_id. Other columns stay as they are.
    """
    ship(spark)
    words = F.sha2(ascii_lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))), 256)
    gone = cut(near_dedup.components(docs).where("not kept and doc_id is not null").select("doc_id").distinct())
    seen = docs.select("doc_id", words.alias("words")).groupBy("doc_id", "words").agg(F.count("*").alias("n"))
    rows = docs.select("doc_id", words.alias("words"), F.struct("*").alias("row")).join(gone, "doc_id", "left_anti")
    if seen.where("n > 1 or doc_id is null").isEmpty():
        return rows.select("row.*")
    once = rows.dropDuplicates(["doc_id", "words"])
    nameless = once.where("doc_id is null").join(seen.where("doc_id is not null").select("words").distinct(), "words", "left_anti")
    return once.where("doc_id is not null").select("row.*").unionByName(nameless.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which an item of the benchmark was found; null and empty texts have none and stay, as do repeated rows and all of an empty benchmark's. Other columns stay as they are."""
    ship(spark)
    found = decontamination.find_leaks(beside(docs, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return back(found.where(F.coalesce(F.size("leaks"), F.lit(0)) <= 0), docs, "text")


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [KIND] in place of personal data; n_chars follows the text. A null text stays null, as does its n_chars; other columns stay as they are, and every row stays."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.when(F.col("text").isNull(), F.col("n_chars")))) if "n_chars" in docs.columns else out


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes again: token_ids (little-endian unsigned 32-bit numbers) with digests of both directions, in place of the text.

    A null or empty text has no ids; repeated rows are encoded each. A column of docs that is called like one of these keeps its values under its name and a line after it (n_tokens_).
    """
    ship(spark)
    made = ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids")
    out = bpe.encode(beside(docs, "text"), decoded=True)
    rest = []
    for c in (c for c in docs.columns if c != "text"):
        name = c
        while name.lower() in made or (name != c and name in docs.columns):
            name += "_"
        rest.append(F.col("_row").getField(c).alias(name))
    return out.select(*rest, (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "token_ids")


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup_stage), ("decontamination", decontaminate), ("pii", redact_pii), ("bpe", encode_bpe)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
