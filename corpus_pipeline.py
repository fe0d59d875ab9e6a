"""From raw documents to a mixed training set: five stages over the whole corpus.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes every stage's rows
to the shared folder and reads them again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import decontaminate, language_id, minhash_dedup, mixing, substring_dedup
from metricloom.llm.words import fresh
from metricloom.session import materialize, prepare

c = F.col
MIN_SHARE = 0.15  # of a text's n-grams that its language must have; prose of any length has far more
SHINGLE, PERCENT = 5, 80
PASSAGE = 35

# A learned mixture and its text may hold any rows; stages are not written as SQL.
ORACLE_SQL = None


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts and those without letters or of no known language go."""
    model = language_id.fit(docs.where(~language_id.held_out(c("doc_id"))))
    seen = language_id.identify(docs, model)
    good = (c("lang_pred") != language_id.UNKNOWN) & (c("lang_share") >= MIN_SHARE)
    return seen.where(good).select(*[c(f"`{x}`") for x in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; of rows that repeat a key and a text, one."""
    groups = minhash_dedup.near_duplicates(docs, length=SHINGLE, percent=PERCENT)
    marks = groups.groupBy(c("doc_id").alias("_key")).agg(F.bool_or("kept").alias("_kept"), (F.count("*") > 1).alias("_again"))
    marks = materialize(marks.where("_kept").select("_key", "_again"), "pipeline-kept")
    own = [docs[f"`{x}`"] for x in docs.columns]
    (again,) = fresh(docs.columns, "_again")
    kept = docs.join(marks, docs["doc_id"].eqNullSafe(marks["_key"])).select(*own, marks["_again"].alias(again))
    if marks.where("_again").isEmpty():
        return kept.drop(again)
    # only rows whose key repeats are compared with each other
    once = kept.where(c(again)).dropDuplicates(["doc_id", "text"])
    return kept.where(~c(again)).union(once).drop(again)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur elsewhere; a text that is all passage becomes empty."""
    out = substring_dedup.remove_repeats(docs, window=PASSAGE, joined=False)
    text = F.when(c("text").isNotNull(), c("kept"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*[c(f"`{x}`") for x in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; a null or empty text holds none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = materialize(decontaminate.find_leaks(docs, items).select("doc_id").distinct(), "pipeline-leaks")
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["doc_id"]), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with how often, and their source's target."""
    sized = docs.withColumn("size", mixing.word_count(c("text")))
    return mixing.mix_sources(sized).where("repeats > 0")


STAGES = [
    ("language_id", keep_languages),
    ("minhash_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("source_mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
