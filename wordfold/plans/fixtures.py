"""Inputs derived from the driver tables (see FIXTURES.md §2).

Everything here is a DataFrame plan over the parquet tables, so its work grows
with the tables. The SQL twins live in :mod:`wordfold.plans.sql_fixtures`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordfold.functions.rand import keyed_uniform, lit_key
from wordfold.functions.vec import to_double_array
from wordfold.session import spread_input
from wordfold.sources.text import read_corpus

# Fixed corpus settings used by the registered queries (the feasibility probe's).
THR = 5
WIN = 2
SUB = 1e-3
SEED = 17
CDS = 0.75
TEST_FRAC = 0.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_lines(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    if lang is not None:
        docs = docs.where(F.col("lang") == lang)
    return read_corpus(spread_input(docs.select("doc_id", "text")))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer x part matrix: (i = o_custkey, j = l_partkey, v = sum l_quantity)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .groupBy(F.col("o_custkey").alias("i"), F.col("l_partkey").alias("j"))
        .agg(F.sum("l_quantity").cast("double").alias("v"))
    )


def split_flag(seed: int = 7) -> F.Column:
    return keyed_uniform(lit_key("split"), lit_key(seed), "i", "j") < TEST_FRAC


def train_test(coo: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    flagged = coo.withColumn("_test", split_flag(seed))
    return flagged.where(~F.col("_test")).drop("_test"), flagged.where(F.col("_test")).drop("_test")


def event_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User x property-bucket matrix from events: (i = user_id, j = props.k, v = sum value)."""
    ev = table(spark, sf_dir, "events")
    return (
        ev.select(F.col("user_id").alias("i"), F.get_json_object("props", "$.k").cast("long").alias("j"), "value")
        .where(F.col("j").isNotNull())
        .groupBy("i", "j")
        .agg(F.sum("value").cast("double").alias("v"))
    )


def factor_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """W = even vec_ids, H = odd vec_ids, id = vec_id div 2, vec array<double>."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", to_double_array("embedding").alias("vec"))
    w = emb.where(F.col("vec_id") % 2 == 0).select((F.col("vec_id") / 2).cast("long").alias("id"), "vec")
    h = emb.where(F.col("vec_id") % 2 == 1).select(((F.col("vec_id") - 1) / 2).cast("long").alias("id"), "vec")
    return w, h


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as word vectors: word = 'w<vec_id>'."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), to_double_array("embedding").alias("vec"))


def wordsim_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(w1, w2, gold): pairs (vec_id, vec_id + 1); gold = same-label + hash tie-breaker,
    plus one pair with an unknown word."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    nxt = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("label2"))
    pairs = emb.join(nxt, "vec_id").select(
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("w1"),
        F.concat(F.lit("w"), (F.col("vec_id") + 1).cast("string")).alias("w2"),
        (F.when(F.col("label") == F.col("label2"), 1.0).otherwise(0.0)
         + keyed_uniform(lit_key("gold"), F.col("vec_id")) * 0.5).alias("gold"),
    )
    unknown = spark.range(1).select(F.lit("w0").alias("w1"), F.lit("unknown_word").alias("w2"), F.lit(0.25).alias("gold"))
    return pairs.unionByName(unknown)


def analogy_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, a, a_, b, b_): one hash-chosen quadruple per embedding row; the rows
    whose vec_id is a multiple of 250 ask about an unknown word."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id")
    n = emb.agg(F.max("vec_id").alias("m"))
    base = emb.crossJoin(F.broadcast(n))

    def pick(tag: str) -> F.Column:
        return F.concat(F.lit("w"), (F.floor(keyed_uniform(lit_key(tag), "vec_id") * (F.col("m") + 1))).cast("long").cast("string"))

    return base.select(
        F.col("vec_id").alias("qid"),
        F.when(F.col("vec_id") % 250 == 0, F.lit("nosuchword")).otherwise(pick("qa")).alias("a"),
        pick("qa_").alias("a_"),
        pick("qb").alias("b"),
        pick("qb_").alias("b_"),
    )
