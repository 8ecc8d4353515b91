"""Incremental co-occurrence counts over a stream of documents.

New documents arrive as Parquet files (doc_id, text). Counts are additive over
documents, so each micro-batch runs the batch plan (lines -> masked tokens ->
windows -> counts) against a *fixed* vocabulary with drop probabilities and
writes its partial counts under ``epoch=N``. The write overwrites only that
partition, so a micro-batch replayed after a failure does not double count.
``total_counts`` folds the partials with one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordfold.operators import corpus
from wordfold.plans.ppmi import CorpusParams
from wordfold.session import cut_lineage
from wordfold.sources.text import read_corpus

DOC_SCHEMA = "doc_id long, text string"


def start_count_stream(spark: SparkSession, source_dir: str, vocab_p: DataFrame, p: CorpusParams,
                       sink_dir: str, checkpoint_location: str, available_now: bool = True):
    """Start the query; ``vocab_p`` is (word, p_drop) from :func:`corpus.subsample_prob`.

    Like the batch plan, tokens travel as vocabulary ids (written once, so
    every micro-batch and every retry sees the same ids) and each micro-batch
    decodes its reduced counts to strings before writing them."""
    vocab_p = cut_lineage(corpus.with_token_ids(vocab_p.select("word", "p_drop")), "stream-vocab")
    n_vocab = vocab_p.count()
    docs = spark.readStream.schema(DOC_SCHEMA).parquet(source_dir)

    def run_batch(batch: DataFrame, epoch_id: int) -> None:
        lines = read_corpus(batch.select("doc_id", "text"))
        kept = corpus.mask_tokens(lines, vocab_p, p.seed, p.chunk_tokens, vocab_rows=n_vocab, token_col="wid")
        pairs = corpus.window_pairs(kept, p.win, p.dyn, p.positional, p.delete, p.seed, p.chunk_tokens, encoded=True)
        counts = corpus.decode_counts(corpus.pair_counts(pairs), vocab_p, p.win, p.positional, vocab_rows=n_vocab)
        (counts.withColumn("epoch", F.lit(int(epoch_id)))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("epoch").parquet(sink_dir))

    writer = docs.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def total_counts(spark: SparkSession, sink_dir: str) -> DataFrame:
    """(word, context, n) summed over all written micro-batches."""
    return spark.read.parquet(sink_dir).groupBy("word", "context").agg(F.sum("n").alias("n"))
