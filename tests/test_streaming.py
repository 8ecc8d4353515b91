"""Streaming counts equal batch counts over the same documents."""

import tempfile

from wordfold.operators import corpus
from wordfold.plans import fixtures as fx
from wordfold.plans.ppmi import CorpusParams, counts_from_lines
from wordfold.sources.text import read_corpus
from wordfold.streaming.counts import start_count_stream, total_counts


def test_stream_equals_batch(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    root = tempfile.mkdtemp(prefix="wf-stream-", dir="/tmp")
    src = f"{root}/src"
    docs.where("doc_id % 2 = 0").write.parquet(f"{src}/part=a")
    docs.where("doc_id % 2 = 1").write.parquet(f"{src}/part=b")
    p = CorpusParams(thr=5, win=2, sub=1e-3, delete=True)
    lines = read_corpus(docs)
    voc = corpus.subsample_prob(corpus.vocab(lines, p.thr), p.sub)
    q = start_count_stream(spark, f"{src}/*", voc, p, f"{root}/sink", f"{root}/ckpt")
    q.awaitTermination(300)
    got = total_counts(spark, f"{root}/sink")
    want = counts_from_lines(lines, p, materialize=False)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
