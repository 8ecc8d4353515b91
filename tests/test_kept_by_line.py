"""Kept tokens of a line are numbered where they are read."""

import random

from wordfold.operators import corpus, windows
from wordfold.sources.text import read_corpus


def test_numbers_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(windows, "ROWS", 5)
    rng = random.Random(3)
    texts = [(d, "\n".join(" ".join(f"w{int(rng.paretovariate(0.7)) % 30}" for _ in range(rng.randrange(0, 30))) for _ in range(4))) for d in [*range(20), 3, 7, None, None]]
    lines = read_corpus(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).cache()
    voc = corpus.subsample_prob(corpus.vocab(lines, 3), 0.02)
    found = corpus.delete_placeholders(corpus.mask_tokens(lines, corpus.dense_token_ids(voc), 5))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    columns = ["doc_id", "line_no", "q", "pos", "word"]
    wanted = corpus.delete_placeholders(corpus.mask_tokens(lines, voc, 5))
    key = lambda r: tuple((x is None, x or 0) if k < 4 else x for k, x in enumerate(r))
    rows = [sorted((tuple(r) for r in df.where("doc_id is not null and doc_id not in (3, 7)").select(*columns).collect()), key=key) for df in (found, wanted)]
    assert rows[0] == rows[1] and rows[0]
    # repeated keys are one line; tokens without a document are kept, as in the SQL
    odd = [sorted(r.word for r in df.where("doc_id in (3, 7)").collect()) for df in (found, wanted)]
    assert odd[0] == odd[1] and found.where("doc_id is null").count() == corpus.mask_tokens(lines, voc, 5).where("doc_id is null").count()
