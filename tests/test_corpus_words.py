"""Text files read by words: places don't depend on the splits."""

import random
from collections import Counter

import pytest

from corpus_lines import lines_df
from wordfold.plans.ppmi import CorpusParams, counts_from_lines
from wordfold.sources.text import read_corpus_words


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A file of one long line; one of many lines, blank ones and tabs."""
    rng = random.Random(5)
    folder = tmp_path_factory.mktemp("corpus")
    one = " ".join(f"w{rng.randrange(60)}" for _ in range(60_000))
    many = "\n".join(rng.choice([" ".join(f"é{rng.randrange(40)}" for _ in range(rng.randrange(60))), "", "  a\tb ", "x"]) for _ in range(4000))
    (folder / "one.txt").write_text(one)
    (folder / "many.txt").write_text(many + "\n")
    return folder, [one, many]


@pytest.fixture(params=["40k", "128m"])
def splits(spark, request):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def placed(df):
    out = {}
    for r in df.collect():
        line = out.setdefault((r.doc_id, r.line_no), ({}, set()))
        line[0].update({r.start + n: t for n, t in enumerate(r.toks)})
        line[1].add(r.line_tokens)
    return out


def test_places_of_words(spark, files, splits):
    folder, texts = files
    lines = placed(read_corpus_words(spark, str(folder), piece_tokens=100))
    ids = {d for d, _ in lines}
    found = {frozenset((n, tuple(toks[k] for k in range(len(toks)))) for (d, n), (toks, sizes) in lines.items() if d == doc) for doc in ids}
    assert all(sizes == {len(toks)} and sorted(toks) == list(range(len(toks))) for toks, sizes in lines.values())
    assert found == {frozenset((n, tuple(line.split())) for n, line in enumerate(t.split("\n")) if line.split()) for t in texts}
    if splits == "40k":
        assert read_corpus_words(spark, str(folder)).select("doc_id").distinct().count() == 2
        assert spark.read.option("lineSep", " ").text(str(folder)).rdd.getNumPartitions() > 8


def test_pairs_are_those_of_the_array_form(spark, files, splits):
    folder, texts = files
    p = CorpusParams(thr=2, win=3, delete=False, sub=0.0, chunk_tokens=1000)
    got = counts_from_lines(read_corpus_words(spark, str(folder), piece_tokens=700), p, materialize=False)
    want = counts_from_lines(lines_df(spark, texts), p, materialize=False)
    assert Counter({(r.word, r.context): r.n for r in got.collect()}) == Counter({(r.word, r.context): r.n for r in want.collect()})


def test_a_word_as_long_as_the_file_and_none(spark, tmp_path):
    (tmp_path / "a.txt").write_text("nospacesatall")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.txt").write_text("  \n \n")
    rows = read_corpus_words(spark, str(tmp_path), lower=True).collect()
    assert [(r.line_no, r.start, r.line_tokens, r.toks) for r in rows] == [(0, 0, 1, ["nospacesatall"])]
