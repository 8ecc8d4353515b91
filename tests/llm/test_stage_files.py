"""What the near and benchmark stages leave on disk, and how rows are told apart without a copy of them."""

import os

import corpus_pipeline
import numpy as np
import pytest

from wordfold.llm import decontaminate, io, set_join
from wordfold.session import shuffles_dropped

NEAR = [f"near{i}" for i in range(60)]
ROWS = [(5, " ".join(NEAR)), (4, " ".join([*NEAR[:30], "other", *NEAR[31:]])), (4, "another text of the same number"), (None, " ".join(NEAR)), (8, None), (7, "x y")]


def left_by(monkeypatch, run):
    """(what ``run`` gives, the names of the tables that it wrote and left)."""
    made, place = [], io.shared_dir
    with monkeypatch.context() as patch:
        patch.setattr(io, "shared_dir", lambda spark, name: made.append((name, place(spark, name))) or made[-1][1])
        found = run()
    return found, {name for name, path in made if os.path.exists(path.removeprefix("file:"))}


def test_places_in_files_are_told_apart(spark, monkeypatch):
    docs = io.written(spark.createDataFrame([(n % 7, f"text {n}") for n in range(500)], "doc_id long, text string").repartition(5), "some-rows")
    numbered, left = left_by(monkeypatch, lambda: io.numbered(docs, "copied", True))
    assert left == set()
    rows = [(r.place, r.doc.text) for r in numbered.collect()]
    assert len({p for p, _ in rows}) == 500 and {t for _, t in rows} == {f"text {n}" for n in range(500)}
    assert sorted(rows) == sorted((r.place, r.doc.text) for r in numbered.repartition(3).collect())


@pytest.mark.parametrize("stored", [True, False])
def test_near_stage_leaves_no_tables_of_sets(spark, monkeypatch, stored):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    docs = io.written(docs, "near-input") if stored else docs
    found, left = left_by(monkeypatch, lambda: set_join.first_documents(docs, 5, 80, stored))
    assert left == {"set-join-away"} | (set() if stored else {"set-join-rows"})
    assert sorted((r.doc_id or 0, r.text or "") for r in found.collect()) == sorted((d or 0, t or "") for d, t in ROWS[1:])


def test_stages_do_not_copy_what_is_written(spark, monkeypatch, sf):
    docs = io.written(io.documents(spark, sf).limit(50), "stage-input")
    _, left = left_by(monkeypatch, lambda: corpus_pipeline.benchmark(spark, docs, sf))
    assert not any("rows" in x for x in left)
    items = spark.createDataFrame([(7, " ".join(f"item{i}" for i in range(30)))], "item_id long, text string")
    assert decontaminate.clean_documents(docs, items, stored=True).count() == 50


def test_long_sets_get_sketches_that_tell_them_apart():
    rng = np.random.default_rng(3)
    parts = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (3000, 3100, 40)]
    sets = set_join.Sets.__new__(set_join.Sets)
    sets.grams, sets.owner, sets.sizes = np.concatenate(parts), np.repeat(np.arange(3), [len(p) for p in parts]), np.array([len(p) for p in parts])
    bits = [np.frombuffer(x, np.uint8)[None] for x in set_join.sketches_of(sets)]
    assert [8 * x.shape[1] for x in bits] == [8192, 8192, set_join.BITS]
    a, b = sets.sizes[:1], sets.sizes[1:2]
    assert not set_join.may_link(bits[0], bits[1], a, b, 80).any()
    for part, width in ((parts[0][:2000], 4096), (parts[0][100:], 8192)):
        other = set_join.Sets.__new__(set_join.Sets)
        other.grams, other.owner, other.sizes = part, np.zeros(len(part), int), np.array([len(part)])
        bit = np.frombuffer(set_join.sketches_of(other)[0], np.uint8)[None]
        assert 8 * bit.shape[1] == width
        assert (set_join.folded(bits[0], bit.shape[1]) | bit == set_join.folded(bits[0], bit.shape[1])).all()


def test_shuffle_setting_is_put_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == before
