"""Sets of a piece meet its smallest one only where their sizes let them link."""

from wordfold.llm import set_join


def test_sizes_too_far_apart_are_not_compared(spark, monkeypatch):
    words = [f"w{i}" for i in range(100)]
    texts = [words, words[:20], words[16:], [*words[16:], "z"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept, written = {}, set_join.io.written
    monkeypatch.setattr(set_join.io, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    found = {r.doc_id: r.component_id for r in set_join.join_components(docs, 5, 80, rarest=True, placed=True).collect()}
    assert found == {0: 0, 1: 1, 2: 0, 3: 0}
    assert kept["set-join-fitting"].count() < kept["set-join-edges"].count()
    assert kept["set-join-sets"].count() == kept["set-join-sets"].select("set").distinct().count()
