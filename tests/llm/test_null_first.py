from wordfold.llm import set_join


def test_null_row_before_a_valid_copy(spark):
    """A row without doc_id has no effect on the copies after it in a slice."""
    near = [f"near{i}" for i in range(120)]
    changed = [*near[:60], "other", *near[61:]]
    rows = [(None, " ".join(near)), (1, " ".join(near)), (2, " ".join(changed))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.component_id for r in set_join.join_components(docs).collect()}
    assert found == {None: None, 1: 1, 2: 1}
