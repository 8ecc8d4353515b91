"""Pipeline stages on rows with null and shared doc_ids."""

from collections import Counter

from test_operators import expected_components

from wordfold.llm import decontaminate, set_join

PASSAGE = " ".join(f"item{i}" for i in range(30))
NEAR = [f"near{i}" for i in range(60)]


def table(spark, rows):
    return spark.createDataFrame([(*r, f"x{n}") for n, r in enumerate(rows)], "doc_id long, text string, place string").repartition(3)


def test_leaking_rows_go_and_no_others(spark):
    rows = [(1, "clean text of one"), (1, f"leaks {PASSAGE}"), (None, PASSAGE), (None, "clean without number"), (2, None), (3, f"{PASSAGE} end")]
    items = spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")
    kept = decontaminate.clean_documents(table(spark, rows), items)
    assert kept.columns == ["doc_id", "text", "place"]
    assert sorted(r.place for r in kept.collect()) == ["x0", "x3", "x4"]


def test_one_row_of_each_component_stays(spark):
    changed = [*NEAR[:30], "other", *NEAR[31:]]
    rows = [(5, " ".join(NEAR)), (4, " ".join(changed)), (4, "quite another text of the same number"), (None, " ".join(NEAR)), (6, " ".join(NEAR)), (8, None), (9, ""), (7, "x y"), (7, "x y")]
    kept = [r.place for r in set_join.first_documents(table(spark, rows), 5, 80).collect()]
    assert {"x1", "x2", "x3", "x5", "x6"} <= set(kept) and len(set(kept) & {"x7", "x8"}) == 1 and len(kept) == 6


def test_rarest_keys_find_the_components_of_pieces(spark, odd_rows):
    rows = [(n, t) for n, (_, t) in enumerate(odd_rows)]
    for k in range(40):  # texts that share a passage only, and near copies of some
        own = [f"own{k % 20}word{i}" for i in range(40)]
        rows.append((100 + k, " ".join([*own[: 20 + k % 3], *NEAR[:12], *own[20:], "end" if k > 19 else ""])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for percent in (80, 60):
        found = Counter(tuple(r) for r in set_join.join_components(docs, 5, percent, rarest=True).collect())
        assert found == Counter(expected_components(rows, 5, percent))
