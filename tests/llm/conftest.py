import random

import pytest

from wordfold.llm import io

#: Columns whose names the operators use themselves.
CLASHING = ["part", "row", "hash", "entry", "block", "kind", "ids", "sizes", "base", "spans", "set", "bucket", "shard", "doc", "lang"]


@pytest.fixture(scope="session")
def documents(spark, sf):
    """The smallest table's documents as a dictionary of texts."""
    return {r.doc_id: r.text for r in io.documents(spark, sf).select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, a long text, ties, repeated rows, null ids."""
    rng = random.Random(5)
    words = [f"word{rng.randrange(400)}" for _ in range(9000)]
    long = " ".join(words)
    passage = " ".join(f"shared{i}" for i in range(30))
    near = [f"near{i}" for i in range(120)]
    changed = [*near[:60], "other", *near[61:]]
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, long), (5, long + " end"), (6, long), (7, "A b"), (8, "a B"), (9, "a b c"),
            (10, passage), (11, "before " + passage + " after"), (12, passage), (12, passage), (13, "x"), (13, "y"),
            (14, " ".join(near)), (15, " ".join(changed)), (16, "é ü 日本 語 ½ ²"), (17, "12 34 !!"), (18, "tab\tand  two spaces\x00nul"),
            (None, passage), (None, None), (19, "mail a.b@c.de now"), (20, "mail a.b@c.de later")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with columns named like the operators' own; some null."""
    names = ", ".join(f"{c} string" for c in CLASHING)
    rows = [(*r, *[None if n % 3 else f"{c}{n}" for c in CLASHING]) for n, r in enumerate(odd_rows)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {names}").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
