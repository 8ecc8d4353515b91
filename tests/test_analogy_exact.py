"""Analogies: single precision only picks what is scored exactly; blocks are few."""

import numpy as np
import pandas as pd

from wordfold.operators import evaluate


def test_near_ties_are_decided_exactly():
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(200, 16))
    vecs[100:] = vecs[:100] + rng.normal(size=(100, 16)) * 1e-9  # equal in single precision
    vecs[150] = vecs[50]
    vecs /= np.sqrt(np.square(vecs).sum(axis=1))[:, None]
    words = [f"w{i:03}" for i in range(200)]
    c = pd.DataFrame({"word": words, "vec": list(vecs)})
    ask = rng.integers(0, 200, (300, 3))
    q = pd.DataFrame({"qid": range(300), **{x: [words[i] for i in ask[:, k]] for k, x in enumerate(("a", "a_", "b"))},
                      **{x: list(vecs[ask[:, k]]) for k, x in enumerate(("va", "va_", "vb"))}})
    got = {(r.qid, r.method): (r.word, r.score) for r in evaluate._analogy_kernel(True)(q, c).itertuples()}
    a, a_, b = ((evaluate.block_scores(np.stack(q[x]), vecs) + 1.0) / 2.0 for x in ("va", "va_", "vb"))
    for method, total in (("add", -a + a_ + b), ("mul", a_ * b / (a + 0.01))):
        np.put_along_axis(total, ask, -np.inf, 1)
        best = total.argmax(axis=1)
        assert [got[k, method] for k in range(300)] == [(words[j], total[k, j]) for k, j in enumerate(best)]


def test_blocks_grow_with_the_rows(spark):
    few, many = (spark.range(n) for n in (1000, 600_000))
    assert evaluate._question_rows(few, few) == 256
    assert -(-600_000 // evaluate._question_rows(many, many)) <= 20  # was 147 blocks of 4096
