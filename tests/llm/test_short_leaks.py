import numpy as np
import pyarrow as pa

from wordfold.llm.decontaminate import Items, words


def test_documents_shorter_than_the_item():
    item = [f"item{i}" for i in range(20)]
    texts = [" ".join(item[:-1]), " ".join(item[1:]), " ".join(item[:15]), " ".join(item), "item0 item1", " ".join(item[:17])]
    found = Items(((7, " ".join(item)), (8, "one two"))).leaks(*words(pa.array(texts)))
    want = [(0, 15 / 16, 19), (1, 15 / 16, 19), (3, 1.0, 20), (5, 13 / 16, 17)]
    assert [(d, s, n) for d, i, s, first, n in found] == want and {(i, first) for _, i, _, first, _ in found} == {(7, 0)}
    assert np.all([s >= 0.8 for _, _, s, _, _ in found])
