from wordfold.llm import sanitise


def test_terms_on_other_lines_reveal(spark):
    """A name on the line above a shared contact line is a candidate."""
    texts = [f"Zanzibar\nContact: bob@site.org\nplan{chr(97 + i)}" for i in range(5)]
    texts += [f"common words about\nnothing{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["zanzibar again"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [(sanitise.NAMES[s.kind], texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in sanitise.sanitise(docs).collect()}
    assert any(t == "Zanzibar" for _, t in spans[0]) and ("remove", "Contact") in spans[0] and ("email", "bob@site.org") in spans[0]
    assert any(t == "zanzibar" for _, t in spans[len(texts) - 1])
    assert all(not s for d, s in spans.items() if 5 <= d < len(texts) - 1)
