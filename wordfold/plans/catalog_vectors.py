"""Registered queries for vector queries G1-G16 and evaluation H1-H7."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wordfold.functions.rand import keyed_uniform, lit_key, sql_uniform
from wordfold.functions.text import tokens
from wordfold.operators import assoc, evaluate, lookup, vectors
from wordfold.plans import fixtures as fx
from wordfold.plans.catalog_corpus import C_CORPUS, P, _counts, _with, c_pairs
from wordfold.plans.sql_fixtures import analogy_cte, assoc_ctes, d, event_matrix_cte, factor_ctes, word_vectors_cte, wordsim_cte
from wordfold.session import cut_lineage

QUERIES = {}
SQL = {}
N = 10


def r6(c):
    return F.round(c, 6)


def exploded(df, key="word"):
    return df.select(key, F.posexplode("vec").alias("t", "x")).select(key, F.col("t").cast("long").alias("t"), r6(F.col("x")).alias("x"))


def sql_exploded(src: str, key: str = "word") -> str:
    return f"SELECT {key}, t, round(x, 6) AS x FROM (SELECT {key}, unnest(generate_series(0, len(vec) - 1)) AS t, unnest(vec) AS x FROM {src})"


def sql_norm(v: str) -> str:
    n = f"sqrt(list_sum(list_transform({v}, lambda y: y * y)))"
    return f"CASE WHEN {n} > 0 THEN list_transform({v}, lambda y: y / {n}) ELSE list_transform({v}, lambda y: y * 0.0) END"


def sql_dot(a: str, b: str) -> str:
    return f"coalesce(list_dot_product({a}, {b}), 0.0)"


def _wv(s, sf):
    return vectors.normalize_vectors(fx.word_vectors(s, sf))


WVN = word_vectors_cte() + f""",
wvn AS (SELECT word, {sql_norm('vec')} AS vec FROM wv)"""


# G1 normalize, G2 represent (unknown -> zeros), G3 similarity
QUERIES["normalize_vectors"] = lambda s, sf: exploded(_wv(s, sf))
SQL["normalize_vectors"] = _with(WVN) + sql_exploded("wvn")


def _gold_words(s, sf):
    g = fx.wordsim_gold(s, sf)
    return g.select(F.col("w1").alias("word")).union(g.select(F.col("w2").alias("word"))).distinct()


QUERIES["represent"] = lambda s, sf: exploded(vectors.represent(_gold_words(s, sf), _wv(s, sf), 64))
SQL["represent"] = _with(WVN, wordsim_cte()) + """,
words AS (SELECT w1 AS word FROM gold UNION SELECT w2 FROM gold),
rep AS (SELECT words.word, coalesce(wvn.vec, list_transform(generate_series(1, 64), lambda i: 0.0)) AS vec
        FROM words LEFT JOIN wvn USING (word))
""" + sql_exploded("rep")
QUERIES["similarity"] = lambda s, sf: vectors.similarity(fx.wordsim_gold(s, sf), _wv(s, sf)).select(
    "w1", "w2", r6(F.col("sim")).alias("sim"))
SQL["similarity"] = _with(WVN, wordsim_cte()) + f"""
SELECT g.w1, g.w2, round({sql_dot('a.vec', 'b.vec')}, 6) AS sim
FROM gold g LEFT JOIN wvn a ON a.word = g.w1 LEFT JOIN wvn b ON b.word = g.w2"""

# G4 closest: 10 nearest words of every word (query included)
QUERIES["closest"] = lambda s, sf: vectors.closest(_wv(s, sf).select("word"), _wv(s, sf), N).select(
    "query", F.col("rank").cast("long").alias("rank"), "word", r6(F.col("score")).alias("score"))
SQL["closest"] = _with(WVN) + f"""
SELECT query, rank, word, round(score, 6) AS score FROM (
  SELECT q.word AS query, c.word, list_dot_product(q.vec, c.vec) AS score,
         row_number() OVER (PARTITION BY q.word ORDER BY list_dot_product(q.vec, c.vec) DESC, c.word DESC) AS rank
  FROM wvn q, wvn c) WHERE rank <= {N}"""


# G5 ensemble, G6 concatenate over two overlapping hash slices of the embeddings
def _slices(s, sf):
    wv = fx.word_vectors(s, sf).withColumn("_u", keyed_uniform(lit_key("slice"), F.col("word")))
    return wv.where(F.col("_u") < 0.6).drop("_u"), wv.where(F.col("_u") >= 0.4).drop("_u")


SLICES = word_vectors_cte() + f""",
wu AS (SELECT word, vec, {sql_uniform("'slice'", 'word')} AS u FROM wv),
s1 AS (SELECT word, vec FROM wu WHERE u < 0.6),
s2 AS (SELECT word, vec FROM wu WHERE u >= 0.4)"""

QUERIES["ensemble"] = lambda s, sf: exploded(vectors.ensemble(*_slices(s, sf)))
SQL["ensemble"] = _with(SLICES) + f""",
ens0 AS (SELECT coalesce(s1.word, s2.word) AS word,
                CASE WHEN s1.vec IS NULL THEN s2.vec WHEN s2.vec IS NULL THEN s1.vec
                     ELSE list_transform(list_zip(s1.vec, s2.vec), lambda p: p[1] + p[2]) END AS vec
         FROM s1 FULL OUTER JOIN s2 USING (word)),
ens AS (SELECT word, {sql_norm('vec')} AS vec FROM ens0)
""" + sql_exploded("ens")
QUERIES["concatenate"] = lambda s, sf: exploded(vectors.concatenate(*_slices(s, sf)))
SQL["concatenate"] = _with(SLICES) + f""",
cat0 AS (SELECT word, list_concat(s1.vec, s2.vec) AS vec FROM s1 JOIN s2 USING (word)),
cat AS (SELECT word, {sql_norm('vec')} AS vec FROM cat0)
""" + sql_exploded("cat")


# G7 context vectors, G8 first-order similarity, G9 closest contexts (W/H factor tables)
def _wc(s, sf):
    w, h = fx.factor_tables(s, sf)
    name = lambda df: df.select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("word"), "vec")
    return vectors.normalize_vectors(name(w)), vectors.normalize_vectors(name(h))


WC = factor_ctes() + f""",
wn AS (SELECT 'x' || CAST(id AS VARCHAR) AS word, {sql_norm('vec')} AS vec FROM wf),
cn AS (SELECT 'x' || CAST(id AS VARCHAR) AS word, {sql_norm('vec')} AS vec FROM hf)"""

QUERIES["context_vectors"] = lambda s, sf: exploded(vectors.context_vectors(*_wc(s, sf)))
SQL["context_vectors"] = _with(WC) + sql_exploded("cn")


def _event_pairs(s, sf):
    m = fx.event_matrix(s, sf)
    return m.select(F.concat(F.lit("x"), F.col("i").cast("string")).alias("word"),
                    F.concat(F.lit("x"), F.col("j").cast("string")).alias("context"))


QUERIES["first_order_similarity"] = lambda s, sf: vectors.first_order_similarity(_event_pairs(s, sf), *_wc(s, sf)).select(
    "word", "context", r6(F.col("sim")).alias("sim"))
SQL["first_order_similarity"] = _with(WC, event_matrix_cte()) + f"""
SELECT 'x' || CAST(i AS VARCHAR) AS word, 'x' || CAST(j AS VARCHAR) AS context,
       round({sql_dot('a.vec', 'b.vec')}, 6) AS sim
FROM evm LEFT JOIN wn a ON a.word = 'x' || CAST(i AS VARCHAR) LEFT JOIN cn b ON b.word = 'x' || CAST(j AS VARCHAR)"""
QUERIES["closest_contexts"] = lambda s, sf: (lambda w, c: vectors.closest_contexts(w.select("word"), w, c, N))(*_wc(s, sf)).select(
    "query", F.col("rank").cast("long").alias("rank"), "word", r6(F.col("score")).alias("score"))
SQL["closest_contexts"] = _with(WC) + f"""
SELECT query, rank, word, round(score, 6) AS score FROM (
  SELECT q.word AS query, c.word, list_dot_product(q.vec, c.vec) AS score,
         row_number() OVER (PARTITION BY q.word ORDER BY list_dot_product(q.vec, c.vec) DESC, c.word DESC) AS rank
  FROM wn q, cn c) WHERE rank <= {N}"""


# G10 SVD vectors: U = embedding, s_d = 1 / (d + 1), eig 0.5
def _svd(s, sf):
    u = fx.word_vectors(s, sf).select("word", F.col("vec").alias("u"))
    sv = s.range(64).select(F.col("id").cast("int").alias("d"), (1.0 / (F.col("id") + 1)).alias("s"))
    return vectors.svd_vectors(u, sv, 0.5, True)


QUERIES["svd_vectors"] = lambda s, sf: exploded(_svd(s, sf))
SQL["svd_vectors"] = _with(word_vectors_cte()) + f""",
sv0 AS (SELECT word, list_transform(list_zip(vec, generate_series(0, len(vec) - 1)), lambda p: p[1] * pow(1.0 / (p[2] + 1), 0.5)) AS vec FROM wv),
sv AS (SELECT word, {sql_norm('vec')} AS vec FROM sv0)
""" + sql_exploded("sv")

# G11-G16 explicit representations over the corpus association matrix
NEG = 5.0


def _epmi(s, sf, cells=None):
    from wordfold.plans.catalog_corpus import _epmi as corpus_epmi

    return corpus_epmi(s, sf, cells)


CORPUS_ASSOC = [C_CORPUS, c_pairs(P), assoc_ctes(P.cds)]

QUERIES["explicit_vectors"] = lambda s, sf: _epmi(s, sf, lambda ep, dense: vectors.explicit_vectors(ep, True, dense=dense)).select(
    "word", "context", r6(F.col("v")).alias("v"))
SQL["explicit_vectors"] = _with(*CORPUS_ASSOC) + """,
lm AS (SELECT word, context, ln(epmi) AS v FROM epmi),
nr AS (SELECT word, sqrt(sum(v * v)) AS nrm FROM lm GROUP BY word)
SELECT word, context, round(v / nrm, 6) AS v FROM lm JOIN nr USING (word)"""


def _ppmi_rep(s, sf):
    return _epmi(s, sf, lambda ep, dense: vectors.representation("PPMI", epmi=ep, neg=NEG, dense=dense))


PPMI_REP = f""",
sp AS (SELECT word, context, ln(epmi) - ln({d(NEG)}) AS v FROM epmi WHERE ln(epmi) - ln({d(NEG)}) > 0),
spn AS (SELECT word, sqrt(sum(v * v)) AS nrm FROM sp GROUP BY word),
rep AS (SELECT word, context, v / nrm AS v FROM sp JOIN spn USING (word))"""

QUERIES["representation"] = lambda s, sf: _ppmi_rep(s, sf).select("word", "context", r6(F.col("v")).alias("v"))
SQL["representation"] = _with(*CORPUS_ASSOC) + PPMI_REP + "\nSELECT word, context, round(v, 6) AS v FROM rep"


def _rep_ids(s, sf):
    """The PPMI representation on vocabulary ids, word by word where cells are
    packed: (cells, vocabulary, its size, what names cells or None)."""
    from wordfold.operators import corpus
    from wordfold.plans.ppmi import epmi_ids

    ep, voc, nv, dense = epmi_ids(fx.corpus_lines(s, sf), P, by_word=True)
    rep = vectors.representation("PPMI", epmi=ep, neg=NEG, max_rows=nv, dense=dense)
    named = lambda cells: corpus.decode_counts(cells, voc, P.win, False, vocab_rows=nv)
    return (rep, voc, nv, named) if lookup.is_packed(rep) else (named(rep), None, nv, None)


def _neighbour_pairs(s, sf, rep=None, named=None):
    """(w1, w2) = consecutive words of the sorted vocabulary of the representation."""
    from wordfold.operators.coo import dense_ids

    rep = _ppmi_rep(s, sf) if rep is None else rep
    words = rep.select("word").distinct() if named is None else cut_lineage(named(lookup.sums(rep, "word", "v", "v")).select("word"), "words")
    words = dense_ids(words, ["word"], "k")
    nxt = words.select(F.col("word").alias("w2"), (F.col("k") - 1).alias("k"))
    return words.withColumnRenamed("word", "w1").join(nxt, "k").select("w1", "w2")


SQL_NEIGHBOURS = """,
vk AS (SELECT word, row_number() OVER (ORDER BY word) AS k FROM (SELECT DISTINCT word FROM rep)),
nb AS (SELECT a.word AS w1, b.word AS w2 FROM vk a JOIN vk b ON b.k = a.k + 1)"""

# one corpus build per query: the test pairs and the matrix come from the same representation
def _explicit_similarity(s, sf):
    m, voc, _, named = _rep_ids(s, sf)
    return vectors.explicit_similarity(_neighbour_pairs(s, sf, m, named), m, ids=voc)


def _explicit_first_order(s, sf):
    m, voc, nv, named = _rep_ids(s, sf)
    pairs = _neighbour_pairs(s, sf, m, named).select(F.col("w1").alias("word"), F.col("w2").alias("context"))
    return vectors.explicit_first_order(pairs, m, voc, nv, named)


def _explicit_closest_contexts(s, sf):
    m, _, _, named = _rep_ids(s, sf)
    return vectors.explicit_closest_contexts(m.select("word") if named is None else None, m, N, named)


QUERIES["explicit_similarity"] = lambda s, sf: _explicit_similarity(s, sf).select("w1", "w2", r6(F.col("sim")).alias("sim"))
SQL["explicit_similarity"] = _with(*CORPUS_ASSOC) + PPMI_REP + SQL_NEIGHBOURS + """
SELECT nb.w1, nb.w2, round(coalesce(sum(a.v * b.v), 0.0), 6) AS sim
FROM nb LEFT JOIN rep a ON a.word = nb.w1 LEFT JOIN rep b ON b.word = nb.w2 AND b.context = a.context
GROUP BY nb.w1, nb.w2"""
QUERIES["explicit_first_order"] = lambda s, sf: _explicit_first_order(s, sf).select("word", "context", r6(F.col("sim")).alias("sim"))
SQL["explicit_first_order"] = _with(*CORPUS_ASSOC) + PPMI_REP + SQL_NEIGHBOURS + """
SELECT nb.w1 AS word, nb.w2 AS context, round(coalesce(rep.v, 0.0), 6) AS sim
FROM nb LEFT JOIN rep ON rep.word = nb.w1 AND rep.context = nb.w2"""
QUERIES["explicit_closest_contexts"] = lambda s, sf: _explicit_closest_contexts(s, sf).select(
    "query", F.col("rank").cast("long").alias("rank"), "word", r6(F.col("score")).alias("score"))
SQL["explicit_closest_contexts"] = _with(*CORPUS_ASSOC) + PPMI_REP + f"""
SELECT query, rank, word, round(score, 6) AS score FROM (
  SELECT word AS query, context AS word, v AS score,
         row_number() OVER (PARTITION BY word ORDER BY v DESC, context DESC) AS rank FROM rep) WHERE rank <= {N}"""


def _benchmark_words(s, sf):
    """Query words: every word of the benchmark texts."""
    return fx.table(s, sf, "benchmark").select(F.explode(tokens("text")).alias("word")).distinct()


def _explicit_closest(s, sf):
    from wordfold.plans.catalog_corpus import P as CP, _lines
    from wordfold.plans.ppmi import epmi_ids
    from wordfold.operators import corpus

    ep, voc, nv, dense = epmi_ids(_lines(s, sf), CP, by_word=True)
    rep = vectors.representation("PPMI", epmi=ep, neg=NEG, max_rows=nv, dense=dense)
    if dense is None:
        return vectors.explicit_closest(_benchmark_words(s, sf), corpus.decode_counts(rep, voc, CP.win, False, vocab_rows=nv), N)
    return vectors.explicit_closest(_benchmark_words(s, sf), rep, N, named=lambda rows: corpus.decode_counts(rows, voc, CP.win, False), ids=voc)


QUERIES["explicit_closest"] = lambda s, sf: _explicit_closest(s, sf).select(
    "query", F.col("rank").cast("long").alias("rank"), "word", r6(F.col("score")).alias("score"))
SQL["explicit_closest"] = _with(*CORPUS_ASSOC) + PPMI_REP + f""",
fq AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+')) AS word FROM benchmark),
sc AS (SELECT q.word AS query, m.word, sum(q.v * m.v) AS score
       FROM rep q JOIN fq USING (word) JOIN rep m ON m.context = q.context GROUP BY q.word, m.word)
SELECT query, rank, word, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, word DESC) AS rank FROM sc) WHERE rank <= {N}"""


# H1 Spearman per label group, H2 word-similarity evaluation
def _gold_sims(s, sf):
    g = fx.wordsim_gold(s, sf)
    lab = fx.table(s, sf, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("w1"), "label")
    return vectors.similarity(g, _wv(s, sf)).join(lab, "w1", "left")


GOLD_SIMS = f""",
gs AS (SELECT g.w1, g.w2, g.gold, {sql_dot('a.vec', 'b.vec')} AS sim, e.label
       FROM gold g LEFT JOIN wvn a ON a.word = g.w1 LEFT JOIN wvn b ON b.word = g.w2
       LEFT JOIN embeddings e ON 'w' || CAST(e.vec_id AS VARCHAR) = g.w1)"""


def sql_spearman(src: str, group: str | None) -> str:
    part = f"PARTITION BY {group}" if group else ""
    tie = f"PARTITION BY {group + ', ' if group else ''}"
    sel = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""
SELECT {sel}round(corr(rx, ry), 6) AS spearman FROM (
  SELECT {sel}rank() OVER ({part} ORDER BY sim) + (count(*) OVER ({tie} sim) - 1) / 2.0 AS rx,
         rank() OVER ({part} ORDER BY gold) + (count(*) OVER ({tie} gold) - 1) / 2.0 AS ry
  FROM {src}) {gb}"""


QUERIES["spearman"] = lambda s, sf: evaluate.spearman(_gold_sims(s, sf), "sim", "gold", ["label"]).select(
    "label", r6(F.col("spearman")).alias("spearman"))
SQL["spearman"] = _with(WVN, wordsim_cte()) + GOLD_SIMS + sql_spearman("gs", "label")
QUERIES["wordsim_eval"] = lambda s, sf: evaluate.wordsim_eval(_wv(s, sf), fx.wordsim_gold(s, sf)).select(
    r6(F.col("spearman")).alias("spearman"))
SQL["wordsim_eval"] = _with(WVN, wordsim_cte()) + GOLD_SIMS + sql_spearman("gs", None)

# H3 test vocabulary, H4 similarity block, H5/H6 analogy guesses, H7 accuracy
QUERIES["test_vocab"] = lambda s, sf: evaluate.test_vocab(fx.analogy_questions(s, sf)).select(
    "word", F.col("id").cast("long").alias("id"))
SQL["test_vocab"] = _with(analogy_cte()) + """
SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM (
  SELECT DISTINCT unnest([a, a_, b, b_]) AS word FROM quest)"""
ANALOGY_SQL = _with(WVN, analogy_cte()) + f""",
sc AS (
  SELECT q.qid, q.b_, c.word,
         ({sql_dot('va.vec', 'c.vec')} + 1.0) / 2.0 AS sa,
         ({sql_dot('va_.vec', 'c.vec')} + 1.0) / 2.0 AS sa_,
         ({sql_dot('vb.vec', 'c.vec')} + 1.0) / 2.0 AS sb
  FROM quest q LEFT JOIN wvn va ON va.word = q.a LEFT JOIN wvn va_ ON va_.word = q.a_
       LEFT JOIN wvn vb ON vb.word = q.b, wvn c
  WHERE c.word <> q.a AND c.word <> q.a_ AND c.word <> q.b
),
m AS (
  SELECT qid, b_, word, 'add' AS method, -sa + sa_ + sb AS score FROM sc
  UNION ALL SELECT qid, b_, word, 'mul', sa_ * sb / (sa + 0.01) FROM sc
),
best AS (SELECT qid, b_, method, word AS guess FROM (
  SELECT *, row_number() OVER (PARTITION BY qid, method ORDER BY score DESC, word ASC) AS rn FROM m) WHERE rn = 1)
"""


def _guesses(s, sf, method):
    return evaluate.analogy_guesses(fx.analogy_questions(s, sf), _wv(s, sf), True, methods=(method,))


QUERIES["analogy_add"] = lambda s, sf: _guesses(s, sf, "add").where(F.col("method") == "add").select("qid", "guess")
SQL["analogy_add"] = ANALOGY_SQL + "SELECT qid, guess FROM best WHERE method = 'add'"
QUERIES["analogy_mul"] = lambda s, sf: _guesses(s, sf, "mul").where(F.col("method") == "mul").select("qid", "guess")
SQL["analogy_mul"] = ANALOGY_SQL + "SELECT qid, guess FROM best WHERE method = 'mul'"
QUERIES["analogy_accuracy"] = lambda s, sf: evaluate.analogy_accuracy(fx.analogy_questions(s, sf), _wv(s, sf)).select(
    "method", r6(F.col("accuracy")).alias("accuracy"))
SQL["analogy_accuracy"] = ANALOGY_SQL + """
SELECT method, round(avg(CASE WHEN guess = b_ THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM best GROUP BY method"""

# A12 / A13 text test sets: lines built from the fixtures (upper case, tabs, CRLF), parsed back
from wordfold.sources.text import parse_analogies, parse_wordsim  # noqa: E402

QUERIES["read_wordsim"] = lambda s, sf: parse_wordsim(fx.wordsim_gold(s, sf).select(
    F.concat(F.upper("w1"), F.lit("\t"), F.upper("w2"), F.lit("\t"), F.col("gold").cast("string"), F.lit("\r")).alias("value"))).select(
    "w1", "w2", r6(F.col("gold")).alias("gold"))
SQL["read_wordsim"] = _with(wordsim_cte()) + "SELECT lower(w1) AS w1, lower(w2) AS w2, round(gold, 6) AS gold FROM gold"
QUERIES["read_analogies"] = lambda s, sf: parse_analogies(fx.analogy_questions(s, sf).select(
    F.concat_ws(" ", F.upper("a"), F.upper("a_"), F.upper("b"), F.upper("b_")).alias("value")))
SQL["read_analogies"] = _with(analogy_cte()) + "SELECT lower(a) AS a, lower(a_) AS a_, lower(b) AS b, lower(b_) AS b_ FROM quest"
