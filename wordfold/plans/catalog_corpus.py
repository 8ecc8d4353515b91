"""Registered queries for sources A1-A2, corpus B1-B13 and association C1-C10.

Each entry: Spark callable (spark, sf_dir) -> DataFrame, and its DuckDB SQL twin.
Doubles are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wordfold.operators import assoc, corpus, lookup
from wordfold.plans import fixtures as fx
from wordfold.plans.ppmi import CorpusParams, build_epmi, counts_from_lines, encoded_counts, epmi_ids
from wordfold.plans.sql_fixtures import assoc_ctes, corpus_ctes, d, pairs_ctes
from wordfold.session import checkpoint_dir, cut_lineage
from wordfold.sources.text import format_counts, parse_counts, read_corpus_words

P = CorpusParams(thr=fx.THR, win=fx.WIN, sub=fx.SUB, delete=True, seed=fx.SEED, cds=fx.CDS)
P_DYN = CorpusParams(thr=fx.THR, win=4, dyn=True, sub=fx.SUB, delete=True, seed=fx.SEED, cds=fx.CDS)
P_POS = CorpusParams(thr=fx.THR, win=fx.WIN, positional=True, sub=fx.SUB, delete=True, seed=fx.SEED, cds=fx.CDS)
P_KEEP = CorpusParams(thr=fx.THR, win=fx.WIN, sub=fx.SUB, delete=False, seed=fx.SEED, cds=fx.CDS)
NEG = 5.0


def r6(c):
    return F.round(c, 6)


def _lines(spark, sf):
    return fx.corpus_lines(spark, sf)


def _counts(spark, sf, p=P):
    """Counts that are read once: not written before."""
    return counts_from_lines(_lines(spark, sf), p, materialize=False)


def _sums(spark, sf, key):
    """(key, n): the counts summed per id, then by word."""
    enc, voc, nv = encoded_counts(_lines(spark, sf), P)
    sums = lookup.sums(enc, key, "n", "n")
    return corpus.decode_counts(sums, voc, P.win, False, vocab_rows=nv) if voc.dense else corpus.decode_counts(enc, voc, P.win, False, vocab_rows=nv)


def _scaled(spark, sf, scale, sums, key):
    """Counts as shares of the sums of their ``key``, scaled on ids."""
    enc, voc, nv = encoded_counts(_lines(spark, sf), P)
    enc = lookup.cut_cells(enc, "counts-ids")
    coefs = sums(enc).select(key, (1.0 / F.col(f"{'row' if key == 'word' else 'col'}_sum")).alias("coef"))
    cells = scale(enc, coefs, key, "n", dense=lookup.Named.of(nv, voc) if voc.dense else None)
    return corpus.decode_counts(cells, voc, P.win, False, vocab_rows=nv).select("word", "context", r6(F.col("n")).alias("p"))


def _vp(spark, sf, p=P):
    return corpus.subsample_prob(corpus.vocab(_lines(spark, sf), p.thr), p.sub)


def _epmi(spark, sf, cells=None):
    return build_epmi(_lines(spark, sf), P, cells)[0]


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes) + "\n"


C_CORPUS = corpus_ctes(P.thr, P.sub, P.seed)


def c_pairs(p: CorpusParams) -> str:
    return pairs_ctes(p.win, p.dyn, p.positional, p.delete, p.seed)


QUERIES = {}
SQL = {}

# A1 read_corpus
QUERIES["read_corpus"] = lambda s, sf: _lines(s, sf).select(
    "doc_id", F.col("line_no").cast("long").alias("line_no"), F.size("toks").cast("long").alias("n_tok"),
    F.array_join("toks", " ").alias("joined"))
SQL["read_corpus"] = _with(C_CORPUS) + "SELECT doc_id, line_no, CAST(len(toks) AS BIGINT) AS n_tok, array_to_string(toks, ' ') AS joined FROM lines WHERE len(toks) > 0"


# A1 by words: the texts as files, read by splits at spaces; tokens by their place in the line
def _corpus_words(s, sf):
    path = f"{checkpoint_dir(s).rstrip('/')}/corpus-text-{uuid.uuid4().hex}"
    fx.table(s, sf, "documents").select(F.coalesce("text", F.lit("")).alias("text")).write.text(path)
    words = read_corpus_words(s, path).select("start", F.posexplode("toks").alias("n", "word"))
    return words.groupBy((F.col("start") + F.col("n")).alias("pos")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("chars"))


QUERIES["read_corpus_words"] = _corpus_words
SQL["read_corpus_words"] = _with(C_CORPUS) + """SELECT CAST(pos AS BIGINT) AS pos, count(*) AS n, CAST(sum(length(word)) AS BIGINT) AS chars FROM (
  SELECT unnest(generate_series(0, len(toks) - 1)) AS pos, unnest(toks) AS word FROM lines WHERE len(toks) > 0) GROUP BY pos"""

# A2 read_counts: format counts as 'uniq -c' lines, parse back
QUERIES["read_counts"] = lambda s, sf: parse_counts(format_counts(_counts(s, sf)))
SQL["read_counts"] = _with(C_CORPUS, c_pairs(P)) + "SELECT word, context, n FROM counts"

# B1 vocab, B2 corpus_size, B3 subsample_prob
QUERIES["vocab"] = lambda s, sf: corpus.vocab(_lines(s, sf), P.thr)
SQL["vocab"] = _with(C_CORPUS) + "SELECT word, n FROM voc"
QUERIES["corpus_size"] = lambda s, sf: corpus.corpus_size(corpus.vocab(_lines(s, sf), P.thr))
SQL["corpus_size"] = _with(C_CORPUS) + "SELECT corpus_size FROM vtot"
QUERIES["subsample_prob"] = lambda s, sf: _vp(s, sf).select("word", "n", r6(F.col("p_drop")).alias("p_drop"))
SQL["subsample_prob"] = _with(C_CORPUS) + "SELECT word, n, round(p_drop, 6) AS p_drop FROM vp"

# B4 mask_tokens
QUERIES["mask_tokens"] = lambda s, sf: corpus.mask_tokens(_lines(s, sf), _vp(s, sf).persist(), P.seed).select(
    "doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("pos").cast("long").alias("pos"), "word")
SQL["mask_tokens"] = _with(C_CORPUS) + "SELECT doc_id, line_no, pos, word FROM kept"

# B5 delete_placeholders: dense positions after removal
QUERIES["delete_placeholders"] = lambda s, sf: corpus.delete_placeholders(
    corpus.mask_tokens(_lines(s, sf), corpus.dense_token_ids(_vp(s, sf)), P.seed)).select(
    "doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("q").cast("long").alias("q"), "word")
SQL["delete_placeholders"] = _with(C_CORPUS) + (
    "SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY pos) - 1 AS q, word FROM kept")

# B6 fixed windows (+B5 delete, +B9 counting), B5 off, B7 dynamic, B8 positional
QUERIES["pair_counts"] = lambda s, sf: _counts(s, sf)
SQL["pair_counts"] = _with(C_CORPUS, c_pairs(P)) + "SELECT word, context, n FROM counts"
QUERIES["window_pairs_keep_placeholders"] = lambda s, sf: _counts(s, sf, P_KEEP)
SQL["window_pairs_keep_placeholders"] = _with(C_CORPUS, c_pairs(P_KEEP)) + "SELECT word, context, n FROM counts"
QUERIES["window_pairs_dynamic"] = lambda s, sf: _counts(s, sf, P_DYN)
SQL["window_pairs_dynamic"] = _with(C_CORPUS, c_pairs(P_DYN)) + "SELECT word, context, n FROM counts"
QUERIES["window_pairs_positional"] = lambda s, sf: _counts(s, sf, P_POS)
SQL["window_pairs_positional"] = _with(C_CORPUS, c_pairs(P_POS)) + "SELECT word, context, n FROM counts"
# the demo's corpus settings: window 15, dynamic, subsampling 1e-5
P_DEMO = CorpusParams(thr=5, win=15, dyn=True, sub=1e-5, delete=True, seed=P.seed)
QUERIES["pair_counts_demo"] = lambda s, sf: _counts(s, sf, P_DEMO)
SQL["pair_counts_demo"] = _with(corpus_ctes(P_DEMO.thr, P_DEMO.sub, P_DEMO.seed), c_pairs(P_DEMO)) + "SELECT word, context, n FROM counts"
# chunked execution path (tiny chunks force halos on most lines) must give the same counts
QUERIES["window_pairs_chunked"] = lambda s, sf: _counts(s, sf, CorpusParams(
    thr=P.thr, win=P.win, sub=P.sub, delete=True, seed=P.seed, chunk_tokens=3))
SQL["window_pairs_chunked"] = SQL["pair_counts"]

# B10 / B11 marginals
QUERIES["word_marginals"] = lambda s, sf: corpus.word_marginals(_sums(s, sf, "word"))
SQL["word_marginals"] = _with(C_CORPUS, c_pairs(P)) + "SELECT word, sum(n) AS n FROM counts GROUP BY word"
QUERIES["context_marginals"] = lambda s, sf: corpus.context_marginals(_sums(s, sf, "context"))
SQL["context_marginals"] = _with(C_CORPUS, c_pairs(P)) + "SELECT context, sum(n) AS n FROM counts GROUP BY context"

# B12 assign_ids (sorted vocabulary ids), B13 index_counts
QUERIES["assign_ids"] = lambda s, sf: corpus.assign_ids(corpus.vocab(_lines(s, sf), P.thr), "word", "id")
SQL["assign_ids"] = _with(C_CORPUS) + "SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM voc"


def _index_counts(s, sf):
    enc, voc, nv = encoded_counts(_lines(s, sf), P)
    c = lookup.cut_cells(enc, "counts-ids")
    words, contexts = (corpus.decode_counts(c.select(x).distinct(), voc, P.win, False, vocab_rows=nv) if voc.dense else None for x in ("word", "context"))
    if not voc.dense:
        c = cut_lineage(corpus.decode_counts(c, voc, P.win, False, vocab_rows=nv), "counts")
        words, contexts = c.select("word"), c.select("context")
    wv = corpus.assign_ids(words, "word", "id")
    cv = corpus.assign_ids(contexts.withColumnRenamed("context", "word"), "word", "id")
    return corpus.index_counts(c, wv, cv, voc if voc.dense else None)


QUERIES["index_counts"] = _index_counts
SQL["index_counts"] = _with(C_CORPUS, c_pairs(P)) + """,
wid AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i FROM (SELECT DISTINCT word FROM counts)),
cid AS (SELECT context, row_number() OVER (ORDER BY context) - 1 AS j FROM (SELECT DISTINCT context FROM counts))
SELECT i, j, CAST(sum(n) AS DOUBLE) AS v FROM counts JOIN wid USING (word) JOIN cid USING (context) GROUP BY i, j"""

# C1 marginals, C2 smoothing
QUERIES["row_sums"] = lambda s, sf: assoc.row_sums(_sums(s, sf, "word"))
SQL["row_sums"] = _with(C_CORPUS, c_pairs(P), assoc_ctes(P.cds)) + "SELECT word, row_sum FROM ws"
QUERIES["col_sums"] = lambda s, sf: assoc.col_sums(_sums(s, sf, "context"))
SQL["col_sums"] = _with(C_CORPUS, c_pairs(P), assoc_ctes(P.cds)) + "SELECT context, col_sum FROM cs"
QUERIES["smooth_contexts"] = lambda s, sf: assoc.smooth_contexts(cut_lineage(assoc.col_sums(_sums(s, sf, "context")), "col-sums"), P.cds).select(
    "context", r6(F.col("col_smooth")).alias("col_smooth"), F.round("smooth_total", 3).alias("smooth_total"))
SQL["smooth_contexts"] = _with(C_CORPUS, c_pairs(P), assoc_ctes(P.cds)) + (
    "SELECT context, round(col_smooth, 6) AS col_smooth, round(smooth_total, 3) AS smooth_total FROM cs, tot")

# C3 epmi, C4 pmi, C5 ppmi (flagship), C6 ppmi counts, C7 shifted ppmi
QUERIES["exp_pmi"] = lambda s, sf: _epmi(s, sf).select("word", "context", "n", r6(F.col("epmi")).alias("epmi"))
SQL["exp_pmi"] = _with(C_CORPUS, c_pairs(P), assoc_ctes(P.cds)) + "SELECT word, context, n, round(epmi, 6) AS epmi FROM epmi"
QUERIES["pmi"] = lambda s, sf: assoc.pmi(_epmi(s, sf)).select("word", "context", r6(F.col("pmi")).alias("pmi"))
SQL["pmi"] = _with(C_CORPUS, c_pairs(P), assoc_ctes(P.cds)) + "SELECT word, context, round(ln(epmi), 6) AS pmi FROM epmi"
QUERIES["ppmi"] = lambda s, sf: assoc.ppmi(_epmi(s, sf)).select("word", "context", "n", r6(F.col("pmi")).alias("pmi"))
SQL["ppmi"] = _with(C_CORPUS, c_pairs(P), assoc_ctes(P.cds)) + (
    "SELECT word, context, n, round(ln(epmi), 6) AS pmi FROM epmi WHERE epmi > 1")
QUERIES["ppmi_counts"] = lambda s, sf: assoc.ppmi_counts(_epmi(s, sf)).select("word", "context", "n")
SQL["ppmi_counts"] = _with(C_CORPUS, c_pairs(P), assoc_ctes(P.cds)) + "SELECT word, context, n FROM epmi WHERE epmi > 1"
QUERIES["shifted_ppmi"] = lambda s, sf: assoc.shifted_ppmi(_epmi(s, sf), NEG).select(
    "word", "context", r6(F.col("spmi")).alias("spmi"))
SQL["shifted_ppmi"] = _with(C_CORPUS, c_pairs(P), assoc_ctes(P.cds)) + (
    f"SELECT word, context, round(ln(epmi) - ln({d(NEG)}), 6) AS spmi FROM epmi WHERE ln(epmi) - ln({d(NEG)}) > 0")

# C8 scale rows by 1/row_sum (conditional probabilities), C9 row L2 normalization of PPMI
QUERIES["scale_rows"] = lambda s, sf: _scaled(s, sf, assoc.scale_rows, assoc.row_sums, "word")
SQL["scale_rows"] = _with(C_CORPUS, c_pairs(P), assoc_ctes(P.cds)) + (
    "SELECT word, context, round(n * (1.0 / row_sum), 6) AS p FROM counts JOIN ws USING (word)")
QUERIES["scale_cols"] = lambda s, sf: _scaled(s, sf, assoc.scale_cols, assoc.col_sums, "context")
SQL["scale_cols"] = _with(C_CORPUS, c_pairs(P)) + (
    "SELECT word, context, round(n * (1.0 / sum(n) OVER (PARTITION BY context)), 6) AS p FROM counts")
QUERIES["l2_normalize_rows"] = lambda s, sf: _epmi(s, sf, lambda ep, dense: assoc.l2_normalize_rows(
    assoc.ppmi(ep).select("word", "context", "pmi"), "word", "pmi", dense=dense)).select("word", "context", r6(F.col("pmi")).alias("v"))
SQL["l2_normalize_rows"] = _with(C_CORPUS, c_pairs(P), assoc_ctes(P.cds)) + """,
pp AS (SELECT word, context, ln(epmi) AS pmi FROM epmi WHERE epmi > 1),
nr AS (SELECT word, sqrt(sum(pmi * pmi)) AS nrm FROM pp GROUP BY word)
SELECT word, context, round(pmi / nrm, 6) AS v FROM pp JOIN nr USING (word)"""

# C10 matrix meta of the PPMI matrix
QUERIES["matrix_meta"] = lambda s, sf: assoc.matrix_meta(
    assoc.ppmi(epmi_ids(_lines(s, sf), P)[0]), None, None, "word", "context")
SQL["matrix_meta"] = _with(C_CORPUS, c_pairs(P), assoc_ctes(P.cds)) + (
    "SELECT count(DISTINCT word) AS n_rows, count(DISTINCT context) AS n_cols, count(*) AS nnz FROM epmi WHERE epmi > 1")
