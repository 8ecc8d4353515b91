"""Vector and explicit-matrix queries.

Dense representations are (word, vec array<double>); explicit (sparse)
representations are COO tables (word, context, v). Nearest-neighbour queries
score blocks of queries against blocks of candidates in numpy and keep only a
local top-n per query before the final ranking window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordfold.functions import vec as V
from wordfold.operators import assoc, lookup, sparse
from wordfold.operators.coo import dense_ids
from wordfold.operators.blocks import DEFAULT_BLOCK_ROWS, top_candidates
from wordfold.session import cut_lineage, size_bounded_broadcast


def _dim(vecs: DataFrame) -> int:
    return len(vecs.select("vec").first()[0])


# ---------------------------------------------------------------- dense
def normalize_vectors(vecs: DataFrame) -> DataFrame:
    """G1. Unit-length rows; zero vectors stay zero."""
    return vecs.withColumn("vec", V.normalize("vec"))


def represent(words: DataFrame, vecs: DataFrame, k: int | None = None) -> DataFrame:
    """G2. (word, vec) for each requested word; unknown words get zeros."""
    k = k or _dim(vecs)
    return words.select("word").join(vecs, "word", "left").select("word", F.coalesce("vec", V.zeros(k)).alias("vec"))


def similarity(pairs: DataFrame, vecs: DataFrame, a: str = "w1", b: str = "w2") -> DataFrame:
    """G3. Adds ``sim`` = <v_a, v_b> of (already normalized) vectors; 0 if either is unknown."""
    va = vecs.select(F.col("word").alias(a), F.col("vec").alias("_va"))
    vb = vecs.select(F.col("word").alias(b), F.col("vec").alias("_vb"))
    return (
        pairs.join(va, a, "left")
        .join(vb, b, "left")
        .withColumn("sim", F.coalesce(V.dot("_va", "_vb"), F.lit(0.0)))
        .drop("_va", "_vb")
    )


def _closest(words: DataFrame, vecs: DataFrame, cands: DataFrame, n: int, block_rows: int, drop_self: bool, report: dict | None) -> DataFrame:
    q = represent(words.select("word").distinct(), vecs, _dim(vecs)).select(F.col("word").alias("query"), F.col("vec").alias("qvec"))
    best = top_candidates(q, cands.select("word", "vec"), "query", "word", "qvec", n, True, block_rows, drop_self=drop_self, report=report)
    return best.select("query", "word", "score", "rank")


def closest(words: DataFrame, vecs: DataFrame, n: int = 10, block_rows: int = DEFAULT_BLOCK_ROWS,
            drop_self: bool = False, report: dict | None = None) -> DataFrame:
    """G4. (query, rank, word, score): the n best words by <q, v>, the query word
    itself included; ties by word descending. Unknown queries score 0 everywhere.
    Scores don't depend on the blocks, so equal vectors tie exactly; blocks of
    words too short to enter are skipped (``report``: pairs and pairs met)."""
    return _closest(words, vecs, vecs, n, block_rows, drop_self, report)


def ensemble(v1: DataFrame, v2: DataFrame, normalize: bool = True) -> DataFrame:
    """G5. W + C on shared words; words on one side keep their own vector."""
    j = v1.select("word", F.col("vec").alias("a")).join(v2.select("word", F.col("vec").alias("b")), "word", "full")
    out = j.select(
        "word",
        F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(V.add("a", "b")).alias("vec"),
    )
    return normalize_vectors(out) if normalize else out


def concatenate(v1: DataFrame, v2: DataFrame, normalize: bool = True) -> DataFrame:
    """G6. [W ; C] for words present on both sides (dimension doubles)."""
    j = v1.select("word", F.col("vec").alias("a")).join(v2.select("word", F.col("vec").alias("b")), "word")
    out = j.select("word", F.concat("a", "b").alias("vec"))
    return normalize_vectors(out) if normalize else out


def context_vectors(words: DataFrame, contexts: DataFrame) -> DataFrame:
    """G7. Use the context side as the word representation."""
    return contexts


def first_order_similarity(pairs: DataFrame, w: DataFrame, c: DataFrame) -> DataFrame:
    """G8. (word, context, sim) = <w_word, c_context>; unknown -> 0."""
    va = w.select("word", F.col("vec").alias("_va"))
    vb = c.select(F.col("word").alias("context"), F.col("vec").alias("_vb"))
    return (
        pairs.join(va, "word", "left").join(vb, "context", "left")
        .withColumn("sim", F.coalesce(V.dot("_va", "_vb"), F.lit(0.0)))
        .drop("_va", "_vb")
    )


def closest_contexts(words: DataFrame, w: DataFrame, c: DataFrame, n: int = 10,
                     block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """G9. Top-n contexts for each word by <w_word, c_context> (every context row
    is a candidate)."""
    return _closest(words, w, c, n, block_rows, False, None)


def svd_vectors(u: DataFrame, s: DataFrame, eig: float = 0.5, normalize: bool = True) -> DataFrame:
    """G10. U * s**eig (eig 0 -> U, 1 -> U*s). ``s`` is (d, s), rank-sized."""
    sv = s.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias("_s"))
    if eig == 0.0:
        out = u.select("word", F.col("u").alias("vec"))
    else:
        out = u.crossJoin(F.broadcast(sv)).select(
            "word", F.zip_with("u", "_s", lambda a, b: a * (b if eig == 1.0 else F.pow(b, F.lit(float(eig))))).alias("vec")
        )
    return normalize_vectors(out) if normalize else out


# ---------------------------------------------------------------- explicit (sparse)
def explicit_vectors(epmi: DataFrame, normalize: bool = True, max_rows: int | None = None, dense: int | None = None) -> DataFrame:
    """G11. Rows of ln(epmi) (unclipped), optionally L2-normalized per word
    (``max_rows``: known bound on the number of words; ``dense``: words are
    ids below it)."""
    m = assoc.logs(epmi)
    return assoc.l2_normalize_rows(m, "word", "v", max_rows, dense) if normalize else m


def positive_explicit(epmi: DataFrame, neg: float = 1.0, normalize: bool = True,
                      max_rows: int | None = None, dense: int | None = None) -> DataFrame:
    """PPMI representation: shifted PPMI cells, optionally L2-normalized."""
    m = lookup.renamed(assoc.shifted_ppmi(epmi, neg), {"word": "word", "context": "context", "spmi": "v"})
    return assoc.l2_normalize_rows(m, "word", "v", max_rows, dense) if normalize else m


def explicit_similarity(pairs: DataFrame, m: DataFrame, a: str = "w1", b: str = "w2", ids: DataFrame | None = None) -> DataFrame:
    """G12. Sparse row dot product for listed pairs; 0 when rows share no context.
    The matrix feeds both sides of the pair join: written once, read twice.
    With ``ids`` (word, wid) the matrix is on these, packed and word by word:
    rows move whole, to where their pairs are (those near in order of ``a``)."""
    if ids is not None:
        known = [ids.select(F.col("word").alias(c), F.col("wid").alias(f"_{c}")) for c in (a, b)]
        asked = cut_lineage(dense_ids(pairs.select(a, b).distinct(), [a, b], "at").join(known[0], a).join(known[1], b), "pair-ids")
        products = sparse.row_products(asked.select(F.col(f"_{a}").alias("a"), F.col(f"_{b}").alias("b"), "at"), sparse.together(m))
        sims = asked.join(products.select(F.col("a").alias(f"_{a}"), F.col("b").alias(f"_{b}"), "sim"), [f"_{a}", f"_{b}"]).select(a, b, "sim")
        return pairs.join(sims, [a, b], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    m = cut_lineage(m.select("word", "context", "v"), "explicit-matrix")
    p = pairs.select(a, b).distinct()
    left = p.join(m.select(F.col("word").alias(a), "context", F.col("v").alias("_va")), a)
    both = left.join(m.select(F.col("word").alias(b), "context", F.col("v").alias("_vb")), [b, "context"])
    sims = both.groupBy(a, b).agg(F.sum(F.col("_va") * F.col("_vb")).alias("sim"))
    return pairs.join(sims, [a, b], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))


def explicit_first_order(pairs: DataFrame, m: DataFrame, ids: DataFrame | None = None, n_ids: int = 0, named=None) -> DataFrame:
    """G13. Cell lookup m[word, context]; absent cells (and unknown keys) give 0.
    With ``ids`` (word, wid; ``n_ids`` of them) the matrix is packed on these:
    cells are picked where they are unpacked and then ``named``."""
    if ids is not None:
        known = [ids.select(F.col("word").alias(c), F.col("wid").alias(f"_{c}")) for c in ("word", "context")]
        keys = pairs.select("word", "context").distinct().join(known[0], "word").join(known[1], "context").select((F.col("_word") * n_ids + F.col("_context")).alias("key"))
        keys = cut_lineage(keys.withColumn("cell", F.col("key")), "pair-keys")
        m = named(sparse.listed(m, keys, n_ids)) if lookup.fits(keys) else named(m)
    return pairs.join(m.select("word", "context", F.col("v").alias("sim")), ["word", "context"], "left").withColumn(
        "sim", F.coalesce("sim", F.lit(0.0))
    )


def explicit_closest_contexts(words: DataFrame, m: DataFrame, n: int = 10, named=None) -> DataFrame:
    """G14. Top-n stored cells of each requested row (ties: context descending).
    With ``named`` the matrix is on ids, packed and word by word: cells below a
    row's n-th are dropped where they are unpacked, and the others named."""
    if named is not None:
        m = cut_lineage(named(sparse.most(m, n)), "highest-cells", "zstd")
        words = m.select("word") if words is None else words
    sel = m.join(size_bounded_broadcast(words.select("word").distinct()), "word", "left_semi")
    w = Window.partitionBy("word").orderBy(F.desc("v"), F.desc("context"))
    return sel.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(
        F.col("word").alias("query"), "rank", F.col("context").alias("word"), F.col("v").alias("score")
    )


def explicit_closest(words: DataFrame, m: DataFrame, n: int = 10, report: dict | None = None, named=None, ids: DataFrame | None = None) -> DataFrame:
    """G15. Top-n words by sparse dot with the query row (only rows sharing a
    context get a score; ties by word descending). See
    :mod:`wordfold.operators.sparse`; where ``m`` is on ids, ``named`` gives
    rows their words, and with ``ids`` (word, wid) the cells of a word follow
    each other."""
    local = sparse.top_products(words, m, n, report, named, ids)
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("word"))
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# ---------------------------------------------------------------- G16 factory
def representation(kind: str, *, epmi: DataFrame | None = None, words: DataFrame | None = None,
                   contexts: DataFrame | None = None, u: DataFrame | None = None, s: DataFrame | None = None,
                   v: DataFrame | None = None, neg: float = 1.0, eig: float = 0.5, w_c: bool = False,
                   concat: bool = False, use_contexts: bool = False, max_rows: int | None = None,
                   dense: int | None = None) -> DataFrame:
    """G16. Build a representation by kind: 'PPMI', 'SVD', 'PMF' or an embedding.

    PPMI -> sparse (word, context, v); all others -> dense (word, vec)."""
    if kind == "PPMI":
        if w_c:
            raise ValueError("w+c is not defined for PPMI")
        return positive_explicit(epmi, neg, True, max_rows, dense)
    if kind == "SVD":
        if w_c:
            return ensemble(svd_vectors(u, s, eig, False), svd_vectors(v, s, eig, False), True)
        return svd_vectors(u, s, eig, True)
    if kind == "PMF":
        return normalize_vectors(words)
    if w_c:
        return ensemble(words, contexts, True)
    if concat:
        return concatenate(words, contexts, True)
    if use_contexts:
        return normalize_vectors(contexts)
    return normalize_vectors(words)
