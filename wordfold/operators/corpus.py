"""Corpus -> vocabulary -> masked tokens -> windowed pairs -> counts.

Plan shape (see README, "Corpus plan"):

* vocabulary: explode + partial/final hash aggregate (only per-word partial
  counts cross the network);
* masking: tokens exploded with their position and joined to the vocabulary
  (broadcast when its measured size allows, shuffle join otherwise);
* windows: kept tokens are regrouped per (document, line, chunk of C raw
  positions). Long lines therefore never land in one task: each chunk gets a
  halo of the ``win`` kept tokens on each side, computed from tiny per-chunk
  head/tail summaries. Pairs are generated inside the chunk row by array
  functions and exploded straight into a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordfold.functions.rand import keyed_uniform, lit_key
from wordfold.operators import lookup
from wordfold.session import cut_lineage, size_bounded_broadcast

DEFAULT_CHUNK = 16384


# ---------------------------------------------------------------- B1 - B3
def vocab(lines: DataFrame, thr: int = 100) -> DataFrame:
    """B1. (word, n) for tokens seen at least ``thr`` times."""
    return (
        lines.select(F.explode("toks").alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= thr)
    )


def corpus_size(voc: DataFrame) -> DataFrame:
    """B2. One-row frame: total count of in-vocabulary tokens."""
    return voc.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("corpus_size"))


def subsample_prob(voc: DataFrame, t: float) -> DataFrame:
    """B3. (word, n, p_drop): drop probability 1 - sqrt(t*N / n) for n > t*N."""
    size = corpus_size(voc)
    thr = F.lit(float(t)) * F.col("corpus_size")
    return voc.crossJoin(F.broadcast(size)).select(
        "word",
        "n",
        F.when((F.lit(float(t)) > 0) & (F.col("n") > thr), F.lit(1.0) - F.sqrt(thr / F.col("n")))
        .otherwise(F.lit(0.0))
        .alias("p_drop"),
    )


# ---------------------------------------------------------------- B4 - B5
def mask_tokens(lines: DataFrame, voc_p: DataFrame, seed: int = 17, chunk_tokens: int = DEFAULT_CHUNK,
                vocab_rows: int | None = None, token_col: str = "word") -> DataFrame:
    """B4. Kept tokens (doc_id, line_no, pos, word, n_chunks).

    A token is kept when it is in the vocabulary and its keyed uniform draw
    exceeds its drop probability. Removed tokens are not materialized: with
    placeholders (B5 off) the windows run over raw positions, so the holes are
    implied by ``pos``. With ``token_col`` (e.g. ``wid``) the kept token is
    that vocabulary column instead of the word string. Lines in several rows
    tell where a row starts and how many tokens the line has (``start``,
    ``line_tokens``). With what :func:`dense_token_ids` wrote, lines that stand
    in one row are masked where they are read."""
    if getattr(voc_p, "dense", False) is True and "start" not in lines.columns and token_col == "word":
        from wordfold.operators import windows

        return windows.kept_tokens(windows.whole_lines(lines), voc_p, seed, chunk_tokens)
    parts = "start" in lines.columns
    size = F.col("line_tokens") if parts else F.size("toks")
    toks = lines.select(
        "doc_id",
        "line_no",
        *(["start"] if parts else []),
        F.ceil(size / F.lit(chunk_tokens)).cast("int").alias("n_chunks"),
        F.posexplode("toks").alias("pos", "word"),
    )
    if parts:
        toks = toks.withColumn("pos", F.col("start") + F.col("pos")).drop("start")
    tok = F.col("word") if token_col == "word" else F.col(token_col).alias("word")
    lookup = size_bounded_broadcast(voc_p.select("word", "p_drop", *([token_col] if token_col != "word" else [])),
                                    known_rows=vocab_rows)
    joined = toks.join(lookup, "word", "inner")
    u = keyed_uniform(lit_key("sub"), lit_key(seed), "doc_id", "line_no", "pos")
    keep = (F.col("p_drop") <= 0) | (u > F.col("p_drop"))
    return joined.where(keep).select("doc_id", "line_no", "pos", tok, "n_chunks")


# ---------------------------------------------------------------- B6 - B8
def _chunk_cells(kept: DataFrame, chunk_tokens: int) -> DataFrame:
    return (
        kept.withColumn("chunk", F.floor(F.col("pos") / F.lit(chunk_tokens)).cast("int"))
        .groupBy("doc_id", "line_no", "chunk", "n_chunks")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("cells"))
    )


def delete_placeholders(kept: DataFrame, chunk_tokens: int = DEFAULT_CHUNK) -> DataFrame:
    """B5. (doc_id, line_no, q, pos, word): dense 0-based positions of kept tokens.

    Offsets come from a running sum over per-chunk sizes (one small row per
    chunk), so a long line is numbered by many tasks. Tokens that follow each
    other by line are counted where they are."""
    if getattr(kept, "by_line", False) is True:
        from wordfold.operators import windows

        return windows.numbered(kept)
    cells = _chunk_cells(kept, chunk_tokens)
    w = Window.partitionBy("doc_id", "line_no").orderBy("chunk")
    offs = cells.select("doc_id", "line_no", "chunk", F.size("cells").alias("k"))
    offs = offs.select("doc_id", "line_no", "chunk", (F.sum("k").over(w) - F.col("k")).alias("off"))
    return (
        cells.join(offs, ["doc_id", "line_no", "chunk"])
        .select("doc_id", "line_no", "off", F.posexplode("cells").alias("idx", "c"))
        .select("doc_id", "line_no", (F.col("off") + F.col("idx")).alias("q"), F.col("c.pos").alias("pos"), F.col("c.word").alias("word"))
    )


def _halo(cells: DataFrame, win: int, delete: bool, chunk_tokens: int) -> DataFrame:
    """Left/right halo of every chunk of a multi-chunk line.

    The window runs over per-chunk summaries (first and last ``win`` kept
    tokens), never over the token arrays themselves. Because every summarized
    chunk holds at least one kept token, ``win`` neighbouring chunks always
    cover ``win`` kept tokens."""
    k = F.size("cells")
    summ = cells.select(
        "doc_id",
        "line_no",
        "chunk",
        F.slice("cells", 1, win).alias("head"),
        F.slice("cells", F.greatest(k - win + 1, F.lit(1)), win).alias("tail"),
    )
    w = Window.partitionBy("doc_id", "line_no").orderBy("chunk")
    left = F.flatten(F.collect_list("tail").over(w.rowsBetween(-win, -1)))
    right = F.flatten(F.collect_list("head").over(w.rowsBetween(1, win)))
    summ = summ.select("doc_id", "line_no", "chunk", left.alias("l"), right.alias("r"))
    if delete:
        left = F.slice("l", F.greatest(F.size("l") - win + 1, F.lit(1)), win)
        right = F.slice("r", 1, win)
    else:
        lo = F.col("chunk") * chunk_tokens - win
        hi = (F.col("chunk") + 1) * chunk_tokens + win
        left = F.filter("l", lambda x: x["pos"] >= lo)
        right = F.filter("r", lambda x: x["pos"] < hi)
    return summ.select("doc_id", "line_no", "chunk", left.alias("left"), right.alias("right"))


def _extended(kept: DataFrame, win: int, delete: bool, chunk_tokens: int) -> DataFrame:
    """Rows (doc_id, line_no, ext, lo, hi): chunk cells with halos; centres are
    ext[lo..hi] (0-based)."""
    cells = _chunk_cells(kept, chunk_tokens)
    # token type follows the input (word strings, or vocabulary ids)
    empty = F.array().cast(T.ArrayType(cells.schema["cells"].dataType.elementType))
    single = cells.where(F.col("n_chunks") <= 1).select("doc_id", "line_no", F.col("cells").alias("ext"), F.lit(0).alias("lo"), (F.size("cells") - 1).alias("hi"))
    multi = cells.where(F.col("n_chunks") > 1)
    halo = _halo(multi, win, delete, chunk_tokens)
    multi = multi.join(halo, ["doc_id", "line_no", "chunk"], "inner").select(
        "doc_id",
        "line_no",
        F.concat(F.coalesce("left", empty), "cells", F.coalesce("right", empty)).alias("ext"),
        F.size(F.coalesce("left", empty)).alias("lo"),
        (F.size(F.coalesce("left", empty)) + F.size("cells") - 1).alias("hi"),
    )
    return single.unionByName(multi)


def window_pairs(
    kept: DataFrame,
    win: int = 2,
    dyn: bool = False,
    positional: bool = False,
    delete: bool = True,
    seed: int = 17,
    chunk_tokens: int = DEFAULT_CHUNK,
    encoded: bool = False,
) -> DataFrame:
    """B5-B8. (word, context) rows, one per ordered co-occurrence.

    * ``delete`` (B5): removed tokens free their slot, so distances count kept
      tokens only; otherwise distances are raw positions.
    * ``dyn`` (B7): per-centre window 1 + floor(u * win), u keyed by the
      centre's (doc, line, pos).
    * ``positional`` (B8): context is 'token_offset'.
    * ``encoded``: tokens are non-negative long vocabulary ids; a positional
      context is then the long ``id * (2*win+1) + (offset + win)`` (see
      :func:`decode_counts`), so pairs stay two primitive columns.
    """
    if chunk_tokens < 1:
        raise ValueError("chunk_tokens must be >= 1")
    if win < 1:
        return kept.sparkSession.createDataFrame([], "word string, context string")
    ext = _extended(kept, win, delete, chunk_tokens).where(F.col("hi") >= F.col("lo"))
    # One row per centre, then one per index near it: both are lookups into the
    # chunk array, so the generators stay in generated code whose size doesn't
    # depend on the window, and feed the partial aggregate directly.
    cen = ext.select("doc_id", "line_no", "ext", F.explode(F.sequence("lo", "hi")).alias("i"))
    c = F.get(F.col("ext"), F.col("i"))
    w = F.lit(win)
    if dyn:
        u = keyed_uniform(lit_key("dyn"), lit_key(seed), F.col("doc_id"), F.col("line_no"), c["pos"])
        w = (F.floor(u * win) + 1).cast("int")
    cen = cen.select("ext", "i", c["word"].alias("word"), c["pos"].alias("pos"), w.alias("w"))
    reach = F.sequence(F.greatest(F.col("i") - F.col("w"), F.lit(0)), F.least(F.col("i") + F.col("w"), F.size("ext") - 1))
    near = cen.select("ext", "i", "word", "pos", "w", F.explode(reach).alias("k")).where(F.col("k") != F.col("i"))
    x = F.get(F.col("ext"), F.col("k"))
    # delete: distance counts kept tokens (array index); else raw positions
    off = (F.col("k") - F.col("i")) if delete else (x["pos"] - F.col("pos"))
    if not delete:
        near = near.where(F.abs(off) <= F.col("w"))
    if not positional:
        ctx = x["word"]
    elif encoded:
        ctx = x["word"] * F.lit(2 * win + 1) + (off + F.lit(win))
    else:
        ctx = F.concat(x["word"], F.lit("_"), off.cast("string"))
    return near.select("word", ctx.alias("context"))


# ---------------------------------------------------------------- B9 - B13
def pair_counts(pairs: DataFrame) -> DataFrame:
    """B9. (word, context, n): multiset count (partial + final hash aggregate)."""
    return pairs.groupBy("word", "context").agg(F.count(F.lit(1)).alias("n"))


def with_token_ids(voc: DataFrame) -> DataFrame:
    """Vocabulary rows plus a unique non-negative long ``wid``.

    The ids need not be dense; callers must materialize the result (e.g. with
    ``cut_lineage``) before using it twice, so encode and decode see the same
    ids."""
    return voc.withColumn("wid", F.monotonically_increasing_id())


def dense_token_ids(voc: DataFrame) -> DataFrame:
    """Vocabulary rows plus ``wid`` = 0..n-1, written: ids by task, then an
    offset per task (one small row each)."""
    cut = cut_lineage(with_token_ids(voc), "vocab-rows")
    task, low = F.shiftright("wid", 33), F.col("wid").bitwiseAND((1 << 33) - 1)
    sizes = cut.groupBy(task.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    offs = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_off"))
    dense = cut.join(F.broadcast(offs), task == F.col("_p")).withColumn("wid", F.col("_off") + low).drop("_p", "_off")
    dense = cut_lineage(dense, "vocab")
    dense.dense = lookup.fits(dense)
    return dense


def decode_counts(counts: DataFrame, ids: DataFrame, win: int, positional: bool,
                  vocab_rows: int | None = None) -> DataFrame:
    """Encoded (word, context, n, ...) -> string (word, context, n, ...).

    ``ids`` is (word, wid). Cells that have their words as ``_word`` and
    ``_context`` already (:class:`lookup.Named`) keep these. What :func:`dense_token_ids` wrote is looked up in
    place; other lookups are broadcast when the measured vocabulary size
    allows, shuffle joins otherwise."""
    if "_word" in counts.columns and "_context" in counts.columns and not positional:
        rest = [c for c in counts.columns if c not in ("word", "context", "_word", "_context")]
        if lookup.is_packed(counts):
            return lookup.renamed(counts, {"_word": "word", "_context": "context", **{c: c for c in rest}})
        return counts.select(F.col("_word").alias("word"), F.col("_context").alias("context"), *rest)
    if getattr(ids, "dense", False) is True:
        rest = [c for c in counts.columns if c not in ("word", "context")]
        both = [c for c in ("word", "context") if c in counts.columns]
        found = counts.withColumn("_c", F.floor(F.col("context") / (2 * win + 1)).cast("long")) if positional else counts
        found = lookup.attach(found, [("_c" if positional and c == "context" else c, ids, "wid", {"word": f"_{c}"}) for c in both])
        if not positional and lookup.is_packed(found):
            return lookup.renamed(found, {**{f"_{c}": c for c in both}, **{c: c for c in rest}})
        off = F.concat(F.lit("_"), (F.pmod(F.col("context"), F.lit(2 * win + 1)) - F.lit(win)).cast("string")) if positional else F.lit("")
        return found.select(*[(F.concat("_context", off) if positional and c == "context" else F.col(f"_{c}")).alias(c) for c in both], *rest)
    wl = size_bounded_broadcast(ids.select(F.col("wid").alias("_w"), F.col("word").alias("_ws")), known_rows=vocab_rows)
    cl = size_bounded_broadcast(ids.select(F.col("wid").alias("_c"), F.col("word").alias("_cs")), known_rows=vocab_rows)
    span = 2 * win + 1
    rest = [c for c in counts.columns if c not in ("word", "context")]  # n and any cell values
    if positional:
        enc = counts.select(
            F.col("word").alias("_w"), F.floor(F.col("context") / span).cast("long").alias("_c"),
            (F.pmod(F.col("context"), F.lit(span)) - F.lit(win)).alias("_off"), *rest)
        ctx = F.concat(F.col("_cs"), F.lit("_"), F.col("_off").cast("string"))
    else:
        enc = counts.select(F.col("word").alias("_w"), F.col("context").alias("_c"), *rest)
        ctx = F.col("_cs")
    return enc.join(wl, "_w").join(cl, "_c").select(F.col("_ws").alias("word"), ctx.alias("context"), *rest)


def word_marginals(counts: DataFrame) -> DataFrame:
    """B10. (word, n) = sum of counts per word, sorted by n desc, word asc."""
    return counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc("word"))


def context_marginals(counts: DataFrame) -> DataFrame:
    """B11. (context, n) = sum of counts per context, sorted by n desc, context asc."""
    return counts.groupBy("context").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc("context"))


def assign_ids(keys: DataFrame, col: str = "word", id_col: str = "id") -> DataFrame:
    """B12. Dense 0-based id by sorted key order, without a single-partition window.

    Keys are range-partitioned by a sort; per-partition sizes (one row per
    partition) give offsets; id = offset + rank inside the partition."""
    srt = keys.select(col).distinct().orderBy(col)
    srt = srt.select(col, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    srt = cut_lineage(srt, "ids")  # written, not cached: a lost cache block would be cut anew
    sizes = srt.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_m").alias("_m0"))
    offs = sizes.select(
        "_p", "_m0", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_off")
    )
    out = srt.join(F.broadcast(offs), "_p").select(col, (F.col("_off") + F.col("_m") - F.col("_m0")).alias(id_col))
    return out


def index_counts(counts: DataFrame, wv: DataFrame, cv: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """B13. Replace words/contexts by ids; pairs outside either vocabulary drop;
    duplicate (i, j) cells add. With ``tokens`` (written, word and dense wid)
    the counts are cells of these ids, each once: ids are looked up in place
    and no two cells can meet."""
    if tokens is not None:
        def by_wid(ids: DataFrame, out: str) -> DataFrame:
            return cut_lineage(tokens.select("wid", "word").join(ids.select("word", F.col("id").alias(out)), "word", "left").select("wid", out), "token-ids")

        found = lookup.attach(counts, [("word", by_wid(wv, "i"), "wid", {"i": "i"}), ("context", by_wid(cv, "j"), "wid", {"j": "j"})])
        return found.where(F.col("i").isNotNull() & F.col("j").isNotNull()).select("i", "j", F.col("n").cast("double").alias("v"))
    wv = size_bounded_broadcast(wv.select(F.col("word"), F.col("id").alias("i")))
    cv = size_bounded_broadcast(cv.select(F.col("word").alias("context"), F.col("id").alias("j")))
    return (
        counts.join(wv, "word").join(cv, "context").groupBy("i", "j").agg(F.sum("n").cast("double").alias("v"))
    )


# ---------------------------------------------------------------- whole step
def corpus_counts(
    lines: DataFrame,
    thr: int = 100,
    win: int = 2,
    dyn: bool = False,
    positional: bool = False,
    sub: float = 0.0,
    delete: bool = False,
    seed: int = 17,
    chunk_tokens: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Corpus lines -> (word, context, n) with the usual switches."""
    voc = subsample_prob(vocab(lines, thr), sub)
    kept = mask_tokens(lines, voc, seed, chunk_tokens)
    return pair_counts(window_pairs(kept, win, dyn, positional, delete, seed, chunk_tokens))
