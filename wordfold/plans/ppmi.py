"""Flagship plan: corpus -> counts -> PPMI (A1 -> B1..B9 -> C1..C5)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordfold.operators import assoc, corpus, lookup, windows
from wordfold.session import cut_lineage, shuffles_dropped


@dataclass(frozen=True)
class CorpusParams:
    thr: int = 100
    win: int = 2
    dyn: bool = False
    positional: bool = False
    sub: float = 0.0
    delete: bool = False
    seed: int = 17
    cds: float = 1.0
    chunk_tokens: int = corpus.DEFAULT_CHUNK


def build_counts(lines: DataFrame, p: CorpusParams, materialize: bool = True) -> tuple[DataFrame, tuple[int, int]]:
    """(word, context, n) plus upper bounds on (#words, #contexts).

    The vocabulary (with a long id per word) is written once to the shared
    checkpoint folder: it is counted for the broadcast check, joined to mask
    the tokens and joined again to decode the counts, and the ids must be the
    same each time. Tokens travel as ids from the mask on, so the window
    regroup and the pair aggregate shuffle and hash primitive longs, not
    strings; words come back with two vocabulary-sized joins after the
    counts are reduced. With ``materialize`` the counts are written too: every
    later step reads them at least three times (two marginals and the cell
    join). Words are vocabulary words and positional contexts carry one of
    2*win offsets, so the vocabulary size bounds both marginals without
    another count."""
    counts, voc, n_vocab = _pair_counts(lines, p, True)
    bounds = (n_vocab, n_vocab * 2 * p.win if p.positional else n_vocab)
    if materialize:
        counts = cut_lineage(counts, "counts")
    return counts, bounds


def encoded_counts(lines: DataFrame, p: CorpusParams, by_word: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """Counts keyed by vocabulary ids: (word long, context long, n), the
    written vocabulary (word, n, p_drop, wid) and its size. Jobs that only
    need matrix coordinates (factorization) stay on the ids; see
    :func:`wordfold.operators.corpus.decode_counts` for the strings. With
    ``by_word`` packed cells (vocabularies that workers hold) lie word by word."""
    return _pair_counts(lines, p, False, by_word)


def _pair_counts(lines: DataFrame, p: CorpusParams, strings: bool, by_word: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """Lines that stand in one row are counted where they are read
    (:mod:`wordfold.operators.windows`); lines in several rows, and any under a
    vocabulary too large for the workers, by shuffled tokens."""
    voc = corpus.dense_token_ids(corpus.subsample_prob(corpus.vocab(lines, p.thr), p.sub))
    n_vocab, kept = voc.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") * (1 - F.col("p_drop"))), F.lit(0.0))).first()
    if p.win >= 1 and p.chunk_tokens >= 1 and "start" not in lines.columns and n_vocab ** 2 * (p.win + 1) < 1 << 62 and lookup.fits(voc):
        return windows.line_pair_counts(windows.whole_lines(lines), voc, n_vocab, kept * p.win, p.win, p.dyn, p.positional, p.delete,
                                        p.seed, p.chunk_tokens, strings, by_word), voc, n_vocab
    toks = corpus.mask_tokens(lines, voc, p.seed, p.chunk_tokens, vocab_rows=n_vocab, token_col="wid")
    pairs = corpus.window_pairs(toks, p.win, p.dyn, p.positional, p.delete, p.seed, p.chunk_tokens, encoded=True)
    counts = corpus.pair_counts(pairs)
    return corpus.decode_counts(counts, voc, p.win, p.positional, vocab_rows=n_vocab) if strings else counts, voc, n_vocab


def epmi_ids(lines: DataFrame, p: CorpusParams, named: bool = False, by_word: bool = False) -> tuple[DataFrame, DataFrame, int, int | None]:
    """(word, context, n, epmi) on vocabulary ids, the vocabulary, its size,
    and that size again where ids index tables that workers hold (else None).
    The counts are written once: the marginals and the cells read them. With
    ``named`` cells that take marginals in place take their words as well;
    with ``by_word`` they lie word by word."""
    enc, voc, n_vocab = encoded_counts(lines, p, by_word)
    with shuffles_dropped(lines.sparkSession):
        enc = lookup.cut_cells(enc, "counts-ids")
    dense = n_vocab if voc.dense and not p.positional else None
    own = lookup.Named.of(dense, voc) if named else dense
    return assoc.exp_pmi(enc, p.cds, max_rows=n_vocab, max_cols=n_vocab * 2 * p.win if p.positional else n_vocab, dense=own), voc, n_vocab, dense


def build_epmi(lines: DataFrame, p: CorpusParams, cells=None) -> tuple[DataFrame, tuple[int, int]]:
    """(word, context, n, epmi) for every stored cell, plus marginal bounds.

    Marginals, the smoothed total and ``cells(ep, dense)``, what is to be done
    with the cells by looking up more, run on ids; strings are attached in the
    last pass that looks something up."""
    ep, voc, n_vocab, dense = epmi_ids(lines, p, named=cells is None)
    bounds = (n_vocab, n_vocab * 2 * p.win if p.positional else n_vocab)
    return corpus.decode_counts(ep if cells is None else cells(ep, lookup.Named.of(dense, voc)), voc, p.win, p.positional, vocab_rows=n_vocab), bounds


def counts_from_lines(lines: DataFrame, p: CorpusParams, materialize: bool = True) -> DataFrame:
    return build_counts(lines, p, materialize)[0]


def ppmi_from_counts(counts: DataFrame, cds: float, bounds: tuple = (None, None)) -> DataFrame:
    """(word, context, n, epmi, pmi) for cells with pmi > 0."""
    return assoc.ppmi(assoc.exp_pmi(counts, cds, max_rows=bounds[0], max_cols=bounds[1]))


def ppmi_table(lines: DataFrame, p: CorpusParams) -> DataFrame:
    return assoc.ppmi(build_epmi(lines, p)[0])


def top_pairs(ppmi: DataFrame, k: int = 100) -> DataFrame:
    """Report: the k strongest associations (pmi desc, then word, context)."""
    return ppmi.orderBy(F.desc("pmi"), "word", "context").limit(k)
