"""Text sources: corpora, count lines, vector lines, similarity and analogy sets.

Each parser takes a DataFrame with one string column of lines (what
``spark.read.text`` returns as ``value``) so the same code serves files and lines
built from tables; the ``read_*`` twins take a path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordfold.functions.text import tokens
from wordfold.session import cut_lineage


def read_corpus(df: DataFrame, text_col: str = "text", key_col: str = "doc_id", lower: bool = False) -> DataFrame:
    """A1. Documents -> one row per non-empty line: (doc_id, line_no, toks).

    ``line_no`` is the 0-based position of the line inside the document text
    (blank lines keep their number but produce no row)."""
    text = F.col(text_col)
    if lower:
        text = F.lower(text)
    lines = df.select(F.col(key_col).cast("long").alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("int").alias("line_no"), tokens("line").alias("toks")).where(F.size("toks") > 0)


def read_corpus_text(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """A1 for plain text files: each file line is a corpus line. Files are read
    by splits, not whole; doc_id names the file's split and line_no numbers the
    lines of it in the order of the file. Lines without tokens drop."""
    raw = spark.read.text(path).select("value", F.xxhash64(F.input_file_name()).alias("file"), F.monotonically_increasing_id().alias("n"))
    line = F.lower("value") if lower else F.col("value")
    numbered = raw.select(F.xxhash64("file", F.shiftright("n", 33)).alias("doc_id"),
                          F.col("n").bitwiseAND((1 << 33) - 1).cast("int").alias("line_no"), tokens(line).alias("toks"))
    return numbered.where(F.size("toks") > 0)


#: Tokens of a line in one row of ``read_corpus_words``.
PIECE_TOKENS = 4096

PIECES = "file string, block long, feeds long, start long, toks array<string>, whole boolean"


def _pieces(lower: bool, size: int):
    """Words as they stand between spaces -> rows of ``PIECES``: ``feeds`` line
    feeds and ``start`` tokens of the line come before, in this split; the line
    is ``whole`` if it begins and ends in the row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, feeds, start, held = None, 0, 0, []

        def flush(rows: list, whole: bool) -> None:
            nonlocal start, held
            for lo in range(0, len(held), size):
                rows.append((*key, feeds, start, held[lo:lo + size], whole and len(held) <= size))
                start += len(held[lo:lo + size])
            held = []

        for batch in batches:
            rows: list = []
            # a batch may hold the end of one split and the beginning of others
            for now, words in batch.groupby(["file", "block"], sort=False)["value"]:
                if now != key:
                    if key:
                        flush(rows, False)
                        rows.append((*key, feeds, start, [], False))
                    key, feeds, start, held = now, 0, 0, []
                text = " ".join(words)
                first, *later = (text.lower() if lower else text).encode().split(b"\n")
                held += [t.decode() for t in first.split()]
                for line in later:
                    flush(rows, feeds > 0 and start == 0)
                    feeds, start, held = feeds + 1, 0, [t.decode() for t in line.split()]
                if len(held) >= size:
                    flush(rows, False)
            yield pd.DataFrame(rows, columns=["file", "block", "feeds", "start", "toks", "whole"])
        if key:
            rows = []
            flush(rows, False)
            rows.append((*key, feeds, start, [], False))  # how the split ends, tokens or not
            yield pd.DataFrame(rows, columns=["file", "block", "feeds", "start", "toks", "whole"])

    return run


def read_corpus_words(spark: SparkSession, path: str, lower: bool = False, piece_tokens: int = PIECE_TOKENS) -> DataFrame:
    """A1 for text files whose lines may be as long as the file: (doc_id,
    line_no, start, line_tokens, toks), ``toks`` being at most about
    ``piece_tokens`` tokens of a line from its token ``start`` on.

    Files are read by splits at spaces, with line feeds as marks inside the
    records, so a file of one line is spread like any other. Each split numbers
    its own lines and tokens; a row per split tells what the splits before it
    had. So doc_id (by file), line_no and start are the same however the files
    are split. For texts with spaces; a file without any is one record. Lines
    without tokens drop."""
    # splits are told apart by where they start in their file
    raw = spark.read.option("lineSep", " ").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    pieces = cut_lineage(raw.select("file", "block", "value").mapInPandas(_pieces(lower, piece_tokens), PIECES), "corpus-pieces")
    # one row per split: its line feeds and the tokens after the last of them
    splits = pieces.groupBy("file", "block").agg(F.max("feeds").alias("feeds"), F.max(F.struct("feeds", F.col("start") + F.size("toks")))["col2"].alias("tail"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("line", F.sum((F.col("feeds") > 0).cast("long")).over(order))
    # the tail of a split belongs to the line that is open when it ends
    open_line = Window.partitionBy("file", "line").orderBy("block")
    splits = splits.withColumn("open", F.sum("tail").over(open_line))
    splits = splits.select("file", "block", F.coalesce(F.sum("feeds").over(before), F.lit(0)).alias("lines_before"),
                           F.coalesce(F.lag("open").over(order), F.lit(0)).alias("tokens_before"))
    here = pieces.where(F.size("toks") > 0).join(splits, ["file", "block"])
    carried = F.when(F.col("feeds") == 0, F.col("tokens_before")).otherwise(0)
    placed = here.select(F.xxhash64("file").alias("doc_id"), (F.col("lines_before") + F.col("feeds")).alias("line_no"),
                         (F.col("start") + carried).alias("start"), "toks", "whole")
    # only lines in several rows are added up
    sizes = placed.where(~F.col("whole")).groupBy("doc_id", "line_no").agg(F.sum(F.size("toks")).alias("line_tokens"))
    found = placed.join(sizes, ["doc_id", "line_no"], "left")
    return found.select("doc_id", "line_no", "start", F.coalesce("line_tokens", F.size("toks").cast("long")).alias("line_tokens"), "toks")


def rejected_lines(lines: DataFrame, fields: tuple[int, int | None], numbers: tuple[int, ...] = (), col: str = "value") -> DataFrame:
    """The lines that the parsers here leave out though they aren't blank:
    fewer or more fields than ``fields`` (least, most), or no number where
    there should be one (1-based places)."""
    parts = F.filter(F.split(F.trim(F.col(col)), r"[ \t\n\r\f\x0B]+"), lambda t: t != F.lit(""))
    least, most = fields
    wrong = F.size(parts) < least
    if most is not None:
        wrong = wrong | (F.size(parts) > most)
    for place in numbers:
        wrong = wrong | F.try_element_at(parts, F.lit(place)).try_cast("double").isNull()
    return lines.where((F.size(parts) > 0) & wrong)


#: Fields and numeric places of the formats: counts, word similarity,
#: analogies, matrix cells, count vocabularies.
FORMATS = {"counts": ((3, 3), (1,)), "wordsim": ((3, 3), (3,)), "analogies": ((4, 4), ()), "coo": ((3, 3), (1, 2, 3)), "count_vocab": ((2, 2), (2,))}


def require_readable(lines: DataFrame, kind: str, col: str = "value") -> DataFrame:
    """``lines`` if all can be read as the format; raises with their number
    and the first of them otherwise."""
    bad = rejected_lines(lines, *FORMATS[kind], col)
    found = bad.agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("first")).first()
    if found["n"]:
        raise ValueError(f"{found['n']} lines are no {kind}, such as {found['first']!r}")
    return lines


def parse_counts(lines: DataFrame, col: str = "value") -> DataFrame:
    """A2. 'count word context' with leading blanks -> (word, context, n)."""
    parts = F.split(F.trim(F.col(col)), " +")
    return lines.select(
        F.try_element_at(parts, F.lit(2)).alias("word"),
        F.try_element_at(parts, F.lit(3)).alias("context"),
        F.try_element_at(parts, F.lit(1)).try_cast("long").alias("n"),
    ).where(F.col("context").isNotNull() & F.col("n").isNotNull())


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return parse_counts(require_readable(spark.read.text(path), "counts"))


def format_counts(counts: DataFrame, width: int = 7) -> DataFrame:
    """Inverse of A2: the 'uniq -c' style line with a right-aligned count."""
    return counts.select(
        F.concat_ws(" ", F.lpad(F.col("n").cast("string"), width, " "), "word", "context").alias("value")
    )


def parse_vectors(lines: DataFrame, col: str = "value") -> DataFrame:
    """A8. 'word v1 ... vk' -> (word, vec array<double>)."""
    parts = F.filter(F.split(F.trim(F.col(col)), r"[ \t]+"), lambda t: t != F.lit(""))
    return lines.where(F.size(parts) > 0).select(
        F.try_element_at(parts, F.lit(1)).alias("word"),
        F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.try_cast("double")).alias("vec"),
    )


def read_vectors_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_vectors(spark.read.text(path))


def parse_wordsim(lines: DataFrame, col: str = "value") -> DataFrame:
    """A12. 'w1 w2 score' (tabs or blanks, CRLF) -> lower-cased (w1, w2, gold).

    The gold score is cast to double (numeric ranking, not text ranking)."""
    parts = F.filter(F.split(F.lower(F.trim(F.col(col))), r"[ \t\n\r\f\x0B]+"), lambda t: t != F.lit(""))
    return lines.where(F.size(parts) == 3).select(
        parts.getItem(0).alias("w1"), parts.getItem(1).alias("w2"), parts.getItem(2).try_cast("double").alias("gold")
    )


def read_wordsim(spark: SparkSession, path: str) -> DataFrame:
    return parse_wordsim(require_readable(spark.read.text(path), "wordsim"))


def parse_analogies(lines: DataFrame, col: str = "value") -> DataFrame:
    """A13. 'a a_ b b_' lower-cased -> (a, a_, b, b_) with a question id."""
    parts = F.filter(F.split(F.lower(F.trim(F.col(col))), r"[ \t\n\r\f\x0B]+"), lambda t: t != F.lit(""))
    return lines.where(F.size(parts) == 4).select(
        parts.getItem(0).alias("a"), parts.getItem(1).alias("a_"), parts.getItem(2).alias("b"), parts.getItem(3).alias("b_")
    )


def read_analogies(spark: SparkSession, path: str) -> DataFrame:
    """Analogy files may hold section names, which have other numbers of
    fields; :func:`rejected_lines` lists them."""
    return parse_analogies(spark.read.text(path))


WORDSIM_SCHEMA = T.StructType(
    [T.StructField("w1", T.StringType()), T.StructField("w2", T.StringType()), T.StructField("gold", T.DoubleType())]
)
