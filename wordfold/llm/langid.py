"""Language identification by compression.

Every language gets a zstandard raw-content dictionary: short pieces of a
bounded sample of its training rows. A text, lower-cased and with everything
but letters turned into spaces, is encoded whole (in blocks, so that it can't
serve as its own dictionary) with each dictionary; the language of the
smallest encoding wins. ``score`` is the posterior of the winner if a byte
saved counts as a factor of two; ``accepted`` is false where the runner-up is
within ``MARGIN`` of the winner, and for texts without letters.

Null texts and texts without letters: ``und``, score 0. Ties: the
alphabetically first language, not accepted. Without training rows every text
is ``und``. Rows with null language or null text don't train.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordfold.llm import io

#: The sample: rows of each language and characters of each row at most.
SAMPLE_ROWS, SAMPLE_CHARS = 512, 256
DICTIONARY_BYTES = 110_000
LEVEL = 6
BLOCK_BYTES = 4096
#: Least part of the runner-up's size by which the winner must be smaller.
MARGIN = 0.002
UNDETERMINED = "und"

PREDICTIONS = "doc_id long, lang_pred string, score double, margin double, accepted boolean"

_other = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    return _other.sub(" ", text.lower()).strip()


def remainder(doc_id, parts: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def fit(rows: DataFrame) -> dict[str, bytes]:
    """Dictionary content by language from ``doc_id, text, lang``. The rows
    with the smallest hash of ``doc_id`` make the sample."""
    known = rows.filter("text is not null and lang is not null")
    # rows with a small hash only, so that few of a language meet in a task
    counts = known.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = known.select("lang", "doc_id").join(counts, "lang").filter(share * F.col("rows") < 4 * SAMPLE_ROWS)
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = few.select("lang", "doc_id").withColumn("n", F.row_number().over(by_hash)).filter(F.col("n") <= SAMPLE_ROWS)
    chosen = io.written(chosen.drop("n"), "langid-sample")  # at most SAMPLE_ROWS a language
    pieces = known.join(chosen, ["lang", "doc_id"], "left_semi").select("lang", "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("piece"))
    found = defaultdict(list)
    for r in pieces.orderBy("lang", "doc_id").collect():
        found[r["lang"]].append(letters(r["piece"]).encode())
    contents = {lang: b" ".join(p)[:DICTIONARY_BYTES] for lang, p in sorted(found.items())}
    return {lang: c for lang, c in contents.items() if len(c) >= 8}


class Classifier:
    def __init__(self, contents: dict[str, bytes]):
        self.languages = sorted(contents)
        self.encoders = []
        for lang in self.languages:
            held = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, accepted)"""
        content = letters(text) if text else ""
        if not self.languages or not any(map(str.isalpha, content)):
            return UNDETERMINED, 0.0, 0.0, False
        data = content.encode()
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = [sum(len(encode(b)) for b in blocks) for encode in self.encoders]
        best = min(sizes)
        rest = sorted(sizes)[1:]
        margin = 1 - best / rest[0] if rest else 1.0
        score = 1 / sum(2.0 ** max(-1000, best - s) for s in sizes)
        return self.languages[sizes.index(best)], score, margin, margin > MARGIN


def predict(docs: DataFrame, contents: dict[str, bytes]) -> DataFrame:
    """Predictions (``PREDICTIONS``) with the input row in ``doc``."""
    from pyspark.sql import types as T

    kept = T.StructType([*T._parse_datatype_string(PREDICTIONS).fields, T.StructField("doc", docs.schema)])
    schema = io.arrow_schema(PREDICTIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(contents)
        for batch in batches:
            doc = batch.column(0)
            found = [classifier.predict(t) for t in doc.field("text").to_pylist()]
            columns = zip(*found, strict=True) if found else [[]] * 4
            arrays = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]
            yield pa.record_batch([doc.field("doc_id").cast(pa.int64()), *arrays, doc], names=[*schema.names, "doc"])

    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")).mapInArrow(run, kept)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows whose crc32 of ``doc_id`` as text isn't 2 modulo 4."""
    return docs.filter(remainder(F.col("doc_id"), 4) != 2)


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language was accepted."""
    return predict(docs, fit(training_rows(docs))).filter("accepted").select("doc.*")


def op9_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = io.documents(spark, sf_dir)
    contents = fit(training_rows(docs))
    held_out = remainder(F.col("doc_id"), 4) == 2
    found = predict(io.spread(docs.select("doc_id", "text")), contents)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "accepted")
