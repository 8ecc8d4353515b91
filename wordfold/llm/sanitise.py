"""Personal data by patterns, and terms that give it away by information.

DataFrame functions only. Patterns find the protected entities (e-mail, IP,
card and phone numbers). For every entity that several different texts
mention, co-occurrence in the texts of the whole corpus tells how strongly a
term reveals it: ``disclosure = log(N c(e,t) / (c(e) c(t))) / log(N / c(e))`` is
the information that seeing the term gives about the entity, as a share of
all there is to know; it is 1 if the term occurs only where the entity does
and 0 if they are independent. Counts are of different texts, so copies of a
text count once. Terms at ``REMOVE`` or more are removed, at ``GENERALISE``
or more generalised, wherever they stand outside an entity.

Null texts are empty and have no spans; rows with null or repeated ``doc_id``
are rows of their own. Terms are runs of letters, lower-cased. Equal starts
are ordered by kind. An empty table gives no rows. Other columns are ignored.

The patterns are written so that Java's engine needs neither recursion nor a
second look at a character, with the same matches as the plain ones.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordfold.llm import io
from wordfold.session import size_bounded_broadcast

#: Kind, pattern and a cheap test that a text may hold it (fixed values).
#: A match of the first starts where its run of characters does, or at once
#: after a match; the others take all they can, and nothing follows that could
#: make them give back.
KINDS = [
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
]
TERM_KINDS = ["remove", "generalise"]
NAMES = [k for k, _, _ in KINDS] + TERM_KINDS
TERM = r"\p{L}++"

#: Different texts that must mention an entity, and a term with it.
SUPPORT = 3
REMOVE, GENERALISE = 0.9, 0.6
#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 300_000

SPAN = "array<struct<start:int,kind:int,end:int>>"


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _valid_at(kind: str, matches: Column, i: Column) -> Column:
    return _valid(kind, F.get(matches, i))


def _total(sizes: Column, n: Column) -> Column:
    return F.aggregate(F.slice(sizes, F.lit(1), n), F.lit(0), lambda a, x: a + x)


def _positions(matches: Column, rests: Column, wanted: Column, kind: Column) -> Column:
    """Spans of the matches with the ``wanted`` numbers; ``rests`` is the text
    split by the pattern, so what comes before a match has known lengths."""
    inside, between = F.transform(matches, F.length), F.transform(rests, F.length)

    def span(i: Column) -> Column:
        start = _total(between, i + 1) + _total(inside, i)
        return F.struct(start.alias("start"), kind.alias("kind"), (start + F.get(inside, i)).alias("end"))

    return F.transform(wanted, span)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base``: the spans of all kinds, by start and kind."""
    none = F.expr(f"cast(array() as {SPAN})")
    out, found = docs, []
    body = F.coalesce(F.col(text), F.lit(""))
    for number, (kind, pattern, mark) in enumerate(KINDS):
        may = F.contains(body, F.lit(mark)) if mark else F.lit(True)
        matches = F.when(may, F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        out = out.withColumn(f"_all_{kind}", matches)
        held = F.col(f"_all_{kind}")
        numbers = F.when(F.size(held) > 0, F.sequence(F.lit(0), F.size(held) - 1)).otherwise(F.array().cast("array<int>"))
        out = out.withColumn(f"_ok_{kind}", F.filter(numbers, partial(_valid_at, kind, held)))
        ok = F.col(f"_ok_{kind}")
        spans = _positions(held, F.split(body, pattern, -1), ok, F.lit(number))
        found.append(F.when(F.size(ok) > 0, spans).otherwise(none))
    base = F.array_sort(F.concat(*found))
    out = out.withColumn("base", base)
    return out.select(*[docs[f"`{c}`"] for c in docs.columns], "base")


def span_list(spans: Column) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def _with_bound(rows: DataFrame) -> DataFrame:
    return size_bounded_broadcast(rows, BROADCAST_ROWS)


def _keyed(docs: DataFrame) -> DataFrame:
    """``row, text, text_key``; a text's key is its hash."""
    return docs.select("row", "text", F.xxhash64("text").alias("text_key"))


def _entity_values(text: Column, base: Column) -> Column:
    """The protected values: kind and canonical form."""

    def value(s: Column) -> Column:
        raw = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        plain = F.when(s["kind"] >= 2, F.regexp_replace(raw, "[^0-9]", "")).otherwise(F.lower(raw))
        return F.concat_ws(":", s["kind"].cast("string"), plain)

    return F.transform(base, value)


def revealing_terms(docs: DataFrame, holders: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``row, term, disclosure`` of the places of revealing terms. ``docs``
    has ``row, text``; ``holders`` the rows with entities."""
    texts = _keyed(docs)
    n_texts = texts.agg(F.count_distinct("text_key")).first()[0]
    near = base_spans(texts.join(_with_bound(holders), "row", "left_semi").dropDuplicates(["text_key"])).filter(F.size("base") > 0)
    near = io.written(near.select("text_key", F.array_distinct(_terms(F.col("text"))).alias("terms"), F.array_distinct(_entity_values(F.col("text"), F.col("base"))).alias("values")), "entity-texts")
    of_text = near.select("text_key", F.explode("values").alias("entity"))
    frequent = of_text.groupBy("entity").agg(F.count("*").alias("c_e")).filter(F.col("c_e") >= support)
    of_text = of_text.join(_with_bound(io.written(frequent, "entities")), "entity")
    beside = near.select("text_key", F.explode("terms").alias("term"))
    pairs = of_text.join(beside, "text_key").groupBy("entity", "c_e", "term").agg(F.count("*").alias("c_et")).filter(F.col("c_et") >= support)
    n = F.lit(float(max(n_texts, 2)))
    # texts that a term may stand in at most to be told apart
    most = n * F.col("c_et") / F.col("c_e") * F.pow(F.col("c_e") / n, F.lit(GENERALISE))
    pairs = io.written(pairs.withColumn("most", most), "entity-terms")

    # words in far more texts are left out by an estimate (a sketch of 5 % error
    # against twice the bound); the others are counted exactly
    candidates = io.written(pairs.groupBy("term").agg(F.max("most").alias("most")), "candidate-terms")
    every = texts.select("row", "text_key", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    rough = every.join(_with_bound(candidates), "term").groupBy("term").agg(F.approx_count_distinct("text_key", 0.05).alias("c"), F.max("most").alias("most"))
    candidates = io.written(rough.filter(F.col("c") <= 2 * F.col("most")).select("term"), "candidate-terms")
    places = io.written(every.join(_with_bound(candidates), "term", "left_semi"), "term-places")
    frequency = places.select("text_key", "term").distinct().groupBy("term").agg(F.count("*").alias("c_t"))
    known, told = F.log(n / F.col("c_e")), F.log(n * F.col("c_et") / (F.col("c_e") * F.col("c_t")))
    scored = pairs.join(frequency, "term").withColumn("disclosure", F.when(known > 0, told / known).otherwise(0.0))
    terms = scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)
    return places.select("row", "term").distinct().join(_with_bound(io.written(terms, "revealing-terms")), "term")


def sanitise(docs: DataFrame) -> DataFrame:
    """``row, doc_id, base, spans`` for every row of ``doc_id, text``: the
    spans of the patterns, and all spans with those of revealing terms."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text")).withColumn("row", F.xxhash64("doc_id", F.xxhash64("text")))
    found = io.written(base_spans(rows).drop("text"), "base-spans")
    places = revealing_terms(rows.select("row", "text"), found.filter(F.size("base") > 0).select("row").distinct())
    kind = F.when(F.col("disclosure") >= REMOVE, F.lit(len(KINDS))).otherwise(F.lit(len(KINDS) + 1))
    marked = places.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", kind.alias("kind")))).alias("marked"))
    marked = io.written(marked, "marked-rows")

    # a pattern of the row's own terms: they are letters only
    own = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.map_keys("marked"), "|"), F.lit(r")(?!\p{L})"))
    there = rows.select("row", "text").join(_with_bound(marked), "row").dropDuplicates(["row"]).withColumn("own", own)
    there = there.withColumn("hits", F.regexp_extract_all("text", F.col("own"), F.lit(0))).withColumn("rests", F.split(F.col("text"), F.col("own"), -1))
    inside, between = F.transform("hits", F.length), F.transform("rests", F.length)

    def span(hit: Column, i: Column) -> Column:
        start = _total(between, i + 1) + _total(inside, i)
        return F.struct(start.alias("start"), F.try_element_at("marked", F.lower(hit)).alias("kind"), (start + F.length(hit)).alias("end"))

    extra = F.filter(F.transform("hits", span), lambda s: s["kind"].isNotNull())
    there = io.written(there.select("row", extra.alias("extra")), "term-spans")
    joined = found.join(_with_bound(there), "row", "left")
    clear = F.filter("extra", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    spans = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat(F.col("base"), clear)))
    return joined.select("row", "doc_id", "base", spans.alias("spans"))


def sanitised_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with entities replaced by their kind, generalised
    terms by ``<TERM>`` and removed terms by nothing. Of overlapping spans the
    first gives the replacement for all."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("row", F.xxhash64("doc_id", F.xxhash64("text")))
    spans = sanitise(docs).select("row", "spans").dropDuplicates(["row"])
    none = F.expr(f"cast(array() as {SPAN})")

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(F.size(done) == 0, F.array(s)).when(last["end"] <= s["start"], F.concat(done, F.array(s))).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown)))

    marks = F.array(*[F.lit(f"<{k.upper()}>") for k, _, _ in KINDS], F.lit(""), F.lit("<TERM>"))
    merged = F.aggregate("spans", none, merge)
    replaced = F.aggregate(F.reverse("merged"), F.col("text"), lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.get(marks, s["kind"]), F.substring(t, s["end"] + 1, F.length(t))))
    return rows.join(spans, "row").withColumn("merged", merged).select("doc_id", replaced.alias("text"))


def op8_information_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(io.spread(io.documents(spark, sf_dir).select("doc_id", "text")))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, (kind, _, _) in enumerate(KINDS)]
    terms = F.size(F.filter("spans", lambda s: s["kind"] >= len(KINDS))).cast("long").alias("n_terms")
    return found.select("doc_id", *counts, F.sha2(span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"), terms)
