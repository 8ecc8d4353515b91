"""Operators against brute force, on the smallest table and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wordfold.llm import decontaminate, exact_dedup, graph, interpolated_lm, io, langid, line_dedup, packing, sanitise, set_join, substring_dedup, token_files
from wordfold.llm.catalog import QUERIES
from wordfold.llm.tokens import default_vocabulary, encoder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def ids_of(text):
    e = encoder(default_vocabulary())
    return np.append(np.frombuffer(e.encode(text), e.dtype), 0).astype("<u4")


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def id_key(d):
    return (d is not None, d or 0)


# -- 1 ---------------------------------------------------------------------


def expected_files(rows):
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (id_key(r[0]), r[1] is not None, r[1] or "")):
        ids = ids_of(text)
        out.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_token_files(spark, sf, documents):
    found = rows_of(QUERIES["op1_token_files"](spark, sf), "doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(found) == expected_files(documents.items())


def test_token_files_of_odd_rows(spark, odd, odd_rows, nothing):
    folder = io.shared_dir(spark, "test-files")
    manifest = token_files.write_token_files(odd, folder, length=16, rows=4)
    found = rows_of(token_files.read_documents(manifest), "doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(found, key=lambda r: r[1]) == expected_files(odd_rows)
    for row in manifest.collect():
        reader = token_files.ShardReader(row["path"])
        stream = np.concatenate([np.concatenate(list(reader.spans(s, n))) for s, n in zip(reader.index["start"].to_pylist(), reader.index["n_tokens"].to_pylist(), strict=True)])
        for i in range(math.ceil(len(stream) / 16)):
            ids, mask = reader.sequence(i)
            want = stream[16 * i : 16 * i + 16]
            assert len(ids) == 16 and ids[mask].tolist() == want.tolist() and mask.sum() == len(want)
    assert token_files.read_documents(token_files.write_token_files(nothing, folder + "-none")).count() == 0


# -- 2 ---------------------------------------------------------------------


def item_words(text):
    capitals = {i: i + 32 for i in [*range(65, 91), *[c for c in range(0xC0, 0xDF) if c != 0xD7]]}
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").translate(capitals))


def expected_leaks(rows, items):
    out = Counter()
    for item_id, text in items:
        w = item_words(text)
        if not w:
            continue
        k = min(5, len(w))
        own, m = Counter(zip(*[w[j:] for j in range(k)], strict=False)), len(w) - k + 1
        for d, other in rows:
            v = item_words(other)
            grams = list(zip(*[v[j:] for j in range(k)], strict=False))
            best = None
            for s in range(len(v) - len(w) + 1):
                common = sum(min(n, own[g]) for g, n in Counter(grams[s : s + m]).items() if g in own)
                similarity = common / (2 * m - common)
                if similarity >= 0.8 and (best is None or similarity > best[0]):
                    best = (similarity, s)
            if best:
                out[(d, item_id, best[0], best[1], len(w))] += 1
    return out


COLUMNS2 = ("doc_id", "item_id", "similarity", "first_word", "n_words")


def test_decontamination(spark, sf, documents):
    found = Counter(rows_of(QUERIES["op2_simhash_decontamination"](spark, sf), *COLUMNS2))
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert found == expected_leaks(documents.items(), items) and found


def test_decontamination_finds_changed_passages(spark, odd, odd_rows, nothing):
    item = [f"Item{i}" for i in range(40)]
    changed = [w if i != 1 else "else" for i, w in enumerate(item)]
    broken = [w if i % 6 else "else" for i, w in enumerate(item)]
    rows = [*odd_rows, (50, "So: " + ", ".join(item) + "!"), (51, "So " + " ".join(changed)), (52, " ".join(broken)), (53, "ÉTÉ deux mots")]
    items = [(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, "..."), (4, "été deux"), (5, " ".join(f"shared{i}" for i in range(30))), (None, "tab and two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.ITEM_BYTES, 200):
        found = Counter(rows_of(decontaminate.leaks(docs, bench, limit), *COLUMNS2))
        assert found == expected_leaks(rows, items)
    assert {d for d, i, *_ in found if i == 1} == {50, 51}
    assert decontaminate.clean_documents(odd, bench).columns == odd.columns
    assert decontaminate.leaks(nothing, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


# -- 3 ---------------------------------------------------------------------


def check_packing(found, rows, window=packing.WINDOW):
    """Every id of every document in one piece, sequences without gaps."""
    texts = defaultdict(list)
    for d, text in rows:
        texts[d].append(ids_of(text))
    whole = defaultdict(list)
    for r in found:
        whole[r.doc_id].append(r)
    assert set(whole) == set(texts)
    for d, pieces in whole.items():
        assert sum(p.length for p in pieces) == sum(map(len, texts[d]))
        if len(texts[d]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(texts[d][0])
                assert crc(texts[d][0][at : at + p.length]) == p.ids_crc32
                at += p.length
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    short = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        short += at < window
    assert short <= 1


def test_packing(spark, sf, documents):
    check_packing(QUERIES["op3_nnls_packing"](spark, sf).collect(), documents.items())


def test_packing_of_odd_rows(spark, odd, odd_rows, nothing):
    check_packing(packing.packed_documents(odd).collect(), odd_rows)
    same = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("one two three four five six").alias("text"))
    check_packing(packing.packed_documents(same).collect(), [(i, "one two three four five six") for i in range(300)])
    assert packing.packed_documents(nothing).count() == 0


def test_packed_ids(spark, documents):
    rows = list(documents.items())[:20]
    encoded = packing.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in packing.with_ids(packing.pack(encoded).drop("ids_crc32", "doc_tokens").withColumn("doc_tokens", F.lit(0)), encoded).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == ids_of(documents[r.doc_id])[r.start : r.start + r.length].tolist()


# -- 4 ---------------------------------------------------------------------


def expected_removal(rows, length=50):
    first = {}
    for d, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, math.inf), math.inf if d is None else d)
    out = []
    for d, text in rows:
        b, reach, gone = (text or "").encode(), 0, []
        for i in range(len(b)):
            if i + length <= len(b) and first[b[i : i + length]] < (math.inf if d is None else d):
                reach = i + length
            gone.append(i < reach)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return Counter(out)


COLUMNS4 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_substring_removal(spark, sf, documents):
    assert Counter(rows_of(QUERIES["op4_suffix_array_dedup"](spark, sf), *COLUMNS4)) == expected_removal(documents.items())


def test_substring_removal_of_odd_rows(spark, odd, odd_rows, nothing):
    assert Counter(rows_of(substring_dedup.remove_repeats(odd), *COLUMNS4)) == expected_removal(odd_rows)
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_substring_removal_with_runs_and_overlaps(spark):
    rng = np.random.default_rng(6)
    base = "".join(rng.choice(list("ab"), 400))
    rows = [(i, base[a:b]) for i, (a, b) in enumerate(np.sort(rng.integers(0, 400, (25, 2)), axis=1).tolist())]
    rows += [(100, "a" * 300), (101, "a" * 120 + "b" * 60), (102, "ab" * 90), (90, "x" + "ab" * 60), (103, "a" * 49)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(rows_of(substring_dedup.remove_repeats(docs), *COLUMNS4)) == expected_removal(rows)


# -- 5 ---------------------------------------------------------------------

COLUMNS5 = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_dedup_equals_its_sql(spark, sf):
    documents = duckdb.sql(f"SELECT * FROM '{sf}/documents.parquet'")  # noqa: F841
    expected = duckdb.sql(exact_dedup.OP5_SQL).fetchall()
    assert sorted(rows_of(QUERIES["op5_exact_dedup"](spark, sf), *COLUMNS5)) == sorted(expected)
    docs = io.documents(spark, sf)
    for hashed, limit in ((exact_dedup.content_hash, 5000), (lambda b: len(b) % 3, 3000)):
        found = exact_dedup.dedup_rows(docs, hashed, limit)[1]
        assert sorted(rows_of(found, *COLUMNS5)) == sorted(expected)


def test_exact_dedup_of_odd_rows(spark, odd, odd_rows, nothing):
    groups = defaultdict(list)
    for d, text in odd_rows:
        groups[text or ""].append(d)
    found = exact_dedup.dedup_rows(odd)[1].collect()
    assert len(found) == len(odd_rows) and sum(r.kept for r in found) == len(groups)
    sizes = {hashlib.sha256(t.encode()).hexdigest(): (max(ds, key=id_key), len(ds)) for t, ds in groups.items()}
    for r in found:
        assert (r.keep_id, r.group_size) == sizes[r.text_sha256]
    stay = exact_dedup.unique_documents(odd)
    assert stay.columns == odd.columns
    assert Counter(r.text or "" for r in stay.collect()) == Counter(list(groups))
    assert exact_dedup.dedup_rows(nothing)[1].count() == exact_dedup.unique_documents(nothing).count() == 0


# -- 6 ---------------------------------------------------------------------


def expected_lines(rows):
    """By plain lines: partners are the first documents of shared lines."""
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, n))
    lines = [(t or "").split("\n") for _, t in rows]
    first = {}
    for n in order:
        for x in lines[n]:
            if x.strip():
                first.setdefault(x, n)
    out = []
    for n, (d, _) in enumerate(rows):
        partners = {first[x] for x in lines[n] if x.strip()} - {n}
        gone = set()
        for p in partners:
            numbers = {x: i for i, x in enumerate({*lines[n], *lines[p]}, 1)}
            code = lambda xs, numbers=numbers: np.array([numbers[x] if x.strip() else 0 for x in xs], np.int64)
            gone.update(line_dedup.cuts(code(lines[n]), np.array([len(x) for x in lines[n]]), code(lines[p])))
        kept = "\n".join(x for i, x in enumerate(lines[n]) if i not in gone)
        out.append((d, len(lines[n]), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


COLUMNS6 = ("doc_id", "n_lines", "n_removed", "kept_sha256")


def test_line_dedup(spark, sf, documents):
    found = Counter(rows_of(QUERIES["op6_patience_line_dedup"](spark, sf), *COLUMNS6))
    assert found == expected_lines_of_all_pairs(list(documents.items())) and any(r[2] for r in found)


def test_line_dedup_of_odd_rows(spark, odd, odd_rows, nothing):
    block = "\n".join(f"a line of the block, number {i}" for i in range(6))
    rows = [r for r in odd_rows if r != (12, odd_rows[9][1])] + [(30, block), (31, f"own\n{block}\n\nown too"), (32, block.replace("number 3", "other")), (33, "x\n\ny"), (34, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert Counter(rows_of(line_dedup.remove_lines(docs), *COLUMNS6)) == expected_lines(rows)
    assert line_dedup.remove_lines(odd).count() == len(odd_rows)
    assert line_dedup.remove_lines(nothing).count() == 0


def expected_lines_of_all_pairs(rows):
    """By plain lines: every earlier document that shares a line is aligned."""
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, n))
    place = {n: i for i, n in enumerate(order)}
    lines = [(t or "").split("\n") for _, t in rows]
    shared = [{x for x in xs if x.strip()} for xs in lines]
    out = []
    for n, (d, _) in enumerate(rows):
        gone = set()
        for p in range(len(rows)):
            if place[p] < place[n] and shared[p] & shared[n]:
                numbers = {x: i for i, x in enumerate({*lines[n], *lines[p]}, 1)}
                code = lambda xs, numbers=numbers: np.array([numbers[x] if x.strip() else 0 for x in xs], np.int64)
                gone.update(line_dedup.cuts(code(lines[n]), np.array([len(x) for x in lines[n]]), code(lines[p])))
        kept = "\n".join(x for i, x in enumerate(lines[n]) if i not in gone)
        out.append((d, len(lines[n]), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("few", [line_dedup.FEW_PAIRS, 0])
def test_line_dedup_meets_every_partner(spark, monkeypatch, few):
    """Crossed lines, short lines whose first holders are scattered, copies."""
    monkeypatch.setattr(line_dedup.overlapping_cuts, "__defaults__", (few,))
    one, two = "the first line, of twenty and more", "the second line, of twenty and more"
    short = [f"short{i}" for i in range(6)]
    rows = [(1, f"{two}\n{one}"), (2, f"{one}\n{two}"), (3, f"{one}\n{two}")]
    rows += [(10 + i, f"own line number {i} of a holder\n{x}") for i, x in enumerate(short)]
    rows += [(20, "\n".join(["before", *short, "after"])), (21, "\n".join(["else", *short])), (None, "\n".join(short))]
    rng = np.random.default_rng(6)
    pool = [f"{'long line of the pool' if i % 2 else 'line'} {i}" for i in range(9)] + ["", " "]
    rows += [(int(n), "\n".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(1, 9)))) for n in rng.integers(100, 140, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = Counter(rows_of(line_dedup.remove_lines(docs), *COLUMNS6))
    assert found == expected_lines_of_all_pairs(rows)
    removed = {d: n for d, _, n, _ in found}
    assert removed[3] == 2 and removed[21] == removed[None] == 6


def test_line_dedup_of_the_table_meets_every_partner(spark, sf, documents):
    found = Counter(rows_of(QUERIES["op6_patience_line_dedup"](spark, sf), *COLUMNS6))
    assert found == expected_lines_of_all_pairs(list(documents.items()))


def test_patience_alignment():
    rng = np.random.default_rng(8)
    for _ in range(300):
        a, b = (rng.integers(0, 6, rng.integers(0, 12)).tolist() for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] != 0 for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert line_dedup.patience([1, 2, 3, 9, 4], [7, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 3), (4, 4)]
    assert line_dedup.patience([5, 1, 5], [1, 5, 5]) == [(0, 1), (2, 2)] or line_dedup.patience([5, 1, 5], [1, 5, 5]) == [(1, 0), (2, 2)]


def test_alignment_of_repeated_lines(spark):
    """A passage that stands twice in one document has no line that anchors."""
    assert line_dedup.patience([11, 1, 2, 12, 1, 2, 13], [21, 1, 2, 22]) == [(1, 1), (2, 2)]
    rng = np.random.default_rng(9)
    for _ in range(500):
        a, b = (rng.integers(0, 4, rng.integers(1, 30)).tolist() for _ in range(2))
        blocks = {(-n, i, j) for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if 0 not in a[i : i + n] and a[i : i + n] == b[j : j + n]}
        want = min(blocks, default=(0, 0, 0))
        assert line_dedup.common_block(a, b) == (want[1], want[2], -want[0])
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] != 0 for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert line_dedup.patience(a, a) == [(i, i) for i, x in enumerate(a) if x]
        assert pairs or not blocks
    page = "the head of each page\nand the line below it"
    rows = [(1, f"v1\n{page}\nv2"), (2, f"u1\n{page}\nu2\n{page}\nu3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert Counter(rows_of(line_dedup.remove_lines(docs), *COLUMNS6)) == expected_lines_of_all_pairs(rows)
    assert {(d, n) for d, _, n, _ in rows_of(line_dedup.remove_lines(docs), *COLUMNS6)} == {(1, 0), (2, 2)}


# -- 7 ---------------------------------------------------------------------


def expected_scores(rows, kinds):
    """(n_tokens, n_known, N, base, score) by definition, for word pairs."""
    texts = [[*words(t), "\0end"] for _, t in rows]

    def counted(keep):
        one, two, n = Counter(), Counter(), 0
        for w, k in zip(texts, kinds, strict=True):
            if k in keep:
                one.update(w)
                two.update(zip(["\0start", *w[:-1]], w, strict=True))
                n += 1
        total, types = sum(one.values()), len(one)
        low = lambda x: (one[x] + 0.5) / (total + 0.5 * (types + 1))
        context = lambda v: n if v == "\0start" else one[v]
        return one, two, total, low, context

    one, two, total, low, context = counted({0, 1})
    _, rest_two, _, rest_low, rest_context = counted({0})
    ratios = defaultdict(list)
    for w, k in zip(texts, kinds, strict=True):
        if k == 1:
            for v, x in zip(["\0start", *w[:-1]], w, strict=True):
                if rest_context(v):
                    ratios[int(math.log2(rest_context(v)))].append(rest_two[v, x] / rest_context(v) / rest_low(x))
    weights = {}
    for c, rs in ratios.items():
        r, weight = np.array(rs), 0.5
        for _ in range(200):
            weight = min(max(float(np.mean(weight * r / (weight * r + 1 - weight))), 1e-6), 1 - 1e-6)
        weights[c] = weight
    met = sorted(weights)

    def weight_of(n):
        below = [m for m in met if m <= int(math.log2(n))]
        return weights[below[-1] if below else met[0]] if met else 0.0

    out = []
    for w in texts:
        base = score = 0.0
        for v, x in zip(["\0start", *w[:-1]], w, strict=True):
            p = low(x)
            base += math.log10(p)
            if context(v):
                share = weight_of(context(v))
                p = share * two[v, x] / context(v) + (1 - share) * p
            score += math.log10(p)
        out.append((len(w), sum(x in one for x in w), total, base, score))
    return out


def close(found, expected):
    assert found[:3] == expected[:3]
    assert found[3] == pytest.approx(expected[3], rel=1e-9)
    assert found[4] == pytest.approx(expected[4], rel=1e-4)


def test_language_model(spark, sf, documents):
    rows = sorted(documents.items())
    rest = [zlib.crc32(str(d).encode()) % 5 for d, _ in rows]
    expected = expected_scores(rows, [2 if r == 1 else 1 if r == 0 else 0 for r in rest])
    found = sorted(QUERIES["op7_deleted_interpolation"](spark, sf).collect())
    gain = 0.0
    for r, (d, _), e, m in zip(found, rows, expected, rest, strict=True):
        assert r.doc_id == d and r.held_out == (m == 1)
        close((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), e)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0


def test_language_model_of_odd_rows(spark, odd, odd_rows, nothing):
    kinds = [(zlib.crc32((t or "").encode()) % 5) for _, t in odd_rows]
    kinds = [2 if k == 1 else 1 if k == 0 else 0 for k in kinds]
    crc32 = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")) % 5
    docs = odd.withColumn("kind", F.when(crc32 == 1, 2).when(crc32 == 0, 1).otherwise(0))
    for block_bytes in (interpolated_lm.BLOCK_BYTES, 2000):
        found = interpolated_lm.score(docs, block_bytes=block_bytes).collect()
        expected = expected_scores(odd_rows, kinds)
        order = lambda d, e: (id_key(d), e[0], e[4])
        mine = sorted(((r.doc_id, (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in found), key=lambda r: order(*r))
        for (d, f), (e_d, e) in zip(mine, sorted(zip([d for d, _ in odd_rows], expected, strict=True), key=lambda r: order(*r)), strict=True):
            assert d == e_d
            close(f, e)
    assert interpolated_lm.score(nothing.withColumn("kind", F.lit(0))).count() == 0
    alone = interpolated_lm.score(odd.withColumn("kind", F.lit(2))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in alone)


def test_longer_orders_predict_repeated_texts_better(spark):
    rows = [(i, " ".join(f"w{(i % 7) * 31 + j * j % 50}" for j in range(40))) for i in range(60)]
    docs = spark.createDataFrame([(*r, 2 if r[0] % 5 == 1 else 1 if r[0] % 5 == 0 else 0) for r in rows], "doc_id long, text string, kind int")
    score = {n: sum(r.score for r in interpolated_lm.score(docs, order=n).filter("held_out").collect()) for n in (1, 2, 3)}
    assert score[1] < score[2] <= score[3] + 1e-6


# -- 8 ---------------------------------------------------------------------

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def expected_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(spark, sf, documents):
    for r in QUERIES["op8_information_sanitiser"](spark, sf).collect():
        spans = expected_spans(documents[r.doc_id])
        written = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in spans) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))


@pytest.fixture(scope="module")
def tricky():
    return ["a@b.c_d@e.f. x.y+z@q-1.w.e.r@t.u", "a@b.c.@d.e f@g", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3 99999999999999999999.1.1.1",
            "4111 1111 1111 1111 and 4111-1111-1111-1111-1 5 - 5 1 -2 3", "+1 (555) 123-4567 +12 +1((((( +44.20.7946.0958 ++49 30 901820",
            "é😀 a@b.co 日本 +49 30 901820 x", "1" * 3000 + " " + "a." * 3000 + "@x", None, "", "x" * 20000 + "@"]


def test_spans_of_tricky_texts(spark, tricky):
    docs = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string")
    for r in sanitise.base_spans(docs).collect():
        assert [tuple(s) for s in r.base] == expected_spans(tricky[r.doc_id])


def test_revealing_terms(spark):
    """A term that only occurs beside a protected entity is removed, also
    where the entity isn't; one that mostly does is generalised."""
    texts = [f"mail Bob.Q@site.org about {extra} zanzibar plan{i}" for i, extra in enumerate(["harvest"] * 5)]
    texts += [f"common words about plan{i} harvest" for i in range(100, 102)]
    texts += [f"common words about nothing{i}" for i in range(200, 260)]
    texts += [texts[0]] * 3 + ["the Zanzibar again"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: sanitise.NAMES for r in docs.collect()}
    spans = {r.doc_id: [(sanitise.NAMES[s.kind], texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in sanitise.sanitise(docs).collect()}
    assert len(spans) == len(found) == len(texts)
    assert ("remove", "zanzibar") in spans[0] or ("generalise", "zanzibar") in spans[0]
    assert ("generalise", "harvest") in spans[0]
    assert any(t == "Zanzibar" for _, t in spans[len(texts) - 1])
    assert all(t not in ("about", "common", "words") for s in spans.values() for _, t in s)
    assert ("email", "Bob.Q@site.org") in spans[0] and not any(t in ("Bob", "site", "org") for _, t in spans[0])
    clean = {r.doc_id: r.text for r in sanitise.sanitised_texts(docs).collect()}
    assert "<EMAIL>" in clean[0] and "zanzibar" not in clean[0] and "harvest" not in clean[0] and clean[30] == texts[30]


def test_personal_data_of_odd_rows(spark, odd, odd_rows, nothing):
    found = sanitise.sanitise(odd).collect()
    assert Counter((r.doc_id, len(r.base)) for r in found) == Counter((d, len(expected_spans(t))) for d, t in odd_rows)
    assert sanitise.sanitise(nothing).count() == sanitise.sanitised_texts(nothing).count() == 0


# -- 9 ---------------------------------------------------------------------


def test_language_identification(spark, sf):
    found = QUERIES["op9_compression_langid"](spark, sf).join(io.documents(spark, sf).select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == 200 and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.93 * len(held)
    assert sum(r.accepted for r in found) >= 0.95 * len(found)


def test_language_of_odd_rows(spark, sf, odd, odd_rows, nothing):
    contents = langid.fit(langid.training_rows(io.documents(spark, sf)))
    found = langid.predict(odd, contents)
    assert Counter(r.doc_id for r in found.collect()) == Counter(d for d, _ in odd_rows)
    by_text = {r.doc.text: r for r in found.collect()}
    for text in (None, "", "   \n\t ", "12 34 !!"):
        assert by_text[text].lang_pred == "und" and by_text[text].score == 0 and not by_text[text].accepted
    assert langid.fit(nothing) == {} and langid.predict(nothing, contents).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}
    assert langid.accepted_documents(odd).columns == odd.columns


# -- 10 --------------------------------------------------------------------


def expected_components(rows, n_gram=3, percent=90):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(zip(*[w[i:] for i in range(n_gram)], strict=False)) if len(w) >= n_gram else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        shared = Counter(j for g in s for j in holders[g] if j < i and rows[j][0] is not None)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n) and find(i) != find(j):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i)) if d is not None else None) for i, (d, _) in enumerate(rows))


COLUMNS10 = ("doc_id", "n_shingles", "component_id")


def test_set_join(spark, sf, documents):
    assert Counter(rows_of(QUERIES["op10_prefix_tree_join"](spark, sf), *COLUMNS10)) == expected_components(list(documents.items()))


def test_set_join_of_odd_rows(spark, odd, odd_rows, nothing):
    assert Counter(rows_of(set_join.join_components(odd), *COLUMNS10)) == expected_components(odd_rows)
    assert set_join.join_components(nothing).count() == 0


def test_set_join_of_chains(spark, monkeypatch):
    """Sets that drift apart step by step, in groups larger than one tree."""
    monkeypatch.setattr(set_join, "TREE_SETS", 4)
    rows = []
    for family in range(4):
        w = [f"f{family}w{i}" for i in range(60)]
        for step in range(14):
            rows.append((100 * family + step, " ".join(w)))
            w = [*w[: 4 * step % 60], f"f{family}s{step}", *w[4 * step % 60 + 1 :]]
    rows += [(900 + i, f"short text {i % 3}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n_gram, percent in ((3, 90), (5, 80), (1, 95)):
        found = Counter(rows_of(set_join.join_components(docs, n_gram, percent), *COLUMNS10))
        assert found == expected_components(rows, n_gram, percent)


@pytest.mark.parametrize("share", [graph.TASK_EDGES, 7])
def test_graph_components(spark, monkeypatch, share):
    monkeypatch.setattr(graph, "TASK_EDGES", share)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 102), (-5, 200), (200, 201), (-5, 201)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, -5: -5, 200: -5, 201: -5}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0
