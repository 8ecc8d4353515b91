"""The trie of rebuilt conversations against plain loops over prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wordfold.llm import turn_trie as t
from wordfold.llm.catalog import QUERIES


def expected(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), digest, role, text))
    original = {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = original.get(c - c % 5, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        value = (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += value
    out = Counter()
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(p))
        out[min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in df.select(*t.COLUMNS).collect())


def table(spark, rows):
    extra = ["key", "id", "path", "turns", "length", "lead", "base", "one"]
    names = ", ".join(f"{c} string" for c in extra)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"conv_id long, turn long, role string, text string, {names}").repartition(3)


def test_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op11_turn_trie"](spark, sf)) == expected(rows)


def random_rows(rng, convs, longest):
    rows = []
    for c in convs:
        say = rng.choice(["a", "b"])
        for k in range(rng.randrange(1, longest)):
            turn = rng.choice([None, k, k, k, k])
            rows.append((c, turn, rng.choice([None, "user", "user", "user"]), rng.choice([say, say, say, "é", "", None])))
    return rows


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
def test_shards_of_any_size(spark, monkeypatch, cells):
    """Nulls, ties, repeated rows, copies and a first turn that most share; a
    shard of one conversation, of a few, of all."""
    monkeypatch.setattr(t, "CELLS", cells)
    monkeypatch.setattr(t, "ENDS", 2)
    rng = random.Random(cells)
    rows = random_rows(rng, [*range(40), -7, -3, 1 << 40, (1 << 40) + 1], 7)
    rows += [(c, k, "user", "the same") for c in range(100, 160) for k in range(3)] + [(None, 1, "user", "x"), (7, 0, "user", "a"), (7, 0, "user", "a"), (200, 0, "user", "only")]
    assert found(t.trie_nodes(table(spark, rows))) == expected(rows)


def test_conversations_deeper_than_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(t, "DEPTH", 12)
    monkeypatch.setattr(t, "CELLS", 60)
    rng = random.Random(9)
    rows = random_rows(rng, range(30), 6)
    path = [(k, "user", f"turn {k}") for k in range(40)]
    for c in range(50, 75):  # copies, some ending early, some leaving the path
        end, leave = rng.choice([11, 12, 13, 20, 40]), rng.choice([5, 14, 30, 99])
        rows += [(c, k, r, x if k < leave else f"{x} of {c % 4}") for k, r, x in path[:end]]
    rows += [(300, None, "user", "t") for _ in range(25)]
    assert found(t.trie_nodes(table(spark, rows))) == expected(rows)


def test_no_conversations(spark):
    assert t.trie_nodes(table(spark, [(None, 0, "user", "x")])).count() == 0
    one = t.trie_nodes(table(spark, [(1, None, None, None)]))
    assert found(one) == expected([(1, None, None, None)])


def test_a_turn_read_as_its_digest(spark):
    rows = spark.createDataFrame([(1, 0, "a", "b:c"), (1, 1, "a1:", "c"), (1, 2, None, "é")], "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.digest, r.size) for r in t.turns(rows).collect()}
    assert len({d for d, _ in got.values()}) == 3 and got[2][1] == 2
    assert spark.range(20).select(t.shared_turns(F.col("id")).alias("h")).collect()[7].h == zlib.crc32(b"7") % 9
