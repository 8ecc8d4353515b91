"""Prefix trie of rebuilt conversations from padded matrices of turn ids.

Conversation ``c`` is rebuilt as the first ``crc32(c) % 9`` turns of
conversation ``c - c % 5`` and its own turns after as many. A turn is known by
a 128-bit digest of role and text, so texts never leave their scan. Rebuilt
conversations are sorted by their digests and cut into shards of bounded
cells. In a shard (``shard_nodes``) digests become small ids in a matrix padded
with -1; its rows are sorted, the changes between neighbouring rows, joined by
OR from left to right, mark where nodes start, and sums over the rows between
give every depth's columns at once. Only nodes on the path of a shard's first
or last row can have members in other shards: those are sent as parts and
joined (``boundary_nodes``); so a conversation that a third of all others
copies lies in as many shards as it fills.

The matrix is ``DEPTH`` turns wide. Conversations that reach further are never
collected: their turns are numbered by running sums over ranges and what lies
below ``DEPTH`` is grouped by prefix (``deep_nodes``); of each such
conversation the matrix gets the sums of what it adds below.

Null roles and texts are empty. Turns are ordered by ``turn``, null first, and
then by digest. Rows without ``conv_id`` belong to no conversation. ``c % 5``
is never negative. A table without conversations has no nodes, not even a
root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordfold.llm import io
from wordfold.llm.blocks import packed_sorted, unpacked_sorted
from wordfold.operators.grouped import running_sums_before

#: Turns that a matrix is wide; first turns that a rebuilt conversation may take.
DEPTH, SHARED = 64, 8
#: Cells of a shard's matrix.
CELLS = 1 << 20
#: Conversation ids in a part of a node's ends.
ENDS = 1 << 12
#: Hexadecimal digits of a digest.
WIDE = 32
NOTHING = hashlib.sha256(b"").hexdigest()

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [c.split()[0] for c in NODES.split(", ")]
PARTS = "piece long, id string, parent string, " + NODES + ", bytes long, path array<string>, first long, ids binary"
ROWS = ["conv_id", "key", "sizes", "length", "leaves", "saved", "kids"]


def parts_schema() -> pa.Schema:
    head, tail = io.arrow_schema(PARTS.split(", path")[0]), io.arrow_schema("first long, ids binary")
    return pa.schema([*head, ("path", pa.list_(pa.string())), *tail])


# -- rebuilding --------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, size`` of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))


def shared_turns(conv: Column) -> Column:
    return (F.crc32(conv.cast("string")) % 9).cast("int")


def base_of(conv: Column) -> Column:
    return conv - F.pmod(conv, F.lit(5))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(``conv_id, turns`` of conversations that can't reach ``DEPTH``;
    ``conv_id, depth, digest, size`` of the turns of the others or None)."""
    all_turns = turns(conversations)
    sizes = all_turns.groupBy("conv_id").count()
    long = io.written(sizes.filter(F.col("count") > DEPTH - SHARED - 1).select("conv_id"), "long-conversations")
    some = long.limit(1).count() > 0
    entry = F.struct("turn", "digest", "size")
    short = all_turns.join(long, "conv_id", "left_anti") if some else all_turns
    own = short.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("turns"))
    own = io.written(own.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns")), "conversations")
    first = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED).alias("lead"))
    numbered = None
    if some:
        rows = all_turns.join(long, "conv_id", "left_semi").withColumn("one", F.lit(1))
        order = [F.col("turn").asc_nulls_first(), F.col("digest")]
        # equal turns of one number are interchangeable, but the order must be total
        rows = io.written(rows.withColumn("row", F.monotonically_increasing_id()), "long-turns")
        numbered = running_sums_before(rows, ["conv_id"], [*order, F.col("row")], ["one"]).select("conv_id", F.col("one_before").alias("at"), "digest", "size")
        numbered = io.written(numbered, "numbered-turns")
        heads = numbered.filter(F.col("at") < SHARED).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "digest", "size"))).alias("lead"))
        heads = heads.select(F.col("conv_id").alias("base"), F.transform("lead", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("lead"))
        first = first.unionByName(heads)
    h = shared_turns(F.col("conv_id"))
    lead = F.slice(F.coalesce("lead", F.array().cast("array<struct<digest:string,size:bigint>>")), F.lit(1), h)
    joined = own.withColumn("base", base_of(F.col("conv_id"))).join(first, "base", "left")
    whole = joined.select("conv_id", F.concat(lead, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))
    if numbered is None:
        return whole, None
    leads = long.withColumn("base", base_of(F.col("conv_id"))).join(first, "base", "left").select("conv_id", lead.alias("lead"))
    leads = io.written(leads, "long-leads")
    taken = leads.select("conv_id", F.posexplode("lead").alias("at", "t")).select("conv_id", (F.col("at") + 1).cast("long").alias("depth"), "t.digest", "t.size")
    kept = numbered.filter(F.col("at") >= h).join(leads.select("conv_id", F.size("lead").alias("n")), "conv_id")
    kept = kept.select("conv_id", (F.col("at") - h + F.col("n") + 1).cast("long").alias("depth"), "digest", "size")
    turnless = leads.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("size"))
    return whole, io.written(taken.unionByName(kept).unionByName(turnless), "long-rebuilt")


# -- below DEPTH -------------------------------------------------------------


def deep_nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``ROWS`` for the conversations whose turns by ``depth`` these
    are, nodes below ``DEPTH``).

    A prefix is known by the sums of four 32-bit digests of its turns and
    their depths. A node belongs to its smallest member, and a conversation
    owns its path from some depth on, down to its end. A subtree's saved bytes
    are those of its members' turns in nodes they don't own, its leaves the
    members that own a last node without children: both are sums over members
    of something known per conversation."""
    lanes = [f"p{n}" for n in range(4)]
    mixed = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), "digest"))
    real = F.col("depth") > 0
    rows = rows.withColumns({p: F.when(real, F.conv(F.substring(mixed, 8 * n + 1, 8), 16, 10).cast("long")).otherwise(0) for n, p in enumerate(lanes)})
    rows = running_sums_before(rows, ["conv_id"], [F.col("depth")], [*lanes, "size"])
    before = [f"{p}_before" for p in lanes]
    rows = rows.withColumns({p: F.col(p) + F.col(f"{p}_before") for p in lanes})
    lengths = rows.groupBy("conv_id").agg(F.max("depth").alias("length"))
    rows = io.written(rows.join(lengths, "conv_id"), "deep-turns")
    below = rows.filter(F.col("depth") > DEPTH)
    key = ["depth", *lanes]
    owners = io.written(rows.filter(F.col("depth") >= DEPTH).groupBy(*key).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("length").alias("reach")), "deep-prefixes")
    below = below.join(owners, key)
    mine = F.col("owner") == F.col("conv_id")
    ends_leaf = (F.col("depth") == F.col("length")) & mine & (F.col("reach") == F.col("depth"))
    per_conv = below.groupBy("conv_id").agg(
        F.min(F.when(mine, F.col("depth"))).alias("owns"), F.max(F.when(~mine, F.col("size_before") + F.col("size"))).alias("upto"), F.max(ends_leaf.cast("long")).alias("leaf"))
    per_conv = io.written(per_conv, "deep-conversations")

    def added(frame: DataFrame) -> DataFrame:
        """``leaves``, ``saved`` (from this turn on) and ``kids`` of the rows."""
        owns = F.col("owns")
        saved = F.greatest(F.coalesce("upto", F.lit(0)) - F.col("size_before"), F.lit(0))
        kid = (F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= owns)
        return frame.join(per_conv, "conv_id", "left").withColumns({"leaves": F.coalesce("leaf", F.lit(0)), "saved": saved, "kids": F.coalesce(kid, F.lit(False)).cast("long")})

    sums = added(below).groupBy(*key).agg(F.first("owner").alias("conv_id"), F.first("n_convs").alias("n_convs"), F.sum("kids").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = owners.select((F.col("depth") + 1).alias("depth"), *[F.col(p).alias(b) for p, b in zip(lanes, before, strict=True)], F.col("owner").alias("parent_conv_id"))
    parents = below.filter(mine).select(*key, *before).join(above, ["depth", *before]).select(*key, "parent_conv_id")
    name = F.concat_ws(":", *key)
    ends = below.filter(F.col("depth") == F.col("length")).select(name.alias("id"), F.col("conv_id").alias("first"))
    digests = ends_digests(ends.withColumn("ids", F.lit(None).cast("binary")))
    nodes = sums.join(parents, key).withColumn("id", name).join(digests, "id", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    at = added(rows.filter(F.col("depth") == DEPTH))
    # what lies below starts after the turn of this depth
    rest = at.select("conv_id", F.least("leaves", F.lit(1)).alias("leaves"), F.when(F.col("length") > DEPTH, F.greatest(F.coalesce("upto", F.lit(0)) - F.col("size_before") - F.col("size"), F.lit(0))).otherwise(0).alias("saved"), "kids")
    head = rows.filter(F.col("depth") <= DEPTH).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("depth") > 0, F.struct("depth", "digest", "size")))).alias("turns"), F.first("length").alias("length"))
    head = head.join(rest, "conv_id", "left").fillna(0, ["leaves", "saved", "kids"])
    return matrix_rows(head), nodes.select(*COLUMNS)


def matrix_rows(conversations: DataFrame) -> DataFrame:
    """Rows of ``ROWS`` from ``conv_id, turns``."""
    given = conversations.columns
    extra = [F.col(c) if c in given else F.lit(0).cast("long").alias(c) for c in ("leaves", "saved", "kids")]
    length = F.col("length") if "length" in given else F.size("turns").cast("long").alias("length")
    return conversations.select("conv_id", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"), length, *extra)


# -- shards ------------------------------------------------------------------


def joined_ids(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def prefix_id(key: bytes, depth: int) -> str:
    return f"{depth}:{hashlib.md5(key[: depth * WIDE]).hexdigest()}"


def shard_nodes(batch: pa.RecordBatch, number: int, depth: int = DEPTH, part: int = ENDS) -> Iterator[pa.RecordBatch]:
    """Rows of ``PARTS`` of a shard. Nodes inside it have their columns; where
    their parent may lie in other shards too, ``parent`` names it. Nodes that
    may have members elsewhere have an ``id`` and the ids above them in
    ``path``; their sums leave out such nodes. Their ends are rows with
    ``ids``."""
    n = batch.num_rows
    keys = batch.column(1).cast(pa.large_binary()).to_pylist()
    size_lists = batch.column(2)
    size_at, sizes = size_lists.offsets.to_numpy()[:-1] - size_lists.offsets[0].as_py(), size_lists.flatten().to_numpy()
    conv, length, more_leaves, more_saved, kids = (batch.column(k).to_numpy() for k in (0, 3, 4, 5, 6))
    lens = np.fromiter((len(k) // WIDE for k in keys), np.int64, n)
    width = int(lens.max())
    ids = np.unique(np.frombuffer(b"".join(keys), f"S{WIDE}"), return_inverse=True)[1]
    matrix = np.full((n, width), -1)
    matrix[np.arange(width) < lens[:, None]] = ids
    order = np.lexsort((conv, length > lens, *matrix.T[::-1]))  # of equal rows those that end first
    matrix, conv, lens, length, size_at = matrix[order], conv[order], lens[order], length[order], size_at[order]
    starts_node = np.ones((n, width + 1), bool)
    starts_node[1:, 0] = False
    starts_node[1:, 1:] = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
    leaf, saved = more_leaves[order].astype(np.int64), more_saved[order].astype(np.int64)
    kid = np.where(lens == depth, kids[order], 0).astype(np.int64)
    first, last = keys[order[0]], keys[order[-1]]
    schema = parts_schema()
    columns: dict[str, list] = {f.name: [] for f in schema}

    def emit(count: int, **values) -> None:
        for f in schema:
            columns[f.name].append(pa.array(values[f.name], f.type) if f.name in values else pa.nulls(count, f.type))

    inner_next = np.zeros(n, np.int64)
    for d in range(width, -1, -1):
        cuts = np.flatnonzero(starts_node[:, d])
        real = lens[cuts] >= d
        begin, end = cuts[real], np.r_[cuts[1:], n][real]
        shared = (begin == 0) | (end == n)
        own_kid = kid if d == depth else 0
        children, ended = (np.add.reduceat(x, cuts)[real] for x in (inner_next + own_kid, (length == d).astype(np.int64)))
        members = end - begin
        size = sizes[size_at[begin] + d - 1] if d else np.zeros(len(begin), np.int64)
        inside = ~shared
        leaf[begin[inside & (children == 0)]] += 1
        saved[begin[inside]] += ((members - 1) * size)[inside]
        leaves, sums = (np.add.reduceat(x, cuts)[real] for x in (leaf, saved))
        least = np.minimum.reduceat(conv, cuts)[real]
        digests = [hashlib.sha256(joined_ids(conv[b : b + e])).hexdigest() if e else NOTHING for b, e in zip(begin[inside].tolist(), ended[inside].tolist(), strict=True)]
        parent_conv, parent_id = np.zeros(len(begin), np.int64), [None] * len(begin)
        if d:
            above = np.flatnonzero(starts_node[:, d - 1])
            at = np.searchsorted(above, begin, "right") - 1
            parent_conv = np.minimum.reduceat(conv, above)[at]
            for side, key in ((at == 0, first), (at == len(above) - 1, last)):
                for k in np.flatnonzero(side & inside).tolist():
                    parent_id[k] = prefix_id(key, d - 1)
        who = np.flatnonzero(inside)
        emit(
            len(who), piece=np.full(len(who), number), parent=[parent_id[k] for k in who.tolist()], conv_id=least[who], depth=np.full(len(who), d),
            parent_conv_id=parent_conv[who], n_convs=members[who], n_children=children[who], n_leaves=leaves[who], saved_tokens=sums[who], ends_sha256=digests)
        for k in np.flatnonzero(shared).tolist():
            key = first if begin[k] == 0 else last
            path = [prefix_id(key, e) for e in range(d + 1)]
            emit(
                1, piece=[number], id=path[-1:], parent=path[-2:-1] or [None], conv_id=[least[k]], depth=[d], n_convs=[members[k]], n_children=[children[k]],
                n_leaves=[leaves[k]], saved_tokens=[sums[k]], bytes=[size[k]], path=[path])
            for lo in range(int(begin[k]), int(begin[k] + ended[k]), part):
                some = conv[lo : min(lo + part, int(begin[k] + ended[k]))]
                emit(1, id=path[-1:], first=some[:1], ids=[packed_sorted(some)])
        inner_next = np.zeros(n, np.int64)
        inner_next[begin[inside]] = 1
    yield pa.record_batch([pa.concat_arrays(columns[f.name]) for f in schema], schema=schema)


def shards(rows: DataFrame) -> DataFrame:
    """``PARTS`` of all shards, written once."""
    rows = io.written(rows.select(*ROWS), "trie-rows")
    # conv_id splits the copies of a conversation
    depth, part = DEPTH, ENDS
    ordered = rows.repartitionByRange(io.shuffle_partitions(rows.sparkSession), "key", "conv_id").sortWithinPartitions("key", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, held, width = io.task_id() << 32, [], 0, 0
        for batch in batches:
            lo = 0
            lens = np.diff(batch.column(2).offsets.to_numpy())
            for at in range(batch.num_rows):
                wider = max(width, int(lens[at]) + 1)
                if held and (held + 1) * wider > CELLS:
                    waiting.append(batch.slice(lo, at - lo))
                    yield from shard_nodes(pa.concat_batches([w for w in waiting if w.num_rows]), number, depth, part)
                    number, waiting, held, lo, wider = number + 1, [], 0, at, int(lens[at]) + 1
                held, width = held + 1, wider
            waiting.append(batch.slice(lo))
        if held:
            yield from shard_nodes(pa.concat_batches([w for w in waiting if w.num_rows]), number, depth, part)

    return io.written(ordered.mapInArrow(run, PARTS), "trie-parts")


def ends_digests(parts: DataFrame) -> DataFrame:
    """``id, ends_sha256`` of rows ``id, first, ids`` (``ids`` null: ``first``
    alone), whose ids ascend with ``first``. SHA-256 is serial, so a node's
    ids pass one task; only its state is held."""
    schema = io.arrow_schema("id string, ends_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for name, first, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != node:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(str(first).encode() if blob is None else joined_ids(unpacked_sorted(blob, np.int64)))
            yield pa.record_batch([[r[k] for r in out] for k in (0, 1)], schema=schema)
            out = []
        if state:
            yield pa.record_batch([[node], [state.hexdigest()]], schema=schema)

    return parts.select("id", "first", "ids").repartition("id").sortWithinPartitions("id", "first").mapInArrow(run, "id string, ends_sha256 string")


def boundary_nodes(parts: DataFrame) -> DataFrame:
    """The nodes that several shards may hold, with ``id``."""
    own = parts.filter("id is not null and ids is null").groupBy("id").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("bytes").alias("bytes"), F.first("path").alias("path"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    own = io.written(own, "trie-boundary")
    kids = own.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    own = own.join(kids, "id", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    own = io.written(own, "trie-boundary")
    each = own.select(F.explode("path").alias("id"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("value"))
    added = each.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.sum("value").alias("value"))
    above = own.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    digests = ends_digests(parts.filter("ids is not null"))
    own = own.join(added, "id").join(above, "parent", "left").join(digests, "id", "left")
    own = own.withColumns({"n_leaves": F.col("n_leaves") + F.col("leaf"), "saved_tokens": F.col("saved_tokens") + F.col("value"), "ends_sha256": F.coalesce("ends_sha256", F.lit(NOTHING))})
    return io.written(own.select("id", *COLUMNS), "trie-boundary")


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """Rows of ``NODES`` for every node of the rebuilt conversations' trie."""
    whole, long = rebuilt(conversations)
    rows, deep = matrix_rows(whole), None
    if long is not None:
        heads, deep = deep_nodes(long)
        rows = rows.unionByName(heads)
    parts = shards(rows)
    edge = boundary_nodes(parts)
    # a parent's conversation comes by shard, so no parent's children meet in one task
    named = parts.filter("id is not null and ids is null").select("piece", F.col("id").alias("parent")).distinct()
    named = named.join(edge.select(F.col("id").alias("parent"), F.col("conv_id").alias("known")), "parent")
    inside = parts.filter("id is null").join(named, ["piece", "parent"], "left").withColumn("parent_conv_id", F.coalesce("known", "parent_conv_id"))
    found = inside.select(*COLUMNS).unionByName(edge.select(*COLUMNS))
    return found if deep is None else found.unionByName(deep)


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: crc32 by its polynomial, bit by bit over the decimal digits.
OP11_SQL = """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - ((c % 5) + 5) % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
             lambda s, b: list_reduce(list_prepend(xor(s, b), generate_series(1, 8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT convs.c, 0 AS own, turns.n, role, text FROM convs JOIN turns ON turns.c = base AND turns.n <= h
  UNION ALL SELECT convs.c, 1, turns.n, role, text FROM convs JOIN turns ON turns.c = convs.c AND turns.n > h),
numbered AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY own, n) AS d FROM rebuilt),
steps AS (
  SELECT c, d, text, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY c ORDER BY d)) AS id FROM numbered
  UNION ALL SELECT c, 0, '', '' FROM convs),
placed AS (
  SELECT *, lag(id) OVER (PARTITION BY c ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY c) AS ends FROM steps),
nodes AS (
  SELECT id, d, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * octet_length(encode(any_value(text))) AS value,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM placed GROUP BY id, d),
kids AS (SELECT parent AS id, count(*) AS k FROM nodes WHERE d > 0 GROUP BY parent),
own AS (
  SELECT nodes.*, coalesce(k, 0) AS n_children FROM nodes LEFT JOIN kids USING (id)),
paths AS (
  SELECT a.id, b.id AS below FROM placed a JOIN placed b ON a.c = b.c AND b.d >= a.d JOIN own ON own.id = b.id AND own.conv_id = b.c),
below AS (
  SELECT paths.id, sum((n_children = 0)::INT) AS n_leaves, sum(value) AS saved FROM paths JOIN own ON own.id = below GROUP BY paths.id)
SELECT own.conv_id, own.d AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, own.ends_sha256
FROM own JOIN below ON below.id = own.id LEFT JOIN own up ON up.id = own.parent AND own.d > 0
"""
