"""Cells and factor columns of rank-one descent (T4, T5), in two layouts.

``Held``: while all factors of both sides are under a bound of bytes they are
broadcast, as the row solves of :mod:`wordfold.operators.solve` have it. The
cells are written once by row and once by column (ids with many cells over
several parts), and workers keep the parts they read, so half a sweep is one
narrow job: each task sums its ids' cells against the fixed column and only a
number per id leaves it. Few cells are a single part, where a rank's sweeps are
one job.

``Residuals``: beyond that bound the residual is two tables, one in buckets of
the row and one in buckets of the column, and so are the factor columns. A
sweep joins bucket by bucket and shuffles partial sums only, a row per id and
task; cells move once a rank, when the residual changes.

Both take the same steps; they differ by rounding alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark import Broadcast
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wordfold.operators.coo import dense_ids, transpose
from wordfold.operators.factor import predictions, rank_one_update
from wordfold.operators.lookup import _place
from wordfold.session import checkpoint_dir, cut_lineage, discard

#: Bytes of both sides' factors that are broadcast.
FACTOR_BYTES = 256 << 20
#: Cells of an id that one task sums.
CELLS_PER_ID = 1 << 20

#: Cells of a part, while there are fewer parts than cores or shuffle partitions.
PART_CELLS = 1 << 21
#: Bytes of parts that a worker keeps.
HELD_BYTES = 192 << 20

_kept: dict = {}


def _cells(path: str, part: int) -> list:
    """A part's arrays ``i, j, v, w`` (``w`` None if all are 1), then the rank
    opening whose differences are kept last, and these. A worker keeps the
    parts it met last; what it lacks it reads and works out anew."""
    if (path, part) in _kept:
        _kept[path, part] = _kept.pop((path, part))
        return _kept[path, part]
    files, place = _place(f"{path}/part={part}")
    if files.get_file_info(place).type == fs.FileType.NotFound:
        i, j, v, w = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), np.zeros(0)
    else:
        table = dataset.dataset(place, filesystem=files, format="parquet").to_table(["i", "j", "v", "w"])
        i, j, v, w = (table[c].to_numpy() for c in ("i", "j", "v", "w"))
    size = len(i) * 40
    while _kept and sum(x[6] for x in _kept.values()) + size > HELD_BYTES:
        del _kept[next(iter(_kept))]
    _kept[path, part] = [i, j, v, None if (w == 1.0).all() else w, None, None, size]
    return _kept[path, part]


def _left(path: str, part: int, opened: int, rest) -> tuple:
    """A part's ``i, j, w`` and its values less the other ranks' products."""
    held = _cells(path, part)
    i, j, v, w = held[:4]
    if held[4] != opened:
        wi, hj = rest.value
        left = np.empty(len(v))
        for lo in range(0, len(v), 1 << 16):
            some = slice(lo, lo + (1 << 16))
            left[some] = v[some] - np.einsum("nk,nk->n", wi[i[some]], hj[j[some]])
        held[4:6] = opened, left
    return i, j, w, held[5]


def _sums(at: np.ndarray, of: np.ndarray, w: np.ndarray | None, left: np.ndarray, u: np.ndarray, lam: float, n: int) -> tuple:
    """(slope, curve, cells) of every id against the fixed column ``u``."""
    x = u[of]
    wx = x if w is None else w * x
    many = np.bincount(at, minlength=n)
    return np.bincount(at, wx * left, n), np.bincount(at, wx * x, n) + lam * many, many


def _best(slope: np.ndarray, curve: np.ndarray, old: np.ndarray, nmf: bool) -> tuple[np.ndarray, float]:
    """The best column for these sums; the decrease."""
    new = np.divide(slope, curve, out=np.zeros(len(slope)), where=curve > 0)
    new = np.maximum(new, 0.0) if nmf else new
    return new, float(np.sum(curve * (old * old - new * new) - 2 * slope * (old - new)))


class Held:
    """Factors as arrays, cells ``i, j, v`` (``w``) written in parts by either
    side; few cells are one part."""

    def __init__(self, cells: DataFrame, w: DataFrame, h: DataFrame):
        self.spark = cells.sparkSession
        self.ids = {c: cut_lineage(dense_ids(cells.select(c).distinct(), [c], "n"), f"ids-{c}") for c in "ij"}
        weight = F.col("w") if "w" in cells.columns else F.lit(1.0)
        numbered = cells.join(self.ids["i"].withColumnRenamed("n", "ni"), "i").join(self.ids["j"].withColumnRenamed("n", "nj"), "j")
        numbered = cut_lineage(numbered.select(F.col("ni").cast("int").alias("i"), F.col("nj").cast("int").alias("j"), F.col("v").cast("double").alias("v"), weight.cast("double").alias("w")), "numbered-cells")
        sc = self.spark.sparkContext
        self.parts = min(max(sc.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), max(1, -(-numbered.count() // PART_CELLS)))
        self.by = {"i": self._layout(numbered, "i")}
        self.by["j"] = self.by["i"] if self.parts == 1 else self._layout(numbered, "j")
        self.tasks = sc.parallelize(range(self.parts), self.parts)
        self.x = {"i": self._array(w, "i"), "j": self._array(h, "j")}
        self.rest: Broadcast | None = None
        self.opened, self.ahead = 0, 1
        self.taken: list[tuple] = []
        self.written = [numbered, *self.ids.values(), *self.by.values()]

    def _layout(self, cells: DataFrame, c: str) -> DataFrame:
        """By id; ids with many cells are spread over several parts."""
        many = cells.groupBy(c).agg(F.floor(F.count("*") / CELLS_PER_ID).alias("salts")).where(F.col("salts") > 0)
        salt = F.when(F.col("salts") > 0, F.pmod(F.xxhash64("i", "j"), F.col("salts") + 1)).otherwise(0)
        dealt = cells.join(many, c, "left").select("i", "j", "v", "w", F.pmod(F.xxhash64(F.col(c), salt), F.lit(self.parts)).alias("part"))
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/cells-by-{c}-{uuid.uuid4().hex}"
        dealt.repartition(self.parts, "part").write.partitionBy("part").parquet(path)
        dealt.written_at = path
        return dealt

    def _array(self, factors: DataFrame, c: str) -> np.ndarray:
        rows = factors.join(self.ids[c].withColumnRenamed(c, "id"), "id").select("n", "vec").toArrow()
        out = np.zeros((len(rows), len(rows["vec"][0]) if len(rows) else 0))
        if len(rows):
            out[rows["n"].to_numpy()] = rows["vec"].combine_chunks().flatten().to_numpy().reshape(out.shape)
        return out

    def _share(self, value):
        return self.spark.sparkContext.broadcast(value)

    def _run(self, step: Callable[[int], tuple]) -> list[tuple]:
        """What ``step`` gives for each part."""
        return self.tasks.mapPartitions(lambda parts: [step(p) for p in parts]).collect()

    def open(self, t: int, ahead: int = 1) -> None:
        """All ranks but ``t`` go to the tasks, for the sweeps to come, which
        are ``ahead`` at most."""
        others = [s for s in range(self.x["i"].shape[1]) if s != t]
        self.rank, self.rest = t, self._share(tuple(np.ascontiguousarray(self.x[c][:, others]) for c in "ij"))
        self.opened, self.ahead, self.taken = self.opened + 1, ahead, []

    def close(self) -> None:
        if self.rest is not None:
            self.rest.destroy()
            self.rest = None

    def _half(self, target: str, lam: float, nmf: bool) -> float:
        """The best column of ``target`` for the other one; the decrease."""
        t, rest, opened, path, n = self.rank, self.rest, self.opened, self.by[target].written_at, len(self.x[target])
        u = np.ascontiguousarray(self.x["j" if target == "i" else "i"][:, t])

        def step(part: int) -> tuple:
            i, j, w, left = _left(path, part, opened, rest)
            slope, curve, many = _sums(*((i, j) if target == "i" else (j, i)), w, left, u, lam, n)
            ids = np.flatnonzero(many)
            return ids, slope[ids], curve[ids]

        slope, curve = np.zeros(n), np.zeros(n)
        for ids, a, b in self._run(step):
            slope[ids] += a
            curve[ids] += b
        self.x[target][:, t], gain = _best(slope, curve, self.x[target][:, t].copy(), nmf)
        return gain

    def sweep(self, lam: float, nmf: bool) -> float:
        """The best column factors of the open rank, then the best row factors.
        The job over a single part takes the sweeps ``ahead`` as well, of which
        the next calls give one each; what isn't asked for is dropped."""
        if self.parts > 1:
            return self._half("j", lam, nmf) + self._half("i", lam, nmf)
        if not self.taken or self.taken[0][:2] != (lam, nmf):
            self.taken = self._sweeps(lam, nmf)
            self.ahead -= len(self.taken)
        *_, self.x["i"][:, self.rank], self.x["j"][:, self.rank], gain = self.taken.pop(0)
        return gain

    def _sweeps(self, lam: float, nmf: bool) -> list[tuple]:
        t, rest, opened, path, n = self.rank, self.rest, self.opened, self.by["i"].written_at, max(1, self.ahead)
        x, y = (np.ascontiguousarray(self.x[c][:, t]) for c in "ij")

        def step(part: int) -> list[tuple]:
            i, j, w, left = _left(path, part, opened, rest)
            u, v, found = x, y, []
            for _ in range(n):
                v, one = _best(*_sums(j, i, w, left, u, lam, len(v))[:2], v, nmf)
                u, two = _best(*_sums(i, j, w, left, v, lam, len(u))[:2], u, nmf)
                found.append((lam, nmf, u, v, one + two))
            return found

        return self._run(step)[0]

    def loss(self) -> float:
        """Weighted squared error of the cells."""
        shared, path = self._share((self.x["i"], self.x["j"])), self.by["i"].written_at

        def error(part: int) -> tuple:
            wi, hj = shared.value
            i, j, v, w = _cells(path, part)[:4]
            total = 0.0
            for lo in range(0, len(v), 1 << 16):
                some = slice(lo, lo + (1 << 16))
                off = (v[some] - np.einsum("nk,nk->n", wi[i[some]], hj[j[some]])) ** 2
                total += float(np.sum(off if w is None else w[some] * off))
            return (total,)

        found = sum(x for x, in self._run(error))
        shared.destroy()
        return found

    def factors(self) -> tuple[DataFrame, DataFrame]:
        """``id, vec`` of both sides, written."""
        out = []
        for c in "ij":
            shared = self._share(self.x[c])
            schema = pa.schema([("id", pa.int64()), ("vec", pa.list_(pa.float64()))])

            def rows(batches: Iterator[pa.RecordBatch], shared=shared, schema=schema) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    found = shared.value[batch.column(1).to_numpy()]
                    flat = pa.array(np.ascontiguousarray(found).ravel())
                    stops = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                    yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(stops, flat)], schema=schema)

            named = self.ids[c].select(F.col(c).cast("long").alias("id"), F.col("n").cast("long").alias("n"))
            out.append(cut_lineage(named.mapInArrow(rows, "id long, vec array<double>"), "factors"))
            shared.destroy()
        return tuple(out)

    def drop(self) -> None:
        discard(*self.written)


class Residuals:
    """The cells ``i, j, v`` (``w``) less all ranks' products but the open one's."""

    def __init__(self, cells: DataFrame, w: DataFrame, h: DataFrame):
        self.spark = cells.sparkSession
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.weight = F.col("w") if "w" in cells.columns else F.lit(1.0)
        self.by: dict[str, DataFrame] = {}
        self.k = len(w.first()["vec"])
        known = predictions(cells, w, h)
        self._keep(known.withColumn("v", F.col("v") - F.col("p")).drop("p"))
        self.x = {c: [self.column(f.select("id", F.element_at("vec", t + 1).alias("x"))) for t in range(self.k)] for c, f in (("i", w), ("j", h))}
        self.taken: int | None = None

    def _bucket_table(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` as a table of the warehouse in buckets of ``key``."""
        name = f"residual_{key}_{uuid.uuid4().hex}"
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/{name}"
        df.repartition(self.buckets, key).write.bucketBy(self.buckets, key).sortBy(key).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out.written_at, out.written_as = path, name
        return out

    def _keep(self, cells: DataFrame) -> None:
        before = list(self.by.values())
        by_row = self._bucket_table(cells, "i")
        self.by = {"i": by_row, "j": self._bucket_table(by_row, "j")}
        discard(*before)

    def column(self, df: DataFrame, gain: Observation | None = None) -> DataFrame:
        """``id, x`` written once; ``gain`` observes the sum of that column on the way."""
        if gain is not None:
            df = df.observe(gain, F.sum("gain").alias("gain"))
        return self._bucket_table(df.select("id", "x"), "id")

    def _shifted(self, t: int, sign: int, cells: DataFrame) -> DataFrame:
        """The cells plus ``sign`` times a rank's products; ids without a
        value count as 0."""
        u, v = (self.x[c][t].select(F.col("id").alias(c), F.col("x").alias(f"_{c}")) for c in "ij")
        none = F.lit(0.0)
        known = cells.join(u, "i", "left").join(v, "j", "left")
        return known.withColumn("v", F.col("v") + sign * F.coalesce("_i", none) * F.coalesce("_j", none)).drop("_i", "_j")

    def open(self, t: int, ahead: int = 1) -> None:
        """Takes the products of the rank before out and gives those of ``t``
        back, in one pass over the cells."""
        cells = self.by["i"] if self.taken is None else self._shifted(self.taken, -1, self.by["i"])
        self._keep(self._shifted(t, 1, cells))
        self.taken = t

    def close(self) -> None:
        """The next rank's ``open`` takes this one's products out."""

    def sweep(self, lam: float, nmf: bool) -> float:
        """The best column factors of the open rank, then the best row factors;
        the decrease of the objective."""
        t, gains = self.taken, (Observation(), Observation())
        u, v = self.x["i"][t], self.x["j"][t]
        self.x["j"][t] = self.column(rank_one_update(self.by["i"], u, v, lam, nmf), gains[0])
        self.x["i"][t] = self.column(rank_one_update(transpose(self.by["j"]), self.x["j"][t], u, lam, nmf), gains[1])
        discard(u, v)
        return sum(g.get["gain"] or 0.0 for g in gains)

    def loss(self) -> float:
        """Weighted squared error of the cells."""
        cells = self.by["i"] if self.taken is None else self._shifted(self.taken, -1, self.by["i"])
        return cells.agg(F.sum(self.weight * F.col("v") * F.col("v"))).first()[0] or 0.0

    def factors(self) -> tuple[DataFrame, DataFrame]:
        """``id, vec`` of both sides, written."""
        out = []
        for c in "ij":
            rows = reduce(DataFrame.unionByName, [x.select("id", F.lit(t).alias("t"), "x") for t, x in enumerate(self.x[c])])
            vec = F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda e: e["x"])
            out.append(cut_lineage(rows.groupBy("id").agg(vec.alias("vec")), "factors"))
        return tuple(out)

    def drop(self) -> None:
        discard(*self.by.values(), *self.x["i"], *self.x["j"])


def rank_one_cells(cells: DataFrame, w: DataFrame, h: DataFrame, k: int) -> Held | Residuals:
    """The layout for factors of this size."""
    return (Held if (w.count() + h.count()) * k * 8 <= FACTOR_BYTES else Residuals)(cells, w, h)
