"""Registered queries for matrix sources (A4-A15), COO algebra (D1-D11),
factorization data operators (E1-E16) and prediction / ranking (F1-F13).

Matrices: the customer x part interaction matrix (orders x lineitem) and the
user x bucket event matrix (events); factors: W = even, H = odd embeddings.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wordfold.functions.rand import sql_uniform
from wordfold.operators import coo as D
from wordfold.operators import factor as E
from wordfold.operators import ranking as R
from wordfold.plans import fixtures as fx
from wordfold.plans.catalog_corpus import C_CORPUS, P, _sums, _with, c_pairs
from wordfold.plans.sql_fixtures import event_matrix_cte, factor_ctes, interactions_cte, split_expr
from wordfold.sources import matrix as A

QUERIES = {}
SQL = {}

RHO = 0.01
LAM = 0.1
K = 10
ETA = 0.5


def r6(c):
    return F.round(c, 6)


def exploded(df, key="id"):
    return df.select(key, F.posexplode("vec").alias("t", "x")).select(key, F.col("t").cast("long").alias("t"), r6(F.col("x")).alias("x"))


def sql_exploded(src: str, key: str = "id") -> str:
    return f"SELECT {key}, t, round(x, 6) AS x FROM (SELECT {key}, unnest(generate_series(0, len(vec) - 1)) AS t, unnest(vec) AS x FROM {src})"


def _inter(s, sf):
    return fx.interactions(s, sf)


def _ev(s, sf):
    return fx.event_matrix(s, sf)


def _wh(s, sf):
    return fx.factor_tables(s, sf)


INTER = interactions_cte()
EVM = event_matrix_cte()
FAC = factor_ctes()

# ---------------------------------------------------------------- A sources / sinks
QUERIES["read_coo"] = lambda s, sf: A.parse_coo(A.format_coo(_inter(s, sf)))
SQL["read_coo"] = _with(INTER) + "SELECT i, j, round(v, 6) AS v FROM inter"
QUERIES["write_coo"] = lambda s, sf: A.format_coo(_inter(s, sf))
SQL["write_coo"] = _with(INTER) + "SELECT printf('%d %d %.6f', i + 1, j + 1, v) AS value FROM inter"
QUERIES["read_count_vocab"] = lambda s, sf: A.parse_count_vocab(A.format_count_vocab(
    _sums(s, sf, "word").groupBy("word").agg(F.sum("n").alias("n"))))
SQL["read_count_vocab"] = _with(C_CORPUS, c_pairs(P)) + "SELECT word, sum(n) AS n FROM counts GROUP BY word"
QUERIES["read_vectors_text"] = lambda s, sf: (lambda v: v.select(
    "word", F.posexplode("vec").alias("t", "x")).select("word", F.col("t").cast("long").alias("t"), r6(F.col("x")).alias("x")))(
    __import__("wordfold.sources.text", fromlist=["parse_vectors"]).parse_vectors(
        A.format_vectors(fx.word_vectors(s, sf), "word")))
SQL["read_vectors_text"] = """
WITH wv AS (SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)
SELECT word, t, round(CAST(printf('%.6f', x) AS DOUBLE), 6) AS x
FROM (SELECT word, unnest(generate_series(0, len(vec) - 1)) AS t, unnest(vec) AS x FROM wv)"""
QUERIES["write_vectors"] = lambda s, sf: exploded(A.strip_bias(_wh(s, sf)[0], 1))
SQL["write_vectors"] = _with(FAC) + """,
wb AS (SELECT id, vec[1:len(vec) - 2] AS vec FROM wf)
""" + sql_exploded("wb")
QUERIES["coo_from_triples"] = lambda s, sf: A.coo_from_triples(_ev(s, sf))[0]
SQL["coo_from_triples"] = _with(EVM) + "SELECT i, j, v FROM evm"
QUERIES["coo_dims"] = lambda s, sf: A.coo_from_triples(_ev(s, sf))[1]
SQL["coo_dims"] = _with(EVM) + "SELECT max(i) + 1 AS rows, max(j) + 1 AS cols FROM evm"
QUERIES["coo_from_dense"] = lambda s, sf: A.coo_from_dense(_wh(s, sf)[0]).select("i", "j", r6(F.col("v")).alias("v"))
SQL["coo_from_dense"] = _with(FAC) + """
SELECT id AS i, t AS j, round(x, 6) AS v FROM (SELECT id, unnest(generate_series(0, len(vec) - 1)) AS t, unnest(vec) AS x FROM wf)"""

# ---------------------------------------------------------------- D COO algebra
QUERIES["transpose"] = lambda s, sf: D.transpose(_inter(s, sf))
SQL["transpose"] = _with(INTER) + "SELECT j AS i, i AS j, v FROM inter"
QUERIES["nnz_by_row"] = lambda s, sf: D.nnz_by_row(_inter(s, sf), "i")
SQL["nnz_by_row"] = _with(INTER) + "SELECT i, count(*) AS nnz FROM inter GROUP BY i"
QUERIES["nnz_by_col"] = lambda s, sf: D.nnz_by_row(_inter(s, sf), "j")
SQL["nnz_by_col"] = _with(INTER) + "SELECT j, count(*) AS nnz FROM inter GROUP BY j"
QUERIES["max_nnz"] = lambda s, sf: D.max_nnz(_inter(s, sf), "j")
SQL["max_nnz"] = _with(INTER) + "SELECT max(c) AS max_nnz FROM (SELECT count(*) AS c FROM inter GROUP BY j)"


def _building(s, sf):
    return fx.table(s, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("id"))


QUERIES["row_subset"] = lambda s, sf: D.row_subset(_inter(s, sf), _building(s, sf), "i", remap=True)
SQL["row_subset"] = _with(INTER) + """,
sel AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS ni FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT sel.ni AS i, inter.j, inter.v FROM inter JOIN sel ON inter.i = sel.id"""
QUERIES["col_subset"] = lambda s, sf: D.row_subset(
    _inter(s, sf), fx.table(s, sf, "part").where(F.col("p_size") > 25).select(F.col("p_partkey").alias("id")), "j", remap=False)
SQL["col_subset"] = _with(INTER) + "SELECT i, j, v FROM inter WHERE j IN (SELECT p_partkey FROM part WHERE p_size > 25)"
QUERIES["global_mean"] = lambda s, sf: D.global_mean(_inter(s, sf)).select(r6(F.col("mean")).alias("mean"))
SQL["global_mean"] = _with(INTER) + "SELECT round(avg(v), 6) AS mean FROM inter"
QUERIES["remove_bias"] = lambda s, sf: D.remove_bias(_inter(s, sf), D.global_mean(_inter(s, sf))).select(
    "i", "j", r6(F.col("v")).alias("v"))
SQL["remove_bias"] = _with(INTER) + "SELECT i, j, round(v - (SELECT avg(v) FROM inter), 6) AS v FROM inter"
QUERIES["spmv"] = lambda s, sf: D.spmv(
    _inter(s, sf), fx.table(s, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x")),
    fx.table(s, sf, "customer").select(F.col("c_custkey").alias("id"))).select("i", r6(F.col("y")).alias("y"))
SQL["spmv"] = _with(INTER) + """
SELECT c.c_custkey AS i, round(coalesce(y.y, 0.0), 6) AS y FROM customer c LEFT JOIN (
  SELECT i, sum(v * p_retailprice) AS y FROM inter JOIN part ON p_partkey = j GROUP BY i) y ON y.i = c.c_custkey"""
QUERIES["spmv_t"] = lambda s, sf: D.spmv_t(
    _inter(s, sf), fx.table(s, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x")),
    fx.table(s, sf, "part").select(F.col("p_partkey").alias("id"))).select("j", r6(F.col("y")).alias("y"))
SQL["spmv_t"] = _with(INTER) + """
SELECT p.p_partkey AS j, round(coalesce(y.y, 0.0), 6) AS y FROM part p LEFT JOIN (
  SELECT j, sum(v * c_acctbal) AS y FROM inter JOIN customer ON c_custkey = i GROUP BY j) y ON y.j = p.p_partkey"""
QUERIES["spmm"] = lambda s, sf: exploded(D.spmm(_ev(s, sf), _wh(s, sf)[1]).withColumnRenamed("i", "id"))
SQL["spmm"] = _with(EVM, FAC) + """,
hx AS (SELECT id, unnest(generate_series(0, len(vec) - 1)) AS t, unnest(vec) AS x FROM hf)
SELECT evm.i AS id, hx.t, round(sum(evm.v * hx.x), 6) AS x FROM evm JOIN hx ON hx.id = evm.j GROUP BY evm.i, hx.t"""
QUERIES["gram"] = lambda s, sf: D.gram_table(_wh(s, sf)[0]).select(
    F.col("t1").cast("long").alias("t1"), F.col("t2").cast("long").alias("t2"), r6(F.col("g")).alias("g"))
SQL_WX = """,
wx AS (SELECT id, unnest(generate_series(0, len(vec) - 1)) AS t, unnest(vec) AS x FROM wf),
hx AS (SELECT id, unnest(generate_series(0, len(vec) - 1)) AS t, unnest(vec) AS x FROM hf)"""
SQL["gram"] = _with(FAC) + SQL_WX + """
SELECT a.t AS t1, b.t AS t2, round(sum(a.x * b.x), 6) AS g FROM wx a JOIN wx b USING (id) GROUP BY a.t, b.t"""
QUERIES["factor_dot"] = lambda s, sf: D.factor_dot(*_wh(s, sf)).select("id", r6(F.col("dot")).alias("dot"))
SQL["factor_dot"] = _with(FAC) + "SELECT id, round(list_dot_product(wf.vec, hf.vec), 6) AS dot FROM wf JOIN hf USING (id)"
QUERIES["axpy"] = lambda s, sf: exploded(D.axpy(0.5, *_wh(s, sf)))
SQL["axpy"] = _with(FAC) + """,
ax AS (SELECT id, list_transform(list_zip(wf.vec, hf.vec), lambda p: p[1] * 0.5 + p[2]) AS vec FROM wf JOIN hf USING (id))
""" + sql_exploded("ax")
QUERIES["shuffle_ids"] = lambda s, sf: D.shuffle_ids(fx.table(s, sf, "customer").select(F.col("c_custkey").alias("id")), 3)
SQL["shuffle_ids"] = f"""
SELECT id, row_number() OVER (ORDER BY h, id) - 1 AS new_id FROM (
  SELECT DISTINCT c_custkey AS id, ('0x' || substr(md5(concat_ws('|', 'perm', '3', CAST(c_custkey AS VARCHAR))), 1, 8))::BIGINT AS h
  FROM customer)"""


def _permuted(s, sf):
    ev = _ev(s, sf)
    rows, cols = (D.shuffle_ids(ev.select(F.col(c).alias("id")), seed) for c, seed in (("i", 3), ("j", 4)))
    return D.apply_permutation(ev, rows, cols)


def _sql_permutation(c, seed):
    return f"""(SELECT id, row_number() OVER (ORDER BY h, id) - 1 AS new_id FROM (
  SELECT DISTINCT {c} AS id, ('0x' || substr(md5(concat_ws('|', 'perm', '{seed}', CAST({c} AS VARCHAR))), 1, 8))::BIGINT AS h FROM evm))"""


QUERIES["apply_permutation"] = lambda s, sf: _permuted(s, sf).select("i", "j", r6(F.col("v")).alias("v"))
SQL["apply_permutation"] = _with(EVM) + f"""SELECT r.new_id AS i, c.new_id AS j, round(evm.v, 6) AS v
FROM evm JOIN {_sql_permutation('i', 3)} r ON r.id = evm.i JOIN {_sql_permutation('j', 4)} c ON c.id = evm.j"""

# ---------------------------------------------------------------- E factorization data operators
def _ev_counts(s, sf):
    ev = fx.table(s, sf, "events")
    return ev.select(F.col("user_id").alias("i"), F.get_json_object("props", "$.k").cast("long").alias("j")).where(
        F.col("j").isNotNull()).groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("v"))


EVC = """
evc AS (SELECT user_id AS i, CAST(json_extract_string(props, '$.k') AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v
        FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2)"""

QUERIES["glove_weights"] = lambda s, sf: E.glove_weights(_ev(s, sf), _ev_counts(s, sf), 10.0).select(
    "i", "j", r6(F.col("w")).alias("w"))
SQL["glove_weights"] = _with(EVM, EVC) + """
SELECT i, j, round(CASE WHEN evc.v > 10.0 THEN 1.0 ELSE pow(evc.v / 10.0, 0.75) END, 6) AS w FROM evm JOIN evc USING (i, j)"""
QUERIES["init_factors"] = lambda s, sf: exploded(E.init_factors(_ev(s, sf).select(F.col("i").alias("id")), 8, 1))
SQL["init_factors"] = _with(EVM) + f""",
ids AS (SELECT DISTINCT i AS id FROM evm),
ini AS (SELECT id, list_transform(generate_series(0, 7), lambda t: {sql_uniform("'init'", "'1'", 'id', 't')} * (1.0 / sqrt(8))) AS vec FROM ids)
""" + sql_exploded("ini")
QUERIES["zero_where_entries"] = lambda s, sf: exploded(E.zero_where_entries(_wh(s, sf)[1], _ev(s, sf), "j"))
SQL["zero_where_entries"] = _with(FAC, EVM) + """,
z AS (SELECT id, CASE WHEN id IN (SELECT j FROM evm) THEN list_transform(vec, lambda x: x * 0.0) ELSE vec END AS vec FROM hf)
""" + sql_exploded("z")
QUERIES["init_bias_dims"] = lambda s, sf: (lambda wb, hb: exploded(wb).withColumn("side", F.lit("W")).unionByName(
    exploded(hb).withColumn("side", F.lit("H"))))(*E.init_bias_dims(*_wh(s, sf)))
SQL["init_bias_dims"] = _with(FAC) + """,
wb AS (SELECT id, list_concat(vec, [1.0, 0.0]) AS vec FROM wf),
hb AS (SELECT id, list_concat(vec, [0.0, 1.0]) AS vec FROM hf)
SELECT *, 'W' AS side FROM (""" + sql_exploded("wb") + ") UNION ALL SELECT *, 'H' AS side FROM (" + sql_exploded("hb") + ")"
QUERIES["center_values"] = lambda s, sf: (lambda tr: tr.select("i", "j", r6(F.col("v")).alias("v")))(
    E.center_values(*fx.train_test(_ev(s, sf)))[1])
SQL["center_values"] = _with(EVM) + f"""
SELECT i, j, round(v - (SELECT avg(v) FROM evm WHERE NOT {split_expr()}), 6) AS v FROM evm WHERE {split_expr()}"""
QUERIES["zero_empty_ids"] = lambda s, sf: exploded(E.zero_empty_ids(_wh(s, sf)[0], _ev(s, sf), "i"))
SQL["zero_empty_ids"] = _with(FAC, EVM) + """,
z AS (SELECT id, CASE WHEN id IN (SELECT i FROM evm) THEN vec ELSE list_transform(vec, lambda x: x * 0.0) END AS vec FROM wf)
""" + sql_exploded("z")


def _col0(f):
    return f.select("id", F.element_at("vec", 1).alias("x"))


QUERIES["residuals"] = lambda s, sf: (lambda w, h: E.residuals(_ev(s, sf), _col0(w), _col0(h)).select(
    "i", "j", r6(F.col("v")).alias("v")))(*_wh(s, sf))
SQL_RES = """,
res AS (SELECT evm.i, evm.j, evm.v - coalesce(wf.vec[1], 0.0) * coalesce(hf.vec[1], 0.0) AS v
        FROM evm LEFT JOIN wf ON wf.id = evm.i LEFT JOIN hf ON hf.id = evm.j)"""
SQL["residuals"] = _with(EVM, FAC) + SQL_RES + "\nSELECT i, j, round(v, 6) AS v FROM res"
QUERIES["residual_loss"] = lambda s, sf: (lambda w, h: E.residual_loss(E.residuals(_ev(s, sf), _col0(w), _col0(h))).select(
    r6(F.col("loss")).alias("loss")))(*_wh(s, sf))
SQL["residual_loss"] = _with(EVM, FAC) + SQL_RES + "\nSELECT round(sum(v * v), 6) AS loss FROM res"
QUERIES["rank_one_update"] = lambda s, sf: (lambda w, h: E.rank_one_update(
    E.residuals(_ev(s, sf), _col0(w), _col0(h)), _col0(w), _col0(h), LAM).select(
    "id", r6(F.col("x")).alias("x"), r6(F.col("gain")).alias("gain")))(*_wh(s, sf))
SQL["rank_one_update"] = _with(EVM, FAC) + SQL_RES + f""",
g AS (SELECT res.j, sum(coalesce(wf.vec[1], 0.0) * res.v) AS slope, {LAM} * count(*) + sum(coalesce(wf.vec[1], 0.0) * coalesce(wf.vec[1], 0.0)) AS curve
      FROM res LEFT JOIN wf ON wf.id = res.i GROUP BY res.j)
SELECT hf.id, round(CASE WHEN slope IS NULL THEN hf.vec[1] ELSE slope / curve END, 6) AS x,
       round(CASE WHEN slope IS NULL THEN 0.0 ELSE curve * (hf.vec[1] - slope / curve) * (hf.vec[1] - slope / curve) END, 6) AS gain
FROM hf LEFT JOIN g ON g.j = hf.id"""
QUERIES["pu_rank_one_update"] = lambda s, sf: E.pu_rank_one_update(_ev(s, sf), *_wh(s, sf), 0, RHO, LAM).select("id", r6(F.col("x")).alias("x"))
SQL["pu_rank_one_update"] = _with(EVM, FAC) + SQL_WX + f""",
gram AS (SELECT b.t, sum(a.x * b.x) AS g FROM wx a JOIN wx b USING (id) WHERE a.t = 0 GROUP BY b.t),
push AS (SELECT hx.id, sum(CASE WHEN hx.t = 0 THEN 0.0 ELSE gram.g * hx.x END) AS push FROM hx JOIN gram USING (t) GROUP BY hx.id),
stored AS (SELECT evm.j AS id, sum((evm.v - {1 - RHO} * (list_dot_product(wf.vec, hf.vec) - wf.vec[1] * hf.vec[1])) * wf.vec[1]) AS pull,
                  sum({1 - RHO} * wf.vec[1] * wf.vec[1]) AS curve
           FROM evm JOIN wf ON wf.id = evm.i JOIN hf ON hf.id = evm.j GROUP BY evm.j),
cnt AS (SELECT j AS id, count(*) AS n FROM evm GROUP BY j)
SELECT id, round((coalesce(pull, 0.0) - {RHO} * push) /
                 (coalesce(curve, 0.0) + {RHO} * (SELECT g FROM gram WHERE t = 0) + {LAM} * coalesce(n, 0)), 6) AS x
FROM push LEFT JOIN stored USING (id) LEFT JOIN cnt USING (id)"""

QUERIES["loss_rmse"] = lambda s, sf: E.loss_rmse(_ev(s, sf), *_wh(s, sf)).select(
    r6(F.col("loss")).alias("loss"), r6(F.col("rmse")).alias("rmse"))
SQL_PRED = """,
pr AS (SELECT evm.i, evm.j, evm.v, coalesce(list_dot_product(wf.vec, hf.vec), 0.0) AS p
       FROM evm LEFT JOIN wf ON wf.id = evm.i LEFT JOIN hf ON hf.id = evm.j)"""
SQL["loss_rmse"] = _with(EVM, FAC) + SQL_PRED + """
SELECT round(sum((p - v) * (p - v)), 6) AS loss, round(sqrt(sum((p - v) * (p - v)) / count(*)), 6) AS rmse FROM pr"""
SQL_GG = """,
gw AS (SELECT a.t AS t1, b.t AS t2, sum(a.x * b.x) AS g FROM wx a JOIN wx b USING (id) GROUP BY 1, 2),
gh AS (SELECT a.t AS t1, b.t AS t2, sum(a.x * b.x) AS g FROM hx a JOIN hx b USING (id) GROUP BY 1, 2),
gg AS (SELECT sum(gw.g * gh.g) AS gg FROM gw JOIN gh USING (t1, t2))"""
QUERIES["pu_loss"] = lambda s, sf: E.pu_loss(_ev(s, sf), *_wh(s, sf), RHO).select(
    r6(F.col("omega")).alias("omega"), r6(F.col("zero")).alias("zero"), r6(F.col("loss")).alias("loss"))
SQL["pu_loss"] = _with(EVM, FAC) + SQL_WX + SQL_GG + SQL_PRED + f"""
SELECT round(om, 6) AS omega, round(ze, 6) AS zero, round(om + ze, 6) AS loss FROM (
  SELECT sum((v - p) * (v - p)) AS om, {RHO} * ((SELECT gg FROM gg) - sum(p * p)) AS ze FROM pr)"""
QUERIES["regularizer"] = lambda s, sf: E.regularizer(_ev(s, sf), *_wh(s, sf)).select(r6(F.col("reg")).alias("reg"))
SQL_REG = """,
rw AS (SELECT sum(c * list_sum(list_transform(vec, lambda x: x * x))) AS a FROM (SELECT i, count(*) AS c FROM evm GROUP BY i) JOIN wf ON wf.id = i),
rh AS (SELECT sum(c * list_sum(list_transform(vec, lambda x: x * x))) AS b FROM (SELECT j, count(*) AS c FROM evm GROUP BY j) JOIN hf ON hf.id = j)"""
SQL["regularizer"] = _with(EVM, FAC) + SQL_REG + "\nSELECT round(coalesce(a, 0.0) + coalesce(b, 0.0), 6) AS reg FROM rw, rh"
QUERIES["objective"] = lambda s, sf: E.objective(_ev(s, sf), *_wh(s, sf), RHO, LAM).select(r6(F.col("obj")).alias("obj"))
SQL["objective"] = _with(EVM, FAC) + SQL_WX + SQL_GG + SQL_PRED + SQL_REG + f"""
SELECT round(sum((v - p) * (v - p)) + {RHO} * ((SELECT gg FROM gg) - sum(p * p)) + {LAM} * (SELECT a FROM rw) + {LAM} * (SELECT b FROM rh), 6) AS obj FROM pr"""


QUERIES["weighted_zero_loss"] = lambda s, sf: E.weighted_zero_loss(_ev(s, sf), *_wh(s, sf), RHO).select(r6(F.col("loss")).alias("loss"))
SQL["weighted_zero_loss"] = _with(EVM, FAC) + SQL_WX + SQL_GG + SQL_PRED + f"""
SELECT round(coalesce(sum((p - v) * (p - v)), 0.0) + {RHO} * ((SELECT gg FROM gg) - coalesce(sum(p * p), 0.0)), 6) AS loss FROM pr WHERE v > 0"""


def _dims(s, sf):
    d = E.dims_of(_ev(s, sf)).first()
    return int(d["m"]), int(d["n"])


QUERIES["sample_negatives"] = lambda s, sf: E.sample_negatives(_ev(s, sf), *_dims(s, sf), "pu1", 1.0, seed=5)
SQL["sample_negatives"] = _with(EVM) + f""",
dm AS (SELECT max(i) + 1 AS m, max(j) + 1 AS n, count(*) AS nnz FROM evm)
SELECT i, j, v, true AS stored FROM evm
UNION ALL
SELECT CAST(floor({sql_uniform("'negi'", "'5'", 'r.range')} * dm.m) AS BIGINT) AS i,
       CAST(floor({sql_uniform("'negj'", "'5'", 'r.range')} * dm.n) AS BIGINT) AS j, 0.0 AS v, false AS stored
FROM dm, range(0, (SELECT nnz FROM dm)) r"""
# pu0: a share of the stored cells and as many draws as the rho-weighted grid asks for
RHO0 = 0.05
QUERIES["sample_negatives_pu0"] = lambda s, sf: E.sample_negatives(_ev(s, sf), *_dims(s, sf), "pu0", rho=RHO0, seed=6)
SQL["sample_negatives_pu0"] = _with(EVM) + f""",
d0 AS (SELECT max(i) + 1 AS m, max(j) + 1 AS n, count(*) AS nnz FROM evm),
dm AS (SELECT *, nnz / (nnz + {RHO0} * m * n) AS share, CAST(round({RHO0} * m * n * (nnz / (nnz + {RHO0} * m * n))) AS BIGINT) AS draws FROM d0)
SELECT i, j, v, true AS stored FROM evm, dm WHERE {sql_uniform("'keep'", "'6'", 'i', 'j')} < share
UNION ALL
SELECT CAST(floor({sql_uniform("'negi'", "'6'", 'r.range')} * dm.m) AS BIGINT) AS i,
       CAST(floor({sql_uniform("'negj'", "'6'", 'r.range')} * dm.n) AS BIGINT) AS j, 0.0 AS v, false AS stored
FROM dm, range(0, (SELECT draws FROM dm)) r"""
# zero cells at a rate: the SQL lists more gaps than any block can use
RATE0 = 0.02
QUERIES["sample_zero_cells"] = lambda s, sf: E.sample_zero_cells(_ev(s, sf), *_dims(s, sf), RATE0, seed=7)
SQL["sample_zero_cells"] = _with(EVM) + f""",
d0 AS (SELECT CAST(max(i) + 1 AS BIGINT) AS m, CAST(max(j) + 1 AS BIGINT) AS n FROM evm),
dm AS (SELECT *, m * n AS cells, greatest(1, least(m * n, CAST(floor({E.DRAWS} / {RATE0}) AS BIGINT))) AS block FROM d0),
blocks AS (SELECT b.range AS b, dm.* FROM dm, range(0, (SELECT CAST(ceil(cells / block::DOUBLE) AS BIGINT) FROM dm)) b),
gaps AS (SELECT blocks.*, b * block - 1 + sum(1 + CAST(floor(ln(1 - {sql_uniform("'gap'", "'7'", 'b', 'k.range')}) / ln(1 - {RATE0})) AS BIGINT))
                OVER (PARTITION BY b ORDER BY k.range) AS cell
         FROM blocks, range(0, {2 * E.DRAWS}) k)
SELECT CAST(cell // n AS BIGINT) AS i, CAST(cell % n AS BIGINT) AS j, 0.0 AS v FROM gaps
WHERE cell < least((b + 1) * block, cells) AND NOT EXISTS (SELECT 1 FROM evm WHERE evm.i = cell // n AND evm.j = cell % n)"""
QUERIES["sample_cells_lookup"] = lambda s, sf: (lambda ev: E.sample_cells_lookup(ev, *_dims(s, sf), ev.count(), 0.5, seed=5))(_ev(s, sf))
SQL["sample_cells_lookup"] = _with(EVM) + f""",
dm AS (SELECT max(i) + 1 AS m, max(j) + 1 AS n, count(*) AS nnz FROM evm),
dr AS (SELECT CAST(floor({sql_uniform("'looki'", "'5'", 'r.range')} * dm.m) AS BIGINT) AS i,
              CAST(floor({sql_uniform("'lookj'", "'5'", 'r.range')} * dm.n) AS BIGINT) AS j
       FROM dm, range(0, (SELECT nnz FROM dm)) r)
SELECT dr.i, dr.j, coalesce(evm.v, 0.0) AS v, CAST(CASE WHEN evm.v IS NULL THEN 0.5 ELSE 1.0 END AS DOUBLE) AS w
FROM dr LEFT JOIN evm ON evm.i = dr.i AND evm.j = dr.j"""
QUERIES["pu_zero_gradient_step"] = lambda s, sf: (lambda wh: exploded(wh[0]).withColumn("side", F.lit("W")).unionByName(
    exploded(wh[1]).withColumn("side", F.lit("H"))))(E.pu_zero_gradient_step(*_wh(s, sf), RHO, ETA))
SQL["pu_zero_gradient_step"] = _with(FAC) + SQL_WX + f""",
gh AS (SELECT a.t AS t1, b.t AS t2, sum(a.x * b.x) AS g FROM hx a JOIN hx b USING (id) GROUP BY 1, 2),
w2 AS (SELECT wx.id, wx.t, wx.x - {ETA * RHO} * s.s AS x FROM wx JOIN (
         SELECT wx.id, gh.t2 AS t, sum(wx.x * gh.g) AS s FROM wx JOIN gh ON gh.t1 = wx.t GROUP BY 1, 2) s USING (id, t)),
gw AS (SELECT a.t AS t1, b.t AS t2, sum(a.x * b.x) AS g FROM w2 a JOIN w2 b USING (id) GROUP BY 1, 2),
h2 AS (SELECT hx.id, hx.t, hx.x - {ETA * RHO} * s.s AS x FROM hx JOIN (
         SELECT hx.id, gw.t2 AS t, sum(hx.x * gw.g) AS s FROM hx JOIN gw ON gw.t1 = hx.t GROUP BY 1, 2) s USING (id, t))
SELECT id, t, round(x, 6) AS x, 'W' AS side FROM w2 UNION ALL SELECT id, t, round(x, 6) AS x, 'H' AS side FROM h2"""
QUERIES["entry_regularization"] = lambda s, sf: E.entry_regularization(_ev(s, sf), _ev(s, sf), 100, LAM, "row_share").select(
    "i", "j", r6(F.col("lam")).alias("lam"))
SQL["entry_regularization"] = _with(EVM) + f"""
SELECT evm.i, evm.j, round({LAM} * c.n / (100.0 + c.n), 6) AS lam FROM evm JOIN (SELECT i, count(*) AS n FROM evm GROUP BY i) c USING (i)"""

# ---------------------------------------------------------------- F prediction and ranking
def _split_ev(s, sf):
    """(train, test) of the event matrix; test values become graded relevance
    ceil(v / 20) so that DCG gains 2^rel - 1 stay in a readable range."""
    tr, te = fx.train_test(_ev(s, sf))
    return tr, te.withColumn("v", F.ceil(F.col("v") / 20.0).cast("double"))


def _split_raw(s, sf):
    return fx.train_test(_ev(s, sf))


QUERIES["predict"] = lambda s, sf: R.predict(fx.train_test(_inter(s, sf))[1], *_wh(s, sf), 0.5).select(
    "i", "j", r6(F.col("pred")).alias("pred"))
SQL["predict"] = _with(INTER, FAC) + f"""
SELECT inter.i, inter.j, round(0.5 + coalesce(list_dot_product(wf.vec, hf.vec), 0.0), 6) AS pred
FROM inter LEFT JOIN wf ON wf.id = inter.i LEFT JOIN hf ON hf.id = inter.j WHERE {split_expr()}"""
QUERIES["predict_row"] = lambda s, sf: R.predict_row(*_wh(s, sf), 0).select("j", r6(F.col("pred")).alias("pred"))
SQL["predict_row"] = _with(FAC) + "SELECT hf.id AS j, round(list_dot_product(wf.vec, hf.vec), 6) AS pred FROM hf, wf WHERE wf.id = 0"
QUERIES["predict_col"] = lambda s, sf: R.predict_col(*_wh(s, sf), 0).select("i", r6(F.col("pred")).alias("pred"))
SQL["predict_col"] = _with(FAC) + "SELECT wf.id AS i, round(list_dot_product(wf.vec, hf.vec), 6) AS pred FROM wf, hf WHERE hf.id = 0"
QUERIES["prediction_rmse"] = lambda s, sf: R.prediction_rmse(R.predict(_split_raw(s, sf)[1], *_wh(s, sf))).select(
    r6(F.col("rmse")).alias("rmse"))
SQL_TEST = f""",
test_raw AS (SELECT i, j, v FROM evm WHERE {split_expr()}),
test AS (SELECT i, j, CAST(ceil(v / 20.0) AS DOUBLE) AS v FROM test_raw),
train AS (SELECT i, j, v FROM evm WHERE NOT {split_expr()})"""
SQL["prediction_rmse"] = _with(EVM, FAC) + SQL_TEST + """
SELECT round(sqrt(avg((v - coalesce(list_dot_product(wf.vec, hf.vec), 0.0)) ^ 2)), 6) AS rmse
FROM test_raw test LEFT JOIN wf ON wf.id = test.i LEFT JOIN hf ON hf.id = test.j"""


def _topk(s, sf):
    tr, te = _split_ev(s, sf)
    w, h = _wh(s, sf)
    return R.recommend_topk(te.select(F.col("i").alias("id")), w, h, K, tr)


QUERIES["recommend_topk"] = lambda s, sf: _topk(s, sf).select(
    "i", F.col("rank").cast("long").alias("rank"), "j", r6(F.col("score")).alias("score"))
SQL_CAND = """,
qrows AS (SELECT DISTINCT i FROM test),
cand AS (SELECT q.i, hf.id AS j, coalesce(list_dot_product(wf.vec, hf.vec), 0.0) AS s
         FROM qrows q LEFT JOIN wf ON wf.id = q.i CROSS JOIN hf
         WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.i = q.i AND t.j = hf.id)),
ranked AS (SELECT i, j, s, row_number() OVER (PARTITION BY i ORDER BY s DESC, j ASC) AS rank FROM cand)"""
SQL["recommend_topk"] = _with(EVM, FAC) + SQL_TEST + SQL_CAND + f"""
SELECT i, rank, j, round(s, 6) AS score FROM ranked WHERE rank <= {K}"""
QUERIES["dcg_at_k"] = lambda s, sf: R.dcg_at_levels(
    _split_ev(s, sf)[1].withColumn("_p", F.row_number().over(
        Window.partitionBy("i").orderBy(F.desc("v"), "j"))).where(F.col("_p") <= 5),
    ["i"], "_p", "v", 5).select("i", F.col("level").cast("long").alias("level"), r6(F.col("dcg")).alias("dcg"))
SQL["dcg_at_k"] = _with(EVM) + SQL_TEST + """,
p AS (SELECT i, v, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS pos FROM test),
lv AS (SELECT DISTINCT i, unnest(generate_series(1, 5)) AS level FROM test)
SELECT lv.i, lv.level, round(coalesce(sum(CASE WHEN p.pos <= lv.level THEN (pow(2.0, p.v) - 1) / log2(p.pos + 1.0) END), 0.0), 6) AS dcg
FROM lv JOIN p ON p.i = lv.i GROUP BY lv.i, lv.level"""
QUERIES["ndcg_rated"] = lambda s, sf: R.ndcg_rated(R.predict(_split_ev(s, sf)[1], *_wh(s, sf)), 5, "i").select(
    F.col("level").cast("long").alias("level"), r6(F.col("ndcg")).alias("ndcg"))
SQL["ndcg_rated"] = _with(EVM, FAC) + SQL_TEST + """,
sc AS (SELECT test.i, test.j, test.v, coalesce(list_dot_product(wf.vec, hf.vec), 0.0) AS p
       FROM test LEFT JOIN wf ON wf.id = test.i LEFT JOIN hf ON hf.id = test.j),
bp AS (SELECT i, v, row_number() OVER (PARTITION BY i ORDER BY p DESC, j) AS pos FROM sc),
bt AS (SELECT i, v, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS pos FROM sc),
lv AS (SELECT DISTINCT i, unnest(generate_series(1, 5)) AS level FROM sc),
d AS (SELECT lv.i, lv.level, coalesce(sum(CASE WHEN bp.pos <= lv.level THEN (pow(2.0, bp.v) - 1) / log2(bp.pos + 1.0) END), 0.0) AS dcg
      FROM lv JOIN bp ON bp.i = lv.i GROUP BY 1, 2),
m AS (SELECT lv.i, lv.level, coalesce(sum(CASE WHEN bt.pos <= lv.level THEN (pow(2.0, bt.v) - 1) / log2(bt.pos + 1.0) END), 0.0) AS maxdcg
      FROM lv JOIN bt ON bt.i = lv.i GROUP BY 1, 2)
SELECT level, round(avg(CASE WHEN maxdcg > 0 THEN 100.0 * dcg / maxdcg END), 6) AS ndcg FROM d JOIN m USING (i, level) GROUP BY level"""
QUERIES["ndcg_topk_lists"] = lambda s, sf: R.ndcg_topk_lists(_split_ev(s, sf)[1], _topk(s, sf).select("i", "rank", "j"), K, "i").select(
    F.col("level").cast("long").alias("level"), r6(F.col("ndcg")).alias("ndcg"))
SQL["ndcg_topk_lists"] = _with(EVM, FAC) + SQL_TEST + SQL_CAND + f""",
lst AS (SELECT r.i, r.rank AS pos, coalesce(t.v, 0.0) AS rel FROM ranked r LEFT JOIN test t ON t.i = r.i AND t.j = r.j
        WHERE r.rank <= {K} AND r.i IN (SELECT i FROM test)),
bt AS (SELECT i, v AS rel, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS pos FROM test),
lv AS (SELECT DISTINCT i, unnest(generate_series(1, {K})) AS level FROM test),
d AS (SELECT lv.i, lv.level, coalesce(sum(CASE WHEN lst.pos <= lv.level THEN (pow(2.0, lst.rel) - 1) / log2(lst.pos + 1.0) END), 0.0) AS dcg
      FROM lv LEFT JOIN lst ON lst.i = lv.i GROUP BY 1, 2),
m AS (SELECT lv.i, lv.level, coalesce(sum(CASE WHEN bt.pos <= lv.level THEN (pow(2.0, bt.rel) - 1) / log2(bt.pos + 1.0) END), 0.0) AS maxdcg
      FROM lv JOIN bt ON bt.i = lv.i GROUP BY 1, 2)
SELECT level, round(avg(CASE WHEN maxdcg > 0 THEN 100.0 * dcg / maxdcg END), 6) AS ndcg FROM d JOIN m USING (i, level) GROUP BY level"""


def _ranks(s, sf):
    tr, te = _split_ev(s, sf)
    w, h = _wh(s, sf)
    return R.rank_positives(te, w, h, tr), te, tr, h


QUERIES["rank_positives"] = lambda s, sf: _ranks(s, sf)[0].select("i", "j", "rank", "nr_pos")
SQL_POS = """,
pos AS (SELECT r.i, r.j, r.rank, t.v AS rel, row_number() OVER (PARTITION BY r.i ORDER BY r.rank) AS nr_pos
        FROM ranked r JOIN test t USING (i, j) WHERE t.v > 0),
ncand AS (SELECT i, count(*) AS n_cand FROM cand GROUP BY i),
per AS (
  SELECT n.i, count(p.j) AS pos, coalesce(sum(100.0 * p.nr_pos / p.rank), 0.0) AS smap, coalesce(sum(p.rank - p.nr_pos), 0) AS viol,
         coalesce(sum(p.rel * pow(0.5, (p.rank - 1) / 4.0)), 0.0) AS hl, coalesce(sum(p.rel * pow(0.5, (p.nr_pos - 1) / 4.0)), 0.0) AS hmax, n.n_cand
  FROM ncand n LEFT JOIN pos p USING (i) GROUP BY n.i, n.n_cand),
rowm AS (
  SELECT i, CASE WHEN pos > 0 THEN smap / pos ELSE 0.0 END AS map,
         CASE WHEN pos > 0 AND n_cand - pos > 0 THEN (pos * (n_cand - pos) - viol) / (pos * (n_cand - pos)) ELSE 1.0 END AS auc,
         CASE WHEN pos > 0 AND hmax > 0 THEN 100.0 * hl / hmax ELSE 0.0 END AS hlu
  FROM per)"""
SQL["rank_positives"] = _with(EVM, FAC) + SQL_TEST + SQL_CAND + SQL_POS + "\nSELECT i, j, rank, nr_pos FROM pos"


def _metrics(s, sf):
    ranks, te, tr, h = _ranks(s, sf)
    return R.rank_metrics(ranks, R.row_candidates(te, h, tr))


QUERIES["rank_metrics"] = lambda s, sf: _metrics(s, sf).select(
    r6(F.col("map")).alias("map"), r6(F.col("auc")).alias("auc"), r6(F.col("hlu")).alias("hlu"))
SQL["rank_metrics"] = _with(EVM, FAC) + SQL_TEST + SQL_CAND + SQL_POS + """
SELECT round(avg(map), 6) AS map, round(avg(auc), 6) AS auc, round(avg(hlu), 6) AS hlu FROM rowm"""
for _m in ("map", "auc", "hlu"):
    QUERIES[f"{_m}_score"] = (lambda m: lambda s, sf: _metrics(s, sf).select(r6(F.col(m)).alias(m)))(_m)
    SQL[f"{_m}_score"] = _with(EVM, FAC) + SQL_TEST + SQL_CAND + SQL_POS + f"\nSELECT round(avg({_m}), 6) AS {_m} FROM rowm"
QUERIES["ndcg_full"] = lambda s, sf: (lambda r: R.ndcg_full(r[0], r[1], K))(_ranks(s, sf)).select(
    F.col("level").cast("long").alias("level"), r6(F.col("ndcg")).alias("ndcg"))
SQL["ndcg_full"] = _with(EVM, FAC) + SQL_TEST + SQL_CAND + SQL_POS + f""",
bt AS (SELECT i, v AS rel, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS pos FROM test),
lv AS (SELECT DISTINCT i, unnest(generate_series(1, {K})) AS level FROM test),
d AS (SELECT lv.i, lv.level, coalesce(sum(CASE WHEN pos.rank <= lv.level THEN (pow(2.0, pos.rel) - 1) / log2(pos.rank + 1.0) END), 0.0) AS dcg
      FROM lv LEFT JOIN pos ON pos.i = lv.i GROUP BY 1, 2),
m AS (SELECT lv.i, lv.level, coalesce(sum(CASE WHEN bt.pos <= lv.level THEN (pow(2.0, bt.rel) - 1) / log2(bt.pos + 1.0) END), 0.0) AS maxdcg
      FROM lv JOIN bt ON bt.i = lv.i GROUP BY 1, 2)
SELECT level, round(avg(CASE WHEN maxdcg > 0 THEN 100.0 * dcg / maxdcg END), 6) AS ndcg FROM d JOIN m USING (i, level) GROUP BY level"""


def _weighted(s, sf):
    ranks, te, tr, h = _ranks(s, sf)
    wts = fx.table(s, sf, "events").groupBy(F.col("user_id").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return R.weighted_rank_metrics(ranks, 5, h.count(), tr, wts)


QUERIES["weighted_rank_metrics"] = lambda s, sf: _weighted(s, sf).select(
    "metric", F.col("level").cast("long").alias("level"), r6(F.col("value")).alias("value"))
SQL["weighted_rank_metrics"] = _with(EVM, FAC) + SQL_TEST + SQL_CAND + SQL_POS + """,
wt AS (SELECT user_id AS i, CAST(count(*) AS DOUBLE) AS weight FROM events GROUP BY user_id),
ni AS (SELECT i, count(*) AS ni FROM (SELECT DISTINCT i, j FROM train) GROUP BY i),
pr AS (SELECT p.i, avg(100.0 * p.nr_pos / p.rank) AS map, max(p.nr_pos) AS pos, sum(p.rank - p.nr_pos) AS viol,
              sum(pow(0.5, (p.rank - 1) / 4.0)) AS ra, sum(pow(0.5, (p.nr_pos - 1) / 4.0)) AS ramax
       FROM pos p GROUP BY p.i),
pw AS (SELECT pr.*, coalesce(wt.weight, 1.0) AS weight,
              CASE WHEN pos * ((SELECT count(*) FROM hf) - coalesce(ni.ni, 0) - pos) <> 0
                   THEN 1.0 - viol / (pos * ((SELECT count(*) FROM hf) - coalesce(ni.ni, 0) - pos)) END AS auc
       FROM pr LEFT JOIN wt USING (i) LEFT JOIN ni USING (i)),
lv AS (SELECT DISTINCT i, unnest(generate_series(1, 5)) AS level FROM pos),
nd AS (SELECT lv.i, lv.level,
              coalesce(sum(CASE WHEN p.rank <= lv.level THEN 1.0 / log2(1.0 + p.rank) END), 0.0) AS dcg,
              coalesce(sum(CASE WHEN p.nr_pos <= lv.level THEN 1.0 / log2(1.0 + p.nr_pos) END), 0.0) AS maxdcg
       FROM lv JOIN pos p ON p.i = lv.i GROUP BY 1, 2)
SELECT 'map' AS metric, 0 AS level, round(sum(CASE WHEN map > 0 THEN weight * map END) / sum(CASE WHEN map > 0 THEN weight END), 6) AS value FROM pw
UNION ALL SELECT 'auc', 0, round(sum(CASE WHEN auc > 0 THEN weight * auc END) / sum(CASE WHEN auc > 0 THEN weight END), 6) FROM pw
UNION ALL SELECT 'hlu', 0, round(100.0 * sum(CASE WHEN ramax > 0 THEN weight * ra / ramax END) / sum(CASE WHEN ramax > 0 THEN weight END), 6) FROM pw
UNION ALL SELECT 'ndcg', level, round(sum(CASE WHEN maxdcg > 0 THEN weight * 100.0 * dcg / maxdcg END) / sum(CASE WHEN maxdcg > 0 THEN weight END), 6)
FROM nd JOIN pw USING (i) GROUP BY level"""
