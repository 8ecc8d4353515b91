"""DuckDB twins of the fixtures and of the corpus plan (independent SQL oracle).

These strings restate the semantics directly in SQL (self-join on positions,
window ranks) rather than mirroring the Spark plan.
"""

from __future__ import annotations

from wordfold.functions.rand import sql_uniform
from wordfold.functions.text import WHITESPACE_RE_SQL


def d(x: float) -> str:
    """Double literal (DuckDB reads plain decimals as DECIMAL)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def corpus_ctes(thr: int, sub: float, seed: int, lang: str | None = None) -> str:
    """CTEs lines, tok, voc, vp, kept over `documents`."""
    where = f"WHERE lang = '{lang}'" if lang else ""
    u = sql_uniform("'sub'", f"'{seed}'", "t.doc_id", "t.line_no", "t.pos")
    return f"""
lines0 AS (
  SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents {where})
),
lines AS (
  SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '{WHITESPACE_RE_SQL}'), lambda x: x <> '') AS toks
  FROM lines0
),
tok AS (
  SELECT doc_id, line_no, unnest(generate_series(0, len(toks) - 1)) AS pos, unnest(toks) AS word
  FROM lines WHERE len(toks) > 0
),
voc AS (SELECT word, count(*) AS n FROM tok GROUP BY word HAVING count(*) >= {int(thr)}),
vtot AS (SELECT CAST(sum(n) AS BIGINT) AS corpus_size FROM voc),
vp AS (
  SELECT word, n,
         CASE WHEN {d(sub)} > 0 AND n > {d(sub)} * corpus_size
              THEN 1.0 - sqrt({d(sub)} * corpus_size / n) ELSE 0.0 END AS p_drop
  FROM voc, vtot
),
kept AS (
  SELECT t.doc_id, t.line_no, t.pos, t.word
  FROM tok t JOIN vp USING (word)
  WHERE vp.p_drop <= 0 OR {u} > vp.p_drop
)"""


def pairs_ctes(win: int, dyn: bool, positional: bool, delete: bool, seed: int) -> str:
    """CTEs coord, pairs, counts (requires `kept`)."""
    coord = "row_number() OVER (PARTITION BY doc_id, line_no ORDER BY pos) - 1" if delete else "pos"
    if dyn:
        w = f"CAST(floor({sql_uniform(chr(39) + 'dyn' + chr(39), chr(39) + str(seed) + chr(39), 'doc_id', 'line_no', 'pos')} * {int(win)}) AS BIGINT) + 1"
    else:
        w = str(int(win))
    ctx = "x.word || '_' || CAST(x.q - c.q AS VARCHAR)" if positional else "x.word"
    return f"""
coord AS (SELECT doc_id, line_no, pos, word, {coord} AS q, {w} AS w FROM kept),
pairs AS (
  SELECT c.word AS word, {ctx} AS context
  FROM coord c, range(-{int(win)}, {int(win)} + 1) r(off), coord x
  WHERE x.doc_id = c.doc_id AND x.line_no = c.line_no AND x.q = c.q + r.off
    AND r.off <> 0 AND abs(r.off) <= c.w
),
counts AS (SELECT word, context, count(*) AS n FROM pairs GROUP BY word, context)"""


def assoc_ctes(cds: float) -> str:
    """CTEs ws, cs, tot, epmi (requires `counts`)."""
    smooth = "CAST(sum(n) AS DOUBLE)" if cds == 1 else f"pow(CAST(sum(n) AS DOUBLE), {d(cds)})"
    return f"""
ws AS (SELECT word, sum(n) AS row_sum FROM counts GROUP BY word),
cs AS (SELECT context, sum(n) AS col_sum, {smooth} AS col_smooth FROM counts GROUP BY context),
tot AS (SELECT sum(col_smooth) AS smooth_total FROM cs),
epmi AS (
  SELECT c.word, c.context, c.n, c.n * tot.smooth_total / (ws.row_sum * cs.col_smooth) AS epmi
  FROM counts c JOIN ws USING (word) JOIN cs USING (context), tot
)"""


def interactions_cte() -> str:
    return """
inter AS (
  SELECT o.o_custkey AS i, l.l_partkey AS j, CAST(sum(l.l_quantity) AS DOUBLE) AS v
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_custkey, l.l_partkey
)"""


def split_expr(seed: int = 7) -> str:
    return f"({sql_uniform(chr(39) + 'split' + chr(39), chr(39) + str(seed) + chr(39), 'i', 'j')} < 0.2)"


def factor_ctes() -> str:
    return """
emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
wf AS (SELECT CAST(vec_id // 2 AS BIGINT) AS id, vec FROM emb WHERE vec_id % 2 = 0),
hf AS (SELECT CAST((vec_id - 1) // 2 AS BIGINT) AS id, vec FROM emb WHERE vec_id % 2 = 1)"""


def event_matrix_cte() -> str:
    return """
evm AS (
  SELECT user_id AS i, CAST(json_extract_string(props, '$.k') AS BIGINT) AS j, CAST(sum(value) AS DOUBLE) AS v
  FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
  GROUP BY 1, 2
)"""


def word_vectors_cte() -> str:
    return """
wv AS (SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"""


def wordsim_cte() -> str:
    g = sql_uniform("'gold'", "a.vec_id")
    return f"""
gold AS (
  SELECT 'w' || CAST(a.vec_id AS VARCHAR) AS w1, 'w' || CAST(a.vec_id + 1 AS VARCHAR) AS w2,
         (CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END) + {g} * 0.5 AS gold
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
  UNION ALL SELECT 'w0', 'unknown_word', 0.25
)"""


def analogy_cte() -> str:
    def pick(tag: str) -> str:
        return f"'w' || CAST(CAST(floor({sql_uniform(chr(39) + tag + chr(39), 'e.vec_id')} * (m.m + 1)) AS BIGINT) AS VARCHAR)"

    return f"""
quest AS (
  SELECT e.vec_id AS qid,
         CASE WHEN e.vec_id % 250 = 0 THEN 'nosuchword' ELSE {pick('qa')} END AS a,
         {pick('qa_')} AS a_, {pick('qb')} AS b, {pick('qb_')} AS b_
  FROM embeddings e, (SELECT max(vec_id) AS m FROM embeddings) m
)"""
