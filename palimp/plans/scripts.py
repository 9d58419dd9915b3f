"""Edit scripts in SQL, and the queries whose rows depend on them: word similarity, pairing by it, moved blocks, and the full comparison.

The SQL states the script's definition step by step: unique common elements on a longest increasing subsequence (by the piles of patience sorting); between them, equal beginnings and ends; between these, a table of common lengths, walked back from
its end. It doesn't halve large tables, as the library does beyond 2^28 cells.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimp.functions import similarity as sim
from palimp.functions.syntax import ast_signature, ast_similarity, full_similarity
from palimp.functions.tokens import token_line_similarity
from palimp.operators import align, matching
from palimp.plans import compare as cmp
from palimp.plans.finer import _LISTS, _greedy_sql, block_moves_sql, fast_similarity_sql
from palimp.plans.registry import EDITED, TRIM, _docs, _facing, _full, query
from palimp.sources import pairs as src
from palimp.storage import written


def script_sql(source: str, n: str) -> str:
    """{n}m(id, i, j): matched positions (from 1) of the script of lists a and b of source(id, a, b)."""
    return f"""{n}s AS MATERIALIZED (SELECT id, a, b FROM {source}),
  {n}ua AS (SELECT id, v, min(i) AS i FROM (SELECT id, unnest(a) AS v, generate_subscripts(a, 1) AS i FROM {n}s) GROUP BY 1, 2 HAVING count(*) = 1), {n}ub AS (SELECT id, v, min(j) AS j FROM (SELECT id, unnest(b) AS v, generate_subscripts(b, 1) AS j FROM {n}s) GROUP BY 1, 2 HAVING count(*) = 1),
  {n}an AS MATERIALIZED (SELECT id, list(i ORDER BY i) AS ai, list(j ORDER BY i) AS aj FROM (SELECT id, i, j FROM {n}ua JOIN {n}ub USING (id, v)) GROUP BY 1),
  {n}pr(id, k, tops, pile) AS (SELECT id, 0, CAST([] AS BIGINT[]), 0 FROM {n}an UNION ALL
    SELECT id, k + 1, list_concat(list_append(tops[1:below], j), tops[below + 2:]), CAST(below + 1 AS INTEGER) FROM (SELECT p.*, aj[k + 1] AS j, len(list_filter(tops, lambda t: t < aj[k + 1])) AS below FROM {n}pr p JOIN {n}an USING (id) WHERE k < len(aj))),
  {n}pp AS MATERIALIZED (SELECT id, k, pile FROM {n}pr WHERE k > 0),
  {n}pb AS MATERIALIZED (SELECT x.id, x.k, y.k AS back FROM {n}pp x ASOF JOIN (SELECT id, pile + 1 AS pile, k FROM {n}pp) y ON x.id = y.id AND x.pile = y.pile AND x.k > y.k),
  {n}pt AS (SELECT id, max(k) AS k FROM (SELECT id, k, pile, max(pile) OVER (PARTITION BY id) AS most FROM {n}pp) WHERE pile = most GROUP BY 1),
  {n}pw(id, k) AS (SELECT id, k FROM {n}pt UNION ALL SELECT b.id, b.back FROM {n}pw w JOIN {n}pb b ON b.id = w.id AND b.k = w.k),
  {n}ka AS MATERIALIZED (SELECT id, ai[k] AS i, aj[k] AS j FROM {n}pw JOIN {n}an USING (id)),
  {n}kg AS (SELECT id, i, j, coalesce(lag(i) OVER w, 0) AS i0, coalesce(lag(j) OVER w, 0) AS j0 FROM (SELECT id, i, j FROM {n}ka UNION ALL SELECT id, len(a) + 1, len(b) + 1 FROM {n}s) WINDOW w AS (PARTITION BY id ORDER BY i)),
  {n}g0 AS MATERIALIZED (SELECT id, i0, j0, a[i0 + 1 : i - 1] AS x, b[j0 + 1 : j - 1] AS y FROM {n}kg JOIN {n}s USING (id) WHERE i - i0 > 1 AND j - j0 > 1),
  {n}g1 AS MATERIALIZED (SELECT *, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda k: x[k] = y[k]), false) - 1, least(len(x), len(y))) AS lo FROM {n}g0),
  {n}g2 AS MATERIALIZED (SELECT *, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) - lo + 1), lambda k: x[len(x) + 1 - k] = y[len(y) + 1 - k]), false) - 1, least(len(x), len(y)) - lo) AS hi FROM {n}g1),
  {n}g3 AS (SELECT *, x[lo + 1 : len(x) - hi] AS x2, y[lo + 1 : len(y) - hi] AS y2 FROM {n}g2),
  {n}g4 AS (SELECT *, list_filter(range(1, len(x2) + 1), lambda k: list_contains(y2, x2[k])) AS px, list_filter(range(1, len(y2) + 1), lambda k: list_contains(x2, y2[k])) AS py FROM {n}g3),
  {n}g AS MATERIALIZED (SELECT row_number() OVER () AS gid, id, i0 + lo AS bi, j0 + lo AS bj, px, py, list_transform(px, lambda k: x2[k]) AS x, list_transform(py, lambda k: y2[k]) AS y FROM {n}g4 WHERE len(px) > 0 AND len(py) > 0),
  {n}dp(gid, k, r) AS (SELECT gid, 0, list_transform(y, lambda v: 0) FROM {n}g UNION ALL
    SELECT d.gid, d.k + 1, list_transform(range(1, len(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda t: greatest(r[t], (CASE WHEN t > 1 THEN r[t - 1] ELSE 0 END) + CAST(y[t] = x[d.k + 1] AS INTEGER))))) FROM {n}dp d JOIN {n}g g ON g.gid = d.gid WHERE d.k < len(x)),
  {n}tb AS MATERIALIZED (SELECT gid, list(r ORDER BY k) AS t FROM {n}dp GROUP BY 1),
  {n}bw(gid, i, j, hit) AS (SELECT gid, CAST(len(x) AS BIGINT), CAST(len(y) AS BIGINT), false FROM {n}g UNION ALL
    SELECT gid, CASE WHEN same THEN i WHEN up THEN i - 1 ELSE i - 1 END, CASE WHEN same THEN j - 1 WHEN up THEN j ELSE j - 1 END, NOT same AND NOT up
    FROM (SELECT w.gid, i, j, t[i + 1][j] = (CASE WHEN j > 1 THEN t[i + 1][j - 1] ELSE 0 END) AS same, i > 1 AND t[i][j] > (CASE WHEN j > 1 THEN t[i][j - 1] ELSE 0 END) AS up FROM {n}bw w JOIN {n}tb b ON b.gid = w.gid WHERE i > 0 AND j > 0)),
  {n}m AS MATERIALIZED (SELECT id, i, j FROM {n}ka UNION ALL SELECT id, i0 + k, j0 + k FROM (SELECT id, i0, j0, unnest(range(1, lo + 1)) AS k FROM {n}g2) UNION ALL SELECT id, i0 + len(x) + 1 - k, j0 + len(y) + 1 - k FROM (SELECT id, i0, j0, x, y, unnest(range(1, hi + 1)) AS k FROM {n}g2)
    UNION ALL SELECT id, bi + px[i + 1], bj + py[j + 1] FROM {n}bw JOIN {n}g USING (gid) WHERE hit)"""


_WORD = "[\\p{L}\\p{N}_]+|\\s+|[^\\p{L}\\p{N}_\\s]"


def word_similarity_sql(source: str, n: str) -> str:
    """{n}(id, sim) of lines x and y of source(id, x, y): twice the characters of words in common over both lengths, trimmed and in lower case."""
    key = lambda c: f"list_transform(regexp_extract_all({c}, '{_WORD}'), lambda v: CASE WHEN regexp_matches(v, '^\\s') THEN ' ' ELSE v END)"
    return f"""{n}t AS MATERIALIZED (SELECT id, lower({TRIM.format('x')}) AS s, lower({TRIM.format('y')}) AS t FROM {source}), {n}d AS (SELECT DISTINCT s, t FROM {n}t WHERE s <> t AND s <> '' AND t <> ''), {n}e AS MATERIALIZED (SELECT row_number() OVER () AS id, s, t FROM {n}d),
  {n}w AS (SELECT id, {key('s')} AS a, {key('t')} AS b FROM {n}e), {script_sql(n + 'w', n)},
  {n}c AS (SELECT id, sum(length(regexp_extract_all(s, '{_WORD}')[i])) AS n FROM {n}m JOIN {n}e USING (id) GROUP BY 1),
  {n}z AS (SELECT s, t, least(1.0, 2 * coalesce(n, 0) / (length(s) + length(t))) AS sim FROM {n}e LEFT JOIN {n}c USING (id)),
  {n} AS MATERIALIZED (SELECT x.id, CASE WHEN x.s = x.t THEN 1.0 WHEN x.s = '' OR x.t = '' THEN 0.0 ELSE z.sim END AS sim FROM {n}t x LEFT JOIN {n}z z USING (s, t))"""


@query(f"WITH RECURSIVE {EDITED}, fc AS (SELECT pair_id * 100000 + a.line_no AS id, a.line AS x, b.line AS y FROM ol a JOIN nl b USING (pair_id, line_no)), {word_similarity_sql('fc', 'ws')} SELECT id // 100000 AS pair_id, CAST(id % 100000 AS INTEGER) AS line_no, round(sim, 6) AS similarity FROM ws")
def word_similarity(spark, d):
    return _facing(spark, d).select("pair_id", "line_no", F.round(sim.word_similarity("old_line", "new_line"), 6).alias("similarity"))


#: Edit rows of edited documents, with the blocks of changed ones.
EDITS = f"""{EDITED}, ez AS (SELECT o.pair_id AS id, o.a, coalesce(n.b, []) AS b FROM (SELECT pair_id, list(line ORDER BY line_no) AS a FROM ol GROUP BY 1) o LEFT JOIN (SELECT pair_id, list(line ORDER BY line_no) AS b FROM nl GROUP BY 1) n USING (pair_id)), {script_sql('ez', 'es')},
  er AS (SELECT id AS pair_id, '=' AS op, CAST(i - 1 AS INTEGER) AS old_no, CAST(j - 1 AS INTEGER) AS new_no FROM esm UNION ALL SELECT pair_id, '-', line_no, NULL FROM ol WHERE (pair_id, line_no + 1) NOT IN (SELECT (id, i) FROM esm) UNION ALL SELECT pair_id, '+', NULL, line_no FROM nl WHERE (pair_id, line_no + 1) NOT IN (SELECT (id, j) FROM esm)),
  eo AS (SELECT *, max(old_no) FILTER (op = '=') OVER (PARTITION BY pair_id ORDER BY coalesce(old_no, -1) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo FROM er WHERE op <> '+'),
  ep AS (SELECT *, max(new_no) FILTER (op = '=') OVER (PARTITION BY pair_id ORDER BY coalesce(new_no, -1) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ln FROM er WHERE op <> '-'),
  eq AS (SELECT pair_id, old_no AS o, new_no AS n, row_number() OVER (PARTITION BY pair_id ORDER BY old_no) AS block_id FROM er WHERE op = '='),
  eu AS (SELECT x.pair_id, op, old_no, new_no, coalesce(q.block_id, 0) AS block_id FROM eo x LEFT JOIN eq q ON q.pair_id = x.pair_id AND q.o = x.lo WHERE op = '-' UNION ALL SELECT x.pair_id, op, old_no, new_no, coalesce(q.block_id, 0) FROM ep x LEFT JOIN eq q ON q.pair_id = x.pair_id AND q.n = x.ln WHERE op = '+' UNION ALL SELECT pair_id, '=', o, n, block_id - 1 FROM eq),
  ev AS MATERIALIZED (SELECT u.pair_id, CAST(row_number() OVER (PARTITION BY u.pair_id ORDER BY block_id, CASE op WHEN '-' THEN 0 WHEN '+' THEN 1 ELSE 2 END, coalesce(u.old_no, u.new_no)) - 1 AS INTEGER) AS seq, op, u.old_no, u.new_no, block_id, coalesce(o.line, n.line) AS line
    FROM eu u LEFT JOIN ol o ON o.pair_id = u.pair_id AND o.line_no = u.old_no LEFT JOIN nl n ON n.pair_id = u.pair_id AND n.line_no = u.new_no),
  eb AS MATERIALIZED (SELECT * FROM ev WHERE op <> '=')"""


@query(f"WITH RECURSIVE {EDITS} SELECT pair_id, seq, op, coalesce(old_no, -1) AS old_no, coalesce(new_no, -1) AS new_no, line FROM ev")
def edit_script_rows(spark, d):
    e = align.line_edits(src.edited_pairs(src.spread(_docs(spark, d).select("doc_id", "text"))))
    return e.select("pair_id", "seq", "op", F.coalesce("old_no", F.lit(-1)).alias("old_no"), F.coalesce("new_no", F.lit(-1)).alias("new_no"), "line")


def pairing_sql(rows: str, n: str) -> str:
    """{n}(pair_id, block_id, x, y, sim): the greedy pairing of removed and added lines of a block from a similarity of 0.5 on; lines whose signatures have less than 0.3 in common have no such similarity."""
    solid = "length(regexp_replace({0}, '\\s', '', 'g'))"
    return f"""{n}f AS MATERIALIZED (SELECT *, {TRIM.format('line')} AS bare, lower({TRIM.format('line')}) AS form FROM {rows}), {n}h AS (SELECT form, unnest(string_split(form, '')) AS c, generate_subscripts(string_split(form, ''), 1) AS i FROM (SELECT DISTINCT form FROM {n}f WHERE form <> '')),
  {n}i AS (SELECT form, CAST(unicode(c) AS BIGINT) AS a, CAST(unicode(lead(c) OVER (PARTITION BY form ORDER BY i)) AS BIGINT) AS b FROM {n}h), {n}j AS (SELECT form, bit_or(CAST(1 AS BIGINT) << CAST((31 * a + b) % 32 AS INTEGER)) AS sig FROM {n}i WHERE b IS NOT NULL GROUP BY 1),
  {n}l AS MATERIALIZED (SELECT f.*, coalesce(sig, 0) AS sig FROM {n}f f LEFT JOIN {n}j USING (form)),
  {n}p AS MATERIALIZED (SELECT row_number() OVER () AS id, a.pair_id, a.block_id, a.old_no, b.new_no, a.line AS x, b.line AS y FROM {n}l a JOIN {n}l b ON a.pair_id = b.pair_id AND a.block_id = b.block_id AND a.op = '-' AND b.op = '+'
    WHERE a.line = b.line OR (1 - bit_count(xor(a.sig, b.sig)) / 32.0 >= 0.3 AND 2 * (least(length(a.bare), {solid.format('b.line')} + length(a.bare) - {solid.format('a.line')}) + 2) >= 0.5 * (length(a.bare) + length(b.bare)))),
  {n}q AS (SELECT id, x, y FROM {n}p WHERE x <> y), {word_similarity_sql(n + 'q', n + 'v')},
  {n}o AS (SELECT pair_id, block_id, old_no AS x, new_no AS y, coalesce(sim, 1.0) AS sim FROM {n}p LEFT JOIN {n}v USING (id) WHERE coalesce(sim, 1.0) >= 0.5), {_greedy_sql(n + 'o', 'pair_id, block_id', 'sim DESC, x, y', n)}"""


@query(f"WITH RECURSIVE {EDITS}, {pairing_sql('eb', 'sp')} SELECT pair_id, block_id, x AS old_no, y AS new_no, round(sim, 6) AS sim FROM sp")
def similarity_pairs(spark, d):
    b = written(align.change_blocks(align.line_edits(src.edited_pairs(src.spread(_docs(spark, d).select("doc_id", "text"))))), "blocks")
    x = matching.greedy_pairs(matching.candidates(b, least=0.5), 0.5)
    return x.withColumn("sim", F.round("sim", 6))


@query(f"WITH RECURSIVE {EDITS}, {block_moves_sql('eb')} SELECT pair_id, start_old, start_new, size FROM bm")
def block_moves(spark, d):
    return matching.block_moves(written(align.change_blocks(align.line_edits(src.edited_pairs(src.spread(_docs(spark, d).select("doc_id", "text"))))), "blocks"))


def _without(rows: str, pairs: str, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT * FROM {rows} r WHERE NOT EXISTS (SELECT 1 FROM {pairs} p WHERE p.pair_id = r.pair_id AND (p.x = r.old_no OR p.y = r.new_no)))"


FULL = f"""{EDITS}, {block_moves_sql('eb')}, c1 AS MATERIALIZED (SELECT pair_id, CAST(start_old + k AS INTEGER) AS x, CAST(start_new + k AS INTEGER) AS y FROM (SELECT *, unnest(range(0, size)) AS k FROM bm WHERE size >= 2)), {_without('eb', 'c1', 'b1')},
  {pairing_sql('b1', 'fp')}, {_without('b1', 'fp', 'b2')},
  c3 AS (SELECT pair_id, line, op, block_id, coalesce(old_no, new_no) AS no, row_number() OVER (PARTITION BY pair_id, line, op ORDER BY coalesce(old_no, new_no)) AS n FROM b2 WHERE {TRIM.format('line')} <> ''),
  fe AS MATERIALIZED (SELECT a.pair_id, a.no AS x, b.no AS y FROM c3 a JOIN c3 b ON a.pair_id = b.pair_id AND a.line = b.line AND a.n = b.n AND a.op = '-' AND b.op = '+' WHERE a.block_id <> b.block_id), {_without('b2', 'fe', 'b3')},
  {fast_similarity_sql('b3')}, fz AS (SELECT pair_id, x, y, sim FROM fx WHERE sim >= 0.5), {_greedy_sql('fz', 'pair_id', 'sim DESC, x, y', 'fg')}, {_without('b3', 'fg', 'b4')},
  fh AS (SELECT pair_id, x, y, 'block-moved' AS classification, 1.0 AS similarity FROM c1 UNION ALL SELECT pair_id, x, y, 'modified', sim FROM fp UNION ALL SELECT pair_id, x, y, 'moved', 1.0 FROM fe UNION ALL SELECT pair_id, x, y, CASE WHEN sim >= 0.9 THEN 'moved' ELSE 'modified' END, sim FROM fg),
  full_rows AS (SELECT h.pair_id, least(a.seq, b.seq) AS seq, classification, h.x AS old_no, h.y AS new_no, a.line AS removed_line, b.line AS added_line, similarity FROM fh h JOIN eb a ON a.pair_id = h.pair_id AND a.old_no = h.x JOIN eb b ON b.pair_id = h.pair_id AND b.new_no = h.y
    UNION ALL SELECT pair_id, seq, CASE op WHEN '-' THEN 'removed' ELSE 'added' END, old_no, new_no, CASE WHEN op = '-' THEN line END, CASE WHEN op = '+' THEN line END, NULL FROM b4 UNION ALL SELECT pair_id, seq, 'unchanged', old_no, new_no, line, line, 1.0 FROM ev WHERE op = '=')"""


@query(f"WITH RECURSIVE {FULL} SELECT pair_id, seq, classification, coalesce(old_no, -1) AS old_no, coalesce(new_no, -1) AS new_no, removed_line, added_line, round(coalesce(similarity, -1), 6) AS similarity FROM full_rows")
def full_diff_rows(spark, d):
    return _full(spark, d).select("pair_id", "seq", "classification", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("old_no", "new_no")), "removed_line", "added_line", F.round(F.coalesce("similarity", F.lit(-1.0)), 6).alias("similarity"))


@query(f"WITH RECURSIVE {FULL} SELECT pair_id, count(*) AS total_changes, count(*) FILTER (classification = 'added') AS added, count(*) FILTER (classification = 'removed') AS removed, count(*) FILTER (classification = 'modified') AS modified, count(*) FILTER (classification IN ('moved', 'block-moved')) AS moved, count(*) FILTER (classification = 'unchanged') AS unchanged FROM full_rows GROUP BY 1")
def full_diff_stats(spark, d):
    return cmp.stats(_full(spark, d))


@query(f"WITH RECURSIVE {_LISTS}, fk AS (SELECT pair_id * 100000 + line_no AS id, x, y FROM fc), {word_similarity_sql('fk', 'ws')} SELECT pair_id, line_no, round(0.7 * least(1.0, 0.55 * normalized + 0.25 * keyword + 0.15 * identifier + 0.05 * raw) + 0.3 * sim, 6) AS similarity FROM jc JOIN ws ON ws.id = pair_id * 100000 + line_no")
def enhanced_similarity(spark, d):
    mixed = 0.7 * token_line_similarity("old_line", "new_line") + 0.3 * sim.word_similarity("old_line", "new_line")
    # rounded as SQL does: of the product with 10^6, not of the decimal digits, which differ where a digit 5 is the last
    return _facing(spark, d).select("pair_id", "line_no", (F.round(mixed * 1e6, 0) / 1e6).alias("similarity"))


@query()
def tree_similarity(spark, d):
    """With the similarity of syntax trees, where both lines have one."""
    x = _facing(spark, d).withColumn("tree", ast_similarity("old_line", "new_line")).where("tree is not null")
    return x.select("pair_id", "line_no", F.round("tree", 6).alias("tree"), ast_signature("old_line").alias("old_tree"), F.round(full_similarity(sim.word_similarity("old_line", "new_line"), F.col("tree")), 6).alias("similarity"))
