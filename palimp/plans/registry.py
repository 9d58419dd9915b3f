"""All queries of the comparison engine by name, and the SQL that must give the same rows.

Every query runs over its whole table. Edited documents (sources.pairs) give old and new lines; the positional alignment sets lines with the same number against each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimp.config import Options
from palimp.functions import language as lang
from palimp.functions import signature as sig
from palimp.functions import similarity as sim
from palimp.functions import text as txt
from palimp.functions.edit import char_diff, word_diff
from palimp.functions.tokens import tokens_of_texts
from palimp.operators import align, export, late_moves, lsh, matching, sliders
from palimp.plans import compare as cmp
from palimp.sources import pairs as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DOC_LINES = "dl AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
OLD = "ol AS (SELECT doc_id AS pair_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) WHERE len(l) >= 10)"
NEW = """nl AS (SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY (o < 3), o, copy) - 1 AS INTEGER) AS line_no, line FROM
  (SELECT pair_id, line_no AS o, copy, CASE WHEN line_no % 5 = 4 THEN line || ' edited' ELSE line END AS line FROM ol, (VALUES (0), (1)) AS c(copy) WHERE line_no % 7 <> 3 AND (copy = 0 OR line_no % 11 = 4)))"""
EDITED = f"{OLD}, {NEW}"
POSITIONAL = f"""{EDITED}, po AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.line_no, b.line_no) AS no, a.line AS x, b.line AS y FROM ol a FULL JOIN nl b ON a.pair_id = b.pair_id AND a.line_no = b.line_no),
  pe AS (SELECT pair_id, 2 * no AS seq, '=' AS op, no AS old_no, no AS new_no, x AS line FROM po WHERE x = y UNION ALL SELECT pair_id, 2 * no, '-', no, NULL, x FROM po WHERE x IS NOT NULL AND x IS DISTINCT FROM y
         UNION ALL SELECT pair_id, 2 * no + 1, '+', NULL, no, y FROM po WHERE y IS NOT NULL AND x IS DISTINCT FROM y),
  pb AS (SELECT * FROM (SELECT *, CAST(sum(CASE WHEN op = '=' THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY seq) AS BIGINT) AS block_id FROM pe) WHERE op <> '=')"""
TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
CHARS = f"""{DOC_LINES}, nf AS (SELECT doc_id, line_no, lower({TRIM.format('line')}) AS t FROM dl), ch AS (SELECT doc_id, line_no, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM nf WHERE t <> ''),
  bg AS (SELECT doc_id, line_no, CAST(unicode(c) AS BIGINT) AS a, CAST(unicode(lead(c) OVER (PARTITION BY doc_id, line_no ORDER BY i)) AS BIGINT) AS b FROM ch),
  sg AS (SELECT doc_id, line_no, coalesce(s, 0) AS sig, coalesce(h, 0) AS bits FROM nf LEFT JOIN (SELECT doc_id, line_no, bit_or(CAST(1 AS BIGINT) << CAST((31 * a + b) % 32 AS INTEGER)) AS s,
    bit_or((CAST(1 AS BIGINT) << CAST((31 * a + b) % 32 AS INTEGER)) | (CAST(1 AS BIGINT) << CAST((37 * b + a) % 32 AS INTEGER)) | (CAST(1 AS BIGINT) << CAST((a * b * 17) % 32 AS INTEGER)) | (CAST(1 AS BIGINT) << CAST((a + b) % 32 AS INTEGER))) AS h
    FROM bg WHERE b IS NOT NULL GROUP BY 1, 2) USING (doc_id, line_no)),
  hs AS (SELECT doc_id, line_no, reverse(lpad(bin(bits), 32, '0')) AS hash FROM sg)"""


def query(oracle: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return register


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "documents")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return src.explode_lines(_docs(spark, d), "doc_id", "text")


def _spread_lines(spark: SparkSession, d: str) -> DataFrame:
    return src.explode_lines(src.spread(_docs(spark, d).select("doc_id", "text")), "doc_id", "text")


def _edited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return src.edited_lines(_docs(spark, d))


def positional(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edit rows of the alignment by number."""
    x = export.side_by_side(old, new)
    a, b, n = F.col("old_line"), F.col("new_line"), F.col("line_no")
    none = F.lit(None).cast("int")
    same = x.where(a == b).select("pair_id", (2 * n).alias("seq"), F.lit("=").alias("op"), n.alias("old_no"), n.alias("new_no"), a.alias("line"))
    gone = x.where(a.isNotNull() & ~a.eqNullSafe(b)).select("pair_id", (2 * n).alias("seq"), F.lit("-").alias("op"), n.alias("old_no"), none.alias("new_no"), a.alias("line"))
    come = x.where(b.isNotNull() & ~a.eqNullSafe(b)).select("pair_id", (2 * n + 1).alias("seq"), F.lit("+").alias("op"), none.alias("old_no"), n.alias("new_no"), b.alias("line"))
    return same.union(gone).union(come)


def _positional(spark: SparkSession, d: str) -> DataFrame:
    return positional(*_edited(spark, d))


def _facing(spark: SparkSession, d: str) -> DataFrame:
    return export.side_by_side(*_edited(spark, d)).where("old_line is not null and new_line is not null")


def _full(spark: SparkSession, d: str) -> DataFrame:
    return cmp.compare(src.edited_pairs(src.spread(_docs(spark, d).select("doc_id", "text"))))


# sources and guards


@query(f"WITH {DOC_LINES} SELECT doc_id, line_no, line FROM dl")
def line_explode(spark, d):
    return _lines(spark, d)


@query("SELECT conv_id, turn, old_text, new_text FROM (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old_text, text AS new_text FROM conversations) WHERE old_text IS NOT NULL")
def turn_pairs(spark, d):
    return src.turn_pairs(src.table(spark, d, "conversations"))


@query(f"""WITH {DOC_LINES}, n AS (SELECT doc_id, count(*) AS n FROM dl GROUP BY 1), g AS (SELECT DISTINCT doc_id, line FROM dl WHERE length(line) > 20), r AS (SELECT line FROM g GROUP BY 1 HAVING count(*) >= 2),
  k AS (SELECT g.* FROM g JOIN r USING (line)), c AS (SELECT a.doc_id AS a_id, b.doc_id AS b_id, count(*) AS common FROM k a JOIN k b ON a.line = b.line AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a_id, b_id, common FROM c JOIN n x ON x.doc_id = a_id JOIN n y ON y.doc_id = b_id WHERE common / greatest(x.n, y.n) >= 0.3""")
def near_copy_pairs(spark, d):
    return src.near_copy_pairs(_docs(spark, d))


@query(f"WITH {EDITED} SELECT pair_id, line_no, line FROM nl")
def edited_new_lines(spark, d):
    return _edited(spark, d)[1]


@query(f"WITH {EDITED} SELECT pair_id, string_agg(line, chr(10) ORDER BY line_no) AS new_text FROM nl GROUP BY 1")
def edited_new_texts(spark, d):
    return src.edited_pairs(_docs(spark, d)).select("pair_id", "new_text")


@query("SELECT doc_id, regexp_matches(substr(text, 1, 1000), '[^\\x20-\\x7E\\s]') AS is_binary, strlen(text) > 10000 AS is_large FROM documents")
def input_guards(spark, d):
    return _docs(spark, d).select("doc_id", txt.looks_binary(F.col("text")).alias("is_binary"), txt.too_large(F.col("text"), 10000).alias("is_large"))


# normalisation


@query(f"WITH {DOC_LINES}, t AS (SELECT doc_id, line_no, regexp_replace({TRIM.format('line')}, '\\s+', ' ', 'g') AS t FROM dl) SELECT doc_id, coalesce(string_agg(t, chr(10) ORDER BY line_no) FILTER (t <> ''), '') AS text FROM t GROUP BY 1")
def normalize_ws(spark, d):
    return _docs(spark, d).select("doc_id", txt.normalize_whitespace(F.col("text")).alias("text"))


_MARKS = {"round_open": "(", "round_close": ")", "square_open": "[", "square_close": "]", "curly_open": "{", "curly_close": "}", "angle_open": "<", "angle_close": ">"}


@query("SELECT page_id, " + ", ".join(f"CAST(length(html) - length(replace(html, '{m}', '')) AS INTEGER) AS {n}" for n, m in _MARKS.items()) + " FROM pages")
def delimiter_counts(spark, d):
    return src.table(spark, d, "pages").select("page_id", *(txt.count_delimiters(F.col("html"), m).alias(n) for n, m in _MARKS.items()))


def _squeeze_sql(c: str) -> str:
    for m in "()[]{}<>":
        c = f"regexp_replace({c}, '\\s*\\{m}\\s*', '{m}', 'g')"
    return c


@query(f"SELECT page_id, {_squeeze_sql('html')} AS html FROM pages")
def normalize_delims_simple(spark, d):
    return src.table(spark, d, "pages").select("page_id", txt.squeeze_delimiters(F.col("html")).alias("html"))


# signatures and hashes


@query(f"WITH {CHARS} SELECT doc_id, line_no, sig FROM sg")
def line_signature(spark, d):
    # for a scan of all lines, the Arrow form of the signature, which takes a fourth of the time of the native one
    return _spread_lines(spark, d).select("doc_id", "line_no", sig.form_signature(txt.normal_form(F.col("line"))).alias("sig"))


@query(f"WITH {CHARS} SELECT doc_id, line_no, sig FROM sg")
def line_signature_native(spark, d):
    return _spread_lines(spark, d).select("doc_id", "line_no", sig.line_signature(F.col("line")).alias("sig"))


@query(f"WITH {CHARS}, l AS (SELECT doc_id, line_no, sig, lag(sig) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM sg) SELECT doc_id, line_no, round(1 - bit_count(xor(sig, p)) / 32.0, 6) AS similarity FROM l WHERE p IS NOT NULL")
def signature_similarity(spark, d):
    w = Window.partitionBy("doc_id").orderBy("line_no")
    x = line_signature(spark, d).withColumn("p", F.lag("sig").over(w)).where("p is not null")
    return x.select("doc_id", "line_no", F.round(sig.signature_similarity(F.col("sig"), F.col("p")), 6).alias("similarity"))


@query(f"WITH {CHARS}, w AS (SELECT doc_id, line_no, sig AS a, lead(sig) OVER (PARTITION BY doc_id ORDER BY line_no) AS b, lead(sig, 2) OVER (PARTITION BY doc_id ORDER BY line_no) AS c FROM sg) SELECT doc_id, line_no, (((a % 4294967296) * 31 + b) % 4294967296 * 31 + c) % 4294967296 AS signature FROM w WHERE c IS NOT NULL")
def block_signatures(spark, d):
    return align.block_signatures(line_signature(spark, d).withColumnRenamed("doc_id", "pair_id"), "sig").withColumnRenamed("pair_id", "doc_id")


def _hashes(spark, d):
    return _spread_lines(spark, d).select("doc_id", "line_no", sig.content_hash(F.col("line")).alias("hash"))


@query(f"WITH {CHARS} SELECT doc_id, line_no, hash FROM hs")
def content_hash(spark, d):
    return _hashes(spark, d)


@query(f"WITH {CHARS}, l AS (SELECT doc_id, line_no, bits, lag(bits) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM sg) SELECT doc_id, line_no, round(1 - bit_count(xor(bits, p)) / 32.0, 6) AS similarity FROM l WHERE p IS NOT NULL")
def content_hash_similarity(spark, d):
    w = Window.partitionBy("doc_id").orderBy("line_no")
    x = _hashes(spark, d).withColumn("p", F.lag("hash").over(w)).where("p is not null")
    return x.select("doc_id", "line_no", F.round(sig.compare_hashes(F.col("hash"), F.col("p")), 6).alias("similarity"))


@query(f"""WITH RECURSIVE lo(k, v) AS (SELECT 0, CAST(1 AS HUGEINT) UNION ALL SELECT k + 1, v * 33 % 4294967296 FROM lo WHERE k < 255), hi(k, v) AS (SELECT 0, CAST(1 AS HUGEINT) UNION ALL SELECT k + 1, v * (SELECT v * 33 % 4294967296 FROM lo WHERE k = 255) % 4294967296 FROM hi WHERE k < 4095),
  {DOC_LINES}, c AS (SELECT doc_id, line_no, unicode(unnest(string_split(line, ''))) AS c, len(string_split(line, '')) - generate_subscripts(string_split(line, ''), 1) AS e, len(string_split(line, '')) AS n FROM dl WHERE line <> '')
SELECT doc_id, line_no, CAST(0 AS BIGINT) AS hash FROM dl WHERE line = '' UNION ALL
SELECT doc_id, line_no, CAST((sum(c * (lo.v * hi.v % 4294967296)) + 5381 * (SELECT a.v * b.v % 4294967296 FROM lo a, hi b WHERE a.k = any_value(n) % 256 AND b.k = any_value(n) // 256)) % 4294967296 AS BIGINT) AS hash
FROM c JOIN lo ON lo.k = e % 256 JOIN hi ON hi.k = e // 256 GROUP BY doc_id, line_no""")
def djb2_hash(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", sig.djb2(F.col("line")).alias("hash"))


@query(f"WITH {CHARS} SELECT doc_id, line_no, CAST(b AS INTEGER) AS band, substr(hash, 4 * b + 1, 4) AS value FROM hs, (SELECT unnest(range(8)) AS b)")
def lsh_buckets(spark, d):
    x = _hashes(spark, d).withColumn("b", F.explode(sig.bands(F.col("hash"))))
    return x.select("doc_id", "line_no", "b.band", "b.value")


@query(f"""WITH {CHARS}, k AS (SELECT doc_id, line_no, hash, bits, b, substr(hash, 4 * b + 1, 4) AS v FROM hs JOIN sg USING (doc_id, line_no), (SELECT unnest(range(8)) AS b)),
  p AS (SELECT DISTINCT x.doc_id, x.line_no AS a, y.line_no AS b, x.bits AS p, y.bits AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.b = y.b AND x.v = y.v AND x.line_no < y.line_no)
SELECT doc_id, a, b, round(1 - bit_count(xor(p, q)) / 32.0, 6) AS similarity FROM p WHERE 1 - bit_count(xor(p, q)) / 32.0 >= 0.9""")
def lsh_candidates(spark, d):
    x = lsh.lsh_candidates(_hashes(spark, d), "doc_id", "line_no")
    return x.withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {DOC_LINES} SELECT count(*) AS total, count(DISTINCT line) AS misses, count(*) - count(DISTINCT line) AS hits FROM dl")
def hash_cache_stats(spark, d):
    by = _lines(spark, d).groupBy("line").agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("total"), F.count("*").alias("misses"), (F.sum("n") - F.count("*")).alias("hits"))


# similarity of facing lines

_FACING = f"{EDITED}, fc AS (SELECT pair_id, a.line_no, a.line AS x, b.line AS y, lower({TRIM.format('a.line')}) AS p, lower({TRIM.format('b.line')}) AS q FROM ol a JOIN nl b USING (pair_id, line_no))"
_WORDS = f"""{_FACING}, wa AS (SELECT pair_id, line_no, unnest(regexp_split_to_array(p, '\\s+')) AS w FROM fc), wb AS (SELECT pair_id, line_no, unnest(regexp_split_to_array(q, '\\s+')) AS w FROM fc),
  na AS (SELECT pair_id, line_no, count(*) AS n, count(DISTINCT w) AS u FROM wa WHERE w <> '' GROUP BY 1, 2), nb AS (SELECT pair_id, line_no, count(*) AS n, count(DISTINCT w) AS u FROM wb WHERE w <> '' GROUP BY 1, 2),
  cm AS (SELECT pair_id, line_no, count(*) AS n, count(DISTINCT w) AS u FROM wb WHERE w <> '' AND (pair_id, line_no, w) IN (SELECT (pair_id, line_no, w) FROM wa) GROUP BY 1, 2),
  st AS (SELECT fc.*, coalesce(na.n, 0) AS a, coalesce(nb.n, 0) AS b, coalesce(cm.n, 0) AS c, coalesce(na.u, 0) AS ua, coalesce(nb.u, 0) AS ub, coalesce(cm.u, 0) AS uc FROM fc LEFT JOIN na USING (pair_id, line_no) LEFT JOIN nb USING (pair_id, line_no) LEFT JOIN cm USING (pair_id, line_no))"""


@query(f"""WITH {_WORDS}, ca AS (SELECT pair_id, line_no, unnest(string_split(p, '')) AS c, generate_subscripts(string_split(p, ''), 1) AS i FROM fc WHERE length(p) < 50 AND length(q) < 50), cb AS (SELECT pair_id, line_no, unnest(string_split(q, '')) AS c, generate_subscripts(string_split(q, ''), 1) AS i FROM fc WHERE length(p) < 50 AND length(q) < 50),
  eq AS (SELECT pair_id, line_no, count(*) AS n FROM ca JOIN cb USING (pair_id, line_no, i, c) GROUP BY 1, 2)
SELECT pair_id, line_no, round(CASE WHEN p = q THEN 1 WHEN p = '' OR q = '' THEN 0 ELSE least(1, 0.0001 + CASE WHEN greatest(length(p), length(q)) < 50 THEN coalesce(eq.n, 0) / greatest(length(p), length(q)) ELSE 2 * c / greatest(a + b, 1) END) END, 6) AS similarity FROM st LEFT JOIN eq USING (pair_id, line_no)""")
def fast_line_similarity(spark, d):
    return _facing(spark, d).select("pair_id", "line_no", F.round(sim.fast_line_similarity(F.col("old_line"), F.col("new_line")), 6).alias("similarity"))


@query(f"WITH {_WORDS} SELECT pair_id, line_no, round(CASE WHEN x = y THEN 1 WHEN p = q THEN 0.95 WHEN a = 0 OR b = 0 THEN 0 ELSE 2 * c / (a + b) END, 6) AS similarity FROM st")
def patience_similarity(spark, d):
    return _facing(spark, d).select("pair_id", "line_no", F.round(sim.patience_similarity(F.col("old_line"), F.col("new_line")), 6).alias("similarity"))


@query(f"WITH {_WORDS} SELECT pair_id, line_no, round(CASE WHEN ua + ub = 0 THEN 1 ELSE uc / (ua + ub - uc) END, 6) AS similarity FROM st")
def jaccard_words(spark, d):
    return _facing(spark, d).select("pair_id", "line_no", F.round(sim.jaccard(sim.word_set(F.col("old_line")), sim.word_set(F.col("new_line"))), 6).alias("similarity"))


def _sum_sql(c: str, both: str | None = None) -> str:
    return " + ".join(f"CAST(contains({c}, '{k}')" + (f" AND contains({both}, '{k}')" if both else "") + " AS INTEGER)" for k in sim.QUICK_KEYWORDS)


@query(f"""WITH {_FACING}, n AS (SELECT pair_id, line_no, regexp_replace(p, '\\s+', ' ', 'g') AS p, regexp_replace(q, '\\s+', ' ', 'g') AS q FROM fc),
  k AS (SELECT *, {_sum_sql('p')} AS a, {_sum_sql('q')} AS b, {_sum_sql('p', 'q')} AS c, length(regexp_replace(p, '[^(){{}}\\[\\];,]', '', 'g')) AS da, length(regexp_replace(q, '[^(){{}}\\[\\];,]', '', 'g')) AS db FROM n)
SELECT pair_id, line_no, round(CASE WHEN p = q THEN 1 WHEN p = '' OR q = '' THEN 0 ELSE 0.5 * (CASE WHEN a + b > 0 THEN 2 * c / (a + b) ELSE 1 END) + 0.3 * (1 - abs(da - db) / greatest(da, db, 1)) + 0.2 END, 6) AS similarity FROM k""")
def quick_token_similarity(spark, d):
    return _facing(spark, d).select("pair_id", "line_no", F.round(sim.quick_token_similarity(F.col("old_line"), F.col("new_line")), 6).alias("similarity"))


@query(f"""WITH p AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS o, text AS n FROM conversations), v AS (SELECT * FROM p WHERE o IS NOT NULL),
  a AS (SELECT conv_id, turn, {TRIM.format('unnest(string_split(o, chr(10)))')} AS l FROM v), b AS (SELECT conv_id, turn, {TRIM.format('unnest(string_split(n, chr(10)))')} AS l FROM v),
  ca AS (SELECT conv_id, turn, l, count(*) AS n FROM a WHERE l <> '' GROUP BY ALL), cb AS (SELECT conv_id, turn, l, count(*) AS n FROM b WHERE l <> '' GROUP BY ALL),
  c AS (SELECT conv_id, turn, sum(least(ca.n, cb.n)) AS n FROM ca JOIN cb USING (conv_id, turn, l) GROUP BY ALL), sa AS (SELECT conv_id, turn, sum(n) AS n FROM ca GROUP BY ALL), sb AS (SELECT conv_id, turn, sum(n) AS n FROM cb GROUP BY ALL)
SELECT v.conv_id, v.turn, round(CASE WHEN greatest(coalesce(sa.n, 0), coalesce(sb.n, 0)) = 0 THEN 0 ELSE coalesce(c.n, 0) / greatest(coalesce(sa.n, 0), coalesce(sb.n, 0)) END, 6) AS similarity FROM v LEFT JOIN c USING (conv_id, turn) LEFT JOIN sa USING (conv_id, turn) LEFT JOIN sb USING (conv_id, turn)""")
def content_block_similarity(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", F.round(sim.block_similarity(F.col("old_text"), F.col("new_text")), 6).alias("similarity"))


# alignment


@query(f"WITH {EDITED}, a AS (SELECT pair_id, line, min(line_no) AS old_no FROM ol GROUP BY 1, 2 HAVING count(*) = 1), b AS (SELECT pair_id, line, min(line_no) AS new_no FROM nl GROUP BY 1, 2 HAVING count(*) = 1) SELECT pair_id, old_no, new_no, line FROM a JOIN b USING (pair_id, line)")
def unique_anchors(spark, d):
    return align.unique_anchors(*_edited(spark, d))


_ANCHORS = f"{EDITED}, a AS (SELECT pair_id, line, min(line_no) AS old_no FROM ol GROUP BY 1, 2 HAVING count(*) = 1), b AS (SELECT pair_id, line, min(line_no) AS new_no FROM nl GROUP BY 1, 2 HAVING count(*) = 1), an AS (SELECT pair_id, old_no, new_no FROM a JOIN b USING (pair_id, line))"


_LIS = f"""WITH RECURSIVE {_ANCHORS}, r AS (SELECT pair_id, new_no, row_number() OVER (PARTITION BY pair_id ORDER BY old_no) AS i FROM an), m AS (SELECT pair_id, max(i) AS n FROM r GROUP BY 1),
  dp(pair_id, i, best) AS (SELECT pair_id, CAST(0 AS BIGINT), CAST([] AS INTEGER[]) FROM m UNION ALL
    SELECT dp.pair_id, dp.i + 1, CASE WHEN len(list_where(best, list_transform(best, lambda x: x >= new_no))) = 0 THEN list_append(best, new_no) ELSE list_concat(list_append(list_slice(best, 1, len(best) - len(list_filter(best, lambda x: x >= new_no))), new_no), list_slice(best, len(best) - len(list_filter(best, lambda x: x >= new_no)) + 2, len(best))) END
    FROM dp JOIN r ON r.pair_id = dp.pair_id AND r.i = dp.i + 1)"""


@query(f"{_LIS} SELECT pair_id, CAST(len(best) AS BIGINT) AS length FROM dp JOIN m USING (pair_id) WHERE i = n")
def lis_length(spark, d):
    return align.increasing_anchors(unique_anchors(spark, d)).groupBy("pair_id").agg(F.count("*").alias("length"))


@query(f"""WITH {POSITIONAL}, s AS (SELECT pair_id, CAST((SELECT count(*) FROM ol o WHERE o.pair_id = p.pair_id) AS INTEGER) AS a, CAST((SELECT count(*) FROM nl o WHERE o.pair_id = p.pair_id) AS INTEGER) AS b FROM (SELECT DISTINCT pair_id FROM ol) p),
  k AS (SELECT pair_id, old_no, new_no FROM pe WHERE op = '=' UNION ALL SELECT pair_id, a, b FROM s),
  l AS (SELECT pair_id, coalesce(lag(old_no) OVER w, -1) + 1 AS old_start, old_no AS old_end, coalesce(lag(new_no) OVER w, -1) + 1 AS new_start, new_no AS new_end FROM k WINDOW w AS (PARTITION BY pair_id ORDER BY old_no, new_no))
SELECT pair_id, old_start, old_end, new_start, new_end FROM l WHERE old_start < old_end OR new_start < new_end""")
def changed_regions(spark, d):
    old, new = _edited(spark, d)
    count = lambda df, c: df.groupBy("pair_id").agg(F.count("*").cast("int").alias(c))
    same = positional(old, new).where("op = '='").select("pair_id", "old_no", "new_no")
    return align.changed_regions(same, count(old, "n_old").join(count(new, "n_new"), "pair_id"))


@query(f"WITH {POSITIONAL} SELECT pair_id, block_id, count(*) FILTER (op = '-') AS n_removed, count(*) FILTER (op = '+') AS n_added FROM pb GROUP BY 1, 2")
def change_blocks(spark, d):
    return align.change_blocks(_positional(spark, d)).groupBy("pair_id", "block_id").agg(F.count_if(F.col("op") == "-").alias("n_removed"), F.count_if(F.col("op") == "+").alias("n_added"))


@query(f"{_LIS}, u AS (SELECT pair_id, len(best) AS k FROM dp JOIN m USING (pair_id) WHERE i = n), x AS (SELECT pair_id, count(*) AS a FROM ol GROUP BY 1), y AS (SELECT pair_id, count(*) AS b FROM nl GROUP BY 1) SELECT pair_id, CAST(coalesce(k, 0) AS BIGINT) AS unchanged, CAST(a - coalesce(k, 0) AS BIGINT) AS removed, CAST(b - coalesce(k, 0) AS BIGINT) AS added FROM x JOIN y USING (pair_id) LEFT JOIN u USING (pair_id)")
def patience_stats(spark, d):
    n = lambda op: F.count_if(F.col("op") == op)
    return align.patience_rows(*_edited(spark, d)).groupBy("pair_id").agg(n("=").alias("unchanged"), n("-").alias("removed"), n("+").alias("added"))


@query(f"WITH {EDITED} SELECT pair_id, line_no, line FROM nl")
def patience_keeps_new(spark, d):
    return align.patience_rows(*_edited(spark, d)).where("op != '-'").select("pair_id", F.col("new_no").alias("line_no"), "line")


@query(f"WITH {POSITIONAL} SELECT pair_id, count(*) AS entries, count(*) FILTER (op = '=') AS unchanged, count(*) FILTER (op = '-') AS removed, count(*) FILTER (op = '+') AS added, count(*) FILTER ({TRIM.format('line')} <> '') AS not_blank FROM pe GROUP BY 1")
def content_stats(spark, d):
    n = lambda op: F.count_if(F.col("op") == op).alias({"=": "unchanged", "-": "removed", "+": "added"}[op])
    return _positional(spark, d).groupBy("pair_id").agg(F.count("*").alias("entries"), n("="), n("-"), n("+"), F.count_if(txt.trimmed(F.col("line")) != "").alias("not_blank"))


@query(f"""WITH {_ANCHORS}, s AS (SELECT pair_id, new_no - old_no AS shift, old_no, new_no, new_no - row_number() OVER (PARTITION BY pair_id, new_no - old_no ORDER BY new_no) AS g FROM an WHERE abs(new_no - old_no) >= 2)
SELECT pair_id, shift, min(old_no) AS start_old, min(new_no) AS start_new, count(*) AS size FROM s GROUP BY pair_id, shift, g""")
def shifted_unchanged(spark, d):
    return align.shifted_stretches(unique_anchors(spark, d))


@query(f"""WITH {EDITED}, c AS (SELECT pair_id, o.line_no AS i, n.line_no AS j, i - j AS dd FROM ol o JOIN nl n USING (pair_id, line)), s AS (SELECT *, i - row_number() OVER (PARTITION BY pair_id, dd ORDER BY i) AS g FROM c)
SELECT pair_id, min(i) AS start_old, min(j) AS start_new, count(*) AS size FROM s GROUP BY pair_id, dd, g""")
def hash_block_runs(spark, d):
    return align.diagonal_runs(*_edited(spark, d))


@query(f"""WITH {EDITED}, t AS (SELECT pair_id, line_no, {TRIM.format('line')} AS t, 0 AS s FROM ol UNION ALL SELECT pair_id, line_no, {TRIM.format('line')}, 1 FROM nl),
  w AS (SELECT pair_id, s, line_no, list(t) OVER (PARTITION BY pair_id, s ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ws, min(length(t)) OVER (PARTITION BY pair_id, s ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m FROM t),
  k AS (SELECT pair_id, s, line_no, array_to_string(list_sort(ws), chr(10)) AS k FROM w WHERE len(ws) = 3 AND m >= 10)
SELECT a.pair_id, a.line_no AS start_old, min(b.line_no) AS start_new FROM k a JOIN k b ON a.pair_id = b.pair_id AND a.k = b.k AND a.s = 0 AND b.s = 1 GROUP BY 1, 2""")
def content_moves_3(spark, d):
    return align.content_windows(*_edited(spark, d), 3)


@query()
def node_moves(spark, d):
    pairs = src.edited_pairs(_docs(spark, d))
    return late_moves.node_moves(late_moves.text_nodes(pairs, text_col="old_text"), late_moves.text_nodes(pairs, text_col="new_text"))


@query(f"WITH {EDITED} SELECT pair_id, count(*) FILTER (k = '-') AS removed, count(*) FILTER (k = '+') AS added FROM (SELECT pair_id, '-' AS k FROM (SELECT pair_id, line FROM ol EXCEPT ALL SELECT pair_id, line FROM nl) UNION ALL SELECT pair_id, '+' FROM (SELECT pair_id, line FROM nl EXCEPT ALL SELECT pair_id, line FROM ol)) GROUP BY 1")
def diff_stats_multiset(spark, d):
    old, new = (x.select("pair_id", "line") for x in _edited(spark, d))
    both = old.withColumn("n", F.lit(1)).union(new.withColumn("n", F.lit(-1))).groupBy("pair_id", "line").agg(F.sum("n").alias("n")).where("n != 0")
    return both.groupBy("pair_id").agg(F.sum(F.greatest("n", F.lit(0))).alias("removed"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("added"))


@query(f"WITH {EDITED} SELECT pair_id, line_no, line FROM ol")
def diff_reconstructs_old(spark, d):
    e = align.line_edits(src.edited_pairs(src.spread(_docs(spark, d).select("doc_id", "text")))).where("op != '+'")
    return e.select("pair_id", (F.row_number().over(Window.partitionBy("pair_id").orderBy("seq")) - 1).alias("line_no"), "line")


@query(f"WITH {EDITED} SELECT pair_id, line_no, line FROM nl")
def diff_reconstructs_new(spark, d):
    e = align.line_edits(src.edited_pairs(src.spread(_docs(spark, d).select("doc_id", "text")))).where("op != '-'")
    return e.select("pair_id", (F.row_number().over(Window.partitionBy("pair_id").orderBy("seq")) - 1).alias("line_no"), "line")


# pairing, moves, classes


@query(f"""WITH {POSITIONAL}, c AS (SELECT a.pair_id, a.block_id, a.old_no, b.new_no, CASE WHEN a.line = b.line THEN 1.0 ELSE least(length(a.line), length(b.line)) / greatest(length(a.line), length(b.line), 1) END AS sim FROM pb a JOIN pb b ON a.pair_id = b.pair_id AND a.block_id = b.block_id AND a.op = '-' AND b.op = '+'),
  r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, block_id, old_no ORDER BY sim DESC, old_no, new_no) AS ra, row_number() OVER (PARTITION BY pair_id, block_id, new_no ORDER BY sim DESC, old_no, new_no) AS rb FROM c WHERE sim >= 0.5)
SELECT pair_id, block_id, old_no, new_no FROM r WHERE ra = 1 AND rb = 1""")
def mutual_best_pairs(spark, d):
    """Pairing windows, with the ratio of lengths as similarity."""
    b = align.change_blocks(_positional(spark, d))
    x = b.where("op = '-'").select("pair_id", "block_id", "old_no", F.col("line").alias("p")).join(b.where("op = '+'").select("pair_id", "block_id", "new_no", F.col("line").alias("q")), ["pair_id", "block_id"])
    score = F.when(F.col("p") == F.col("q"), 1.0).otherwise(F.least(F.length("p"), F.length("q")) / F.greatest(F.length("p"), F.length("q"), F.lit(1)))
    return matching.mutual_best(x.withColumn("sim", score), 0.5).select("pair_id", "block_id", "old_no", "new_no")


@query(f"""WITH {POSITIONAL}, r AS (SELECT pair_id, line, op, block_id, coalesce(old_no, new_no) AS no, row_number() OVER (PARTITION BY pair_id, line, op ORDER BY coalesce(old_no, new_no)) AS n FROM pb WHERE {TRIM.format('line')} <> '')
SELECT a.pair_id, a.no AS from_no, b.no AS to_no, a.block_id AS from_block, b.block_id AS to_block FROM r a JOIN r b ON a.pair_id = b.pair_id AND a.line = b.line AND a.n = b.n AND a.op = '-' AND b.op = '+' WHERE a.block_id <> b.block_id""")
def exact_line_moves(spark, d):
    return matching.exact_moves(align.change_blocks(_positional(spark, d)))


@query(f"""WITH {POSITIONAL}, g AS (SELECT pair_id, count(old_no) + count(new_no) AS lines, count(*) FILTER (op = '-') AS n_removed, count(*) FILTER (op = '+') AS n_added FROM pe GROUP BY 1)
SELECT pair_id, lines, n_removed, n_added, CASE WHEN lines > 50000 OR n_removed * n_added > 200 THEN 'fast' WHEN lines > 30 THEN 'two_pass' ELSE 'single_pass' END AS route FROM g""")
def complexity_route(spark, d):
    return cmp.complexity(_positional(spark, d), Options(max_pairs=200, two_pass_threshold=30))


@query(f"""WITH {POSITIONAL}, n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, block_id, op ORDER BY seq) AS k FROM pb), m AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, a.line IS NULL AS noa, b.line IS NULL AS nob FROM (SELECT * FROM n WHERE op = '-') a FULL JOIN (SELECT * FROM n WHERE op = '+') b ON a.pair_id = b.pair_id AND a.block_id = b.block_id AND a.k = b.k),
  r AS (SELECT pair_id, CASE WHEN noa THEN 'added' WHEN nob THEN 'removed' ELSE 'modified' END AS c FROM m UNION ALL SELECT pair_id, 'unchanged' FROM pe WHERE op = '=')
SELECT pair_id, count(*) AS total_changes, count(*) FILTER (c = 'added') AS added, count(*) FILTER (c = 'removed') AS removed, count(*) FILTER (c = 'modified') AS modified, CAST(0 AS BIGINT) AS moved, count(*) FILTER (c = 'unchanged') AS unchanged FROM r GROUP BY 1""")
def fast_mode_stats(spark, d):
    return cmp.stats(cmp.classify_fast(_positional(spark, d)))


@query(f"WITH {EDITED} SELECT pair_id, line_no, line FROM ol")
def full_diff_keeps_old(spark, d):
    return _full(spark, d).where("old_no is not null").select("pair_id", F.col("old_no").alias("line_no"), F.col("removed_line").alias("line"))


@query(f"WITH {EDITED} SELECT pair_id, line_no, line FROM nl")
def full_diff_keeps_new(spark, d):
    return _full(spark, d).where("new_no is not null").select("pair_id", F.col("new_no").alias("line_no"), F.col("added_line").alias("line"))


@query(f"WITH {_ANCHORS}, x AS (SELECT pair_id, count(*) AS anchors FROM an GROUP BY 1), a1 AS (SELECT pair_id, count(*) AS n_old FROM ol GROUP BY 1), b1 AS (SELECT pair_id, count(*) AS n_new FROM nl GROUP BY 1) SELECT pair_id, n_old, n_new, coalesce(anchors, 0) AS anchors, coalesce(anchors, 0) = 0 OR 2 * coalesce(anchors, 0) / (n_old + n_new) < 0.05 AS fallback FROM a1 JOIN b1 USING (pair_id) LEFT JOIN x USING (pair_id)")
def two_pass_info(spark, d):
    old, new = _edited(spark, d)
    count = lambda df, c: df.groupBy("pair_id").agg(F.count("*").alias(c))
    x = count(old, "n_old").join(count(new, "n_new"), "pair_id").join(count(align.unique_anchors(old, new), "anchors"), "pair_id", "left").fillna(0, ["anchors"])
    return x.select("pair_id", "n_old", "n_new", "anchors", ((F.col("anchors") == 0) | (2 * F.col("anchors") / (F.col("n_old") + F.col("n_new")) < 0.05)).alias("fallback"))


# words, tokens, regions


@query("SELECT conv_id, turn, old_text, new_text FROM (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old_text, text AS new_text FROM conversations) WHERE old_text IS NOT NULL")
def char_diff_reconstructs(spark, d):
    x = turn_pairs(spark, d).withColumn("s", char_diff("old_text", "new_text"))
    side = lambda skip: F.array_join(F.transform(F.filter("s", lambda v: v["op"] != skip), lambda v: v["value"]), "")
    return x.select("conv_id", "turn", side("+").alias("old_text"), side("-").alias("new_text"))


@query("SELECT conv_id, turn, old_text FROM (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old_text FROM conversations) WHERE old_text IS NOT NULL")
def word_diff_reconstructs(spark, d):
    x = turn_pairs(spark, d).withColumn("s", word_diff("old_text", "new_text"))
    return x.select("conv_id", "turn", F.array_join(F.transform(F.filter("s", lambda v: v["op"] != "+"), lambda v: v["value"]), "").alias("old_text"))


@query("SELECT doc_id, text FROM documents")
def tokens_reconstruct(spark, d):
    return tokens_of_texts(_docs(spark, d), "doc_id", "text").select("doc_id", F.array_join(F.col("tokens.value"), "").alias("text"))


# language and file type

_NAME = "regexp_extract(url, '/([^/?#]*)([?#].*)?$', 1)"


@query("SELECT page_id, CASE " + " ".join(f"WHEN regexp_extract(lower({_NAME}), '^.+(\\.[^.]*)$', 1) IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in lang.EXTENSIONS.items()) + " END AS language FROM pages")
def language_by_extension(spark, d):
    return src.table(spark, d, "pages").select("page_id", lang.language_by_extension(F.regexp_extract("url", r"/([^/?#]*)([?#].*)?$", 1)).alias("language"))


def _any_sql(c: str, patterns: list[str]) -> str:
    return " + ".join(f"CAST(regexp_matches({c}, '(?m){p}') AS INTEGER)" for p in patterns)


@query(f"""WITH t AS (SELECT doc_id, substr(text, 1, 5000) AS h, {TRIM.format('text')} AS t, array_to_string(list_slice(string_split(text, chr(10)), 1, 50), chr(10)) AS f FROM documents)
SELECT doc_id, CASE WHEN {_any_sql('h', lang.IOS)} >= 1 THEN 'cisco-ios' WHEN {_any_sql('h', lang.JUNOS)} >= 2 THEN 'juniper-junos' WHEN (starts_with(t, '{{') AND ends_with(t, '}}')) OR (starts_with(t, '[') AND ends_with(t, ']')) THEN 'json'
  WHEN starts_with(t, '<?xml') OR starts_with(t, '<!DOCTYPE') OR regexp_matches(t, '^<[a-zA-Z][\\s\\S]*?>') THEN 'xml' WHEN regexp_matches(f, '(?m)^---|^[a-zA-Z_][a-zA-Z0-9_]*\\s*:|^\\s*-\\s+') THEN 'yaml' ELSE 'text' END AS file_type FROM t""")
def file_type(spark, d):
    return _docs(spark, d).select("doc_id", lang.file_type(F.col("text")).alias("file_type"))


# sliders and exports


@query(f"""WITH {EDITED} SELECT pair_id, line_no, coalesce(array_to_string(list(line) OVER (PARTITION BY pair_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), chr(10)), '') AS before, coalesce(array_to_string(list(line) OVER (PARTITION BY pair_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), chr(10)), '') AS after FROM nl""")
def slider_context(spark, d):
    x = sliders.contexts(_edited(spark, d)[1], "pair_id", "line_no", "line")
    return x.select("pair_id", "line_no", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


@query(f"WITH {EDITED} SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.line_no, b.line_no) AS line_no, a.line AS old_line, b.line AS new_line FROM ol a FULL JOIN nl b ON a.pair_id = b.pair_id AND a.line_no = b.line_no")
def side_by_side(spark, d):
    return export.side_by_side(*_edited(spark, d))


@query(f"""WITH {POSITIONAL}, q AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY seq) AS k FROM pe), w AS (SELECT *, max(CASE WHEN op <> '=' THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near, count(old_no) OVER (PARTITION BY pair_id ORDER BY k) AS o, count(new_no) OVER (PARTITION BY pair_id ORDER BY k) AS n FROM q),
  h AS (SELECT *, sum(CASE WHEN p = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY pair_id ORDER BY k) AS hunk FROM (SELECT *, k - lag(k) OVER (PARTITION BY pair_id ORDER BY k) AS p FROM w WHERE near = 1))
SELECT pair_id, CAST(hunk AS BIGINT) AS hunk, '@@ -' || (min(o - CASE WHEN old_no IS NULL THEN 0 ELSE 1 END) + 1) || ',' || count(old_no) || ' +' || (min(n - CASE WHEN new_no IS NULL THEN 0 ELSE 1 END) + 1) || ',' || count(new_no) || ' @@' AS header, string_agg(CASE op WHEN '=' THEN ' ' ELSE op END || line, chr(10) ORDER BY k) AS body FROM h GROUP BY 1, 2""")
def unified_patch(spark, d):
    e = _positional(spark, d).withColumn("seq", F.row_number().over(Window.partitionBy("pair_id").orderBy("seq")))
    return export.unified_patch(e)
