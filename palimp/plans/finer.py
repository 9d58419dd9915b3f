"""Further queries with SQL: normalisation by language, tokens, regions, languages, sliders, greedy pairings and moves, two passes. They join those of the registry.

Greedy steps are stated in SQL by recursion over their candidates in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimp.functions import language as lang
from palimp.functions import regions as reg
from palimp.functions import signature as sig
from palimp.functions import similarity as sim
from palimp.functions import text as txt
from palimp.functions import tokens as tok
from palimp.operators import align, late_moves, matching, sliders
from palimp.plans import compare as cmp
from palimp.plans.registry import DOC_LINES, EDITED, POSITIONAL, TRIM, _docs, _edited, _facing, _NAME, _positional, positional, query
from palimp.sources import pairs as src
from palimp.storage import written

PAGE_LINES = "gl AS (SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT page_id, string_split(html, chr(10)) AS l FROM pages))"


def _pages(spark, d) -> DataFrame:
    return src.table(spark, d, "pages")


def _page_lines(spark, d) -> DataFrame:
    return src.explode_lines(_pages(spark, d).select("page_id", F.col("html").alias("text")), "page_id", "text")


# normalisation and delimiters

_OUTSIDE = r"(?s)(?:[^''\"\\]|\\.|''(?:[^''\\]|\\.)*''|\"(?:[^\"\\]|\\.)*\")*\\?"  # a beginning of a line that ends outside of quotes


def _cut_sql(c: str, mark: str) -> str:
    head = f"substr({c}, 1, strpos({c}, '{mark}') - 1)"
    return f"CASE WHEN strpos({c}, '{mark}') > 0 AND regexp_full_match({head}, '{_OUTSIDE}') THEN {head} ELSE {c} END"


@query(f"""WITH {PAGE_LINES}, a AS (SELECT page_id, line_no, string_split(line, '//')[1] AS t FROM gl), b AS (SELECT page_id, line_no, {_cut_sql('t', '#')} AS t FROM a), c AS (SELECT page_id, line_no, {_cut_sql('t', '--')} AS t FROM b),
  e AS (SELECT page_id, line_no, regexp_replace(regexp_replace(t, '/\\*.*?\\*/', '', 'g'), '<!--.*?-->', '', 'g') AS t FROM c) SELECT page_id, string_agg(t, chr(10) ORDER BY line_no) AS html FROM e GROUP BY 1""")
def strip_comments(spark, d):
    return _pages(spark, d).select("page_id", txt.strip_comments("html").alias("html"))


_CHARS = """pc AS (SELECT page_id, unnest(string_split(html, '')) AS c, generate_subscripts(string_split(html, ''), 1) AS i, html FROM pages WHERE html <> ''),
  pv AS (SELECT page_id, c, i - 1 AS pos, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM pc WHERE c IN ('(', ')', '[', ']', '{', '}', '<', '>') AND (length(substr(html, 1, i - 1)) - length(rtrim(substr(html, 1, i - 1), '\\'))) % 2 = 0)"""


_OPENS, _FITS = "c IN ('(', '[', '{', '<')", "open <> '' AND right(open, 1) || c IN ('()', '[]', '{}', '<>')"


@query(f"""WITH RECURSIVE {_CHARS}, pl AS MATERIALIZED (SELECT page_id, list(c ORDER BY k) AS cs, list(pos ORDER BY k) AS ps FROM pv GROUP BY 1),
  st(page_id, k, open, bad, first) AS (SELECT page_id, 0, '', 0, CAST(NULL AS BIGINT) FROM pages UNION ALL
    SELECT page_id, k + 1, CASE WHEN {_OPENS} THEN open || c WHEN {_FITS} THEN left(open, length(open) - 1) ELSE open END, bad + CASE WHEN {_OPENS} OR ({_FITS}) THEN 0 ELSE 1 END, coalesce(first, CASE WHEN {_OPENS} OR ({_FITS}) THEN NULL ELSE pos END)
    FROM (SELECT st.*, cs[k + 1] AS c, ps[k + 1] AS pos FROM st JOIN pl USING (page_id) WHERE k < len(cs))),
  l AS (SELECT page_id, max(k) AS k FROM st GROUP BY 1)
SELECT page_id, bad = 0 AND open = '' AS balanced, bad + length(open) AS errors, CAST(bad AS BIGINT) AS unexpected, length(open) AS unclosed, first AS first_unexpected FROM st JOIN l USING (page_id, k)""")
def delimiter_validation(spark, d):
    x = _pages(spark, d).select("page_id", txt.validate_delimiters("html").alias("e"))
    bad = F.filter("e", lambda v: v["type"] == "unexpected_close")
    return x.select("page_id", (F.size("e") == 0).alias("balanced"), F.size("e").cast("long").alias("errors"), F.size(bad).cast("long").alias("unexpected"), (F.size("e") - F.size(bad)).cast("long").alias("unclosed"), F.try_element_at(bad, F.lit(1))["position"].cast("long").alias("first_unexpected"))


def _squeeze(c: str) -> str:
    for m in "()[]{}<>":
        c = f"regexp_replace({c}, '\\s*\\{m}\\s*', '{m}', 'g')"
    return c


def _nested_sql(last: str, name: str, a: str, b: str, where: str) -> str:
    """Collapses white space in the first balanced top-level pair of one kind."""
    even = "(length(substr(h, 1, i - 1)) - length(rtrim(substr(h, 1, i - 1), '\\'))) % 2 = 0"
    return f"""{name}c AS (SELECT page_id, h, unnest(string_split(h, '')) AS c, generate_subscripts(string_split(h, ''), 1) AS i FROM {last} WHERE {where} AND h <> ''),
  {name}s AS (SELECT page_id, i, c, sum(CASE c WHEN '{a}' THEN 1 ELSE -1 END) OVER w AS s FROM {name}c WHERE c IN ('{a}', '{b}') AND {even} WINDOW w AS (PARTITION BY page_id ORDER BY i)),
  {name}d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS depth FROM {name}s),
  {name}a AS (SELECT page_id, min(i) AS lo FROM {name}d WHERE c = '{a}' GROUP BY 1), {name}b AS (SELECT page_id, lo, min(i) AS hi FROM {name}d JOIN {name}a USING (page_id) WHERE i > lo AND depth = 0 GROUP BY 1, 2),
  {name} AS (SELECT page_id, language, CASE WHEN hi IS NULL THEN h ELSE substr(h, 1, lo) || trim(regexp_replace(substr(h, lo + 1, hi - lo - 1), '\\s+', ' ', 'g')) || substr(h, hi) END AS h FROM {last} LEFT JOIN {name}b USING (page_id))"""


_BY_LANGUAGE = "CASE page_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'css' ELSE 'json' END"


def _normalized_sql(language: str) -> str:
    steps = [f"n0 AS (SELECT page_id, {language} AS language, {_squeeze('html')} AS h FROM pages)"]
    for i, (a, b) in enumerate(("()", "[]", "{}")):
        steps.append(_nested_sql(f"n{i}", f"n{i + 1}", a, b, "coalesce(language, '') <> 'json'" if a == "(" else "true"))
    return "WITH " + ", ".join(steps)


@query(f"{_normalized_sql('NULL')} SELECT page_id, h AS html FROM n3")
def normalize_delims(spark, d):
    return _pages(spark, d).select("page_id", txt.normalize_delimiters("html").alias("html"))


@query(f"{_normalized_sql(_BY_LANGUAGE)} SELECT page_id, language, h AS normalized, html AS original FROM n3 JOIN pages USING (page_id)")
def normalize_delims_by_language(spark, d):
    """The pairs of a language that goes round by page, and the original kept for reversal."""
    name = F.when(F.col("page_id") % 3 == 0, "python").when(F.col("page_id") % 3 == 1, "css").otherwise("json")
    return _pages(spark, d).withColumn("language", name).select("page_id", "language", txt.normalize_with_state(F.col("html"), F.col("language")).alias("s")).select("page_id", "language", "s.*")


@query(f"""WITH {EDITED}, t AS (SELECT pair_id, n.line_no, o.line_no AS pos, {TRIM.format('n.line')} AS t, {TRIM.format('o.line')} AS v FROM nl n JOIN ol o USING (pair_id))
SELECT pair_id, line_no, coalesce(min(pos) FILTER (v = t OR (length(t) > 3 AND (contains(v, t) OR (contains(t, v) AND abs(length(t) - length(v)) < 10)))), -1) AS old_no FROM t GROUP BY 1, 2""")
def first_lines_like(spark, d):
    old, new = _edited(spark, d)
    lines = old.groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda v: v["line"]).alias("lines"))
    return new.join(lines, "pair_id").select("pair_id", "line_no", txt.first_line_like(F.col("lines"), F.col("line")).cast("int").alias("old_no"))


@query(f"""WITH RECURSIVE lo(k, v) AS (SELECT 0, CAST(1 AS HUGEINT) UNION ALL SELECT k + 1, v * 33 % 4294967296 FROM lo WHERE k < 255), hi(k, v) AS (SELECT 0, CAST(1 AS HUGEINT) UNION ALL SELECT k + 1, v * (SELECT v * 33 % 4294967296 FROM lo WHERE k = 255) % 4294967296 FROM hi WHERE k < 4095),
  {PAGE_LINES}, sl AS (SELECT page_id, line_no, line, regexp_replace({TRIM.format('line')}, '\\s+', ' ', 'g') AS t FROM gl), c AS (SELECT page_id, line_no, unicode(unnest(string_split(t, ''))) AS c, len(string_split(t, '')) - generate_subscripts(string_split(t, ''), 1) AS e, len(string_split(t, '')) AS n FROM sl WHERE t <> '')
SELECT page_id, line_no, CAST(CASE WHEN line = '' THEN 0 ELSE 5381 END AS BIGINT) AS hash FROM sl WHERE t = '' UNION ALL
SELECT page_id, line_no, CAST((sum(c * (lo.v * hi.v % 4294967296)) + 5381 * (SELECT a.v * b.v % 4294967296 FROM lo a, hi b WHERE a.k = any_value(n) % 256 AND b.k = any_value(n) // 256)) % 4294967296 AS BIGINT) AS hash
FROM c JOIN lo ON lo.k = e % 256 JOIN hi ON hi.k = e // 256 GROUP BY page_id, line_no""")
def djb2_hash_without_spaces(spark, d):
    return _page_lines(spark, d).select("page_id", "line_no", sig.djb2(F.col("line"), True).alias("hash"))


# regions of lines, as HTML

_REGION = r"""\"(?:[^\"\\]|\\.)*\"|''(?:[^''\\]|\\.)*''|<!--(?s:.*?)(?:-->|$)"""
_PIECES = f"""{PAGE_LINES}, pm AS (SELECT page_id, line_no, line, regexp_extract_all(line, '{_REGION}') AS r, regexp_split_to_array(line, '{_REGION}') AS g FROM gl),
  px AS (SELECT *, list_concat([0], list_transform(range(1, len(r) + 1), lambda i: CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(r[1:i], lambda x: length(x))) AS BIGINT))) AS ends FROM pm),
  pr AS (SELECT page_id, line_no, CASE WHEN starts_with(content, '<') THEN 'comment' ELSE 'string' END AS type, CAST(stop - length(content) AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", content FROM (SELECT page_id, line_no, unnest(r) AS content, unnest(ends[2:]) AS stop FROM px)),
  pg AS (SELECT page_id, line_no, 'code' AS type, CAST(a AS INTEGER) AS start, CAST(a + length(t) AS INTEGER) AS "end", t AS content FROM (SELECT page_id, line_no, unnest(g) AS t, unnest(ends) AS a FROM px) WHERE t <> '')"""


def _regions(spark, d) -> DataFrame:
    return _page_lines(spark, d).withColumn("r", reg.regions("line", F.lit("html")))


@query(f'WITH {_PIECES} SELECT page_id, line_no, type, start, "end", content FROM pr')
def line_regions(spark, d):
    x = _regions(spark, d).withColumn("r", F.explode("r"))
    return x.select("page_id", "line_no", "r.type", "r.start", "r.end", "r.content")


@query(f'WITH {_PIECES} SELECT page_id, line_no, type, start, "end", content FROM (SELECT * FROM pr UNION ALL SELECT * FROM pg)')
def line_regions_with_code(spark, d):
    x = _regions(spark, d).where("line != ''").withColumn("r", F.explode(reg.with_code(F.col("r"), F.col("line"))))
    return x.select("page_id", "line_no", "r.type", "r.start", "r.end", "r.content")


@query(f'WITH {_PIECES}, pt AS (SELECT page_id, line_no, length(line) // 2 AS p FROM gl) SELECT pt.page_id, pt.line_no, coalesce(type, \'code\') AS type, coalesce(type, \'\') = \'comment\' AS in_comment, coalesce(type, \'\') = \'string\' AS in_string FROM pt LEFT JOIN pr ON pr.page_id = pt.page_id AND pr.line_no = pt.line_no AND start <= p AND p < "end"')
def region_types_at(spark, d):
    """What is in the middle of each line."""
    kind = reg.region_type_at(F.col("r"), F.floor(F.length("line") / 2))
    return _regions(spark, d).select("page_id", "line_no", kind.alias("type")).select("*", (F.col("type") == "comment").alias("in_comment"), (F.col("type") == "string").alias("in_string"))


@query(f"WITH {_PIECES}, pk AS (SELECT page_id, line_no, start, content FROM pr WHERE type = 'string' UNION ALL SELECT page_id, line_no, start, content FROM pg), ps AS (SELECT page_id, line_no, string_agg(content, '' ORDER BY start) AS t FROM pk GROUP BY 1, 2) SELECT gl.page_id, gl.line_no, coalesce(t, '') AS line FROM gl LEFT JOIN ps USING (page_id, line_no)")
def lines_without_comments(spark, d):
    return _regions(spark, d).select("page_id", "line_no", reg.without_comments(F.col("r"), F.col("line")).alias("line"))


# tokens

_OPERATORS = "|".join("".join("\\" + c if c in "*+?|.^" else c for c in o) for o in tok.OPERATORS)
_TOKEN_SQL = r"(?s)[\t\n\v\f\r ]+|//.*|#.*|--.*|\"(?:\\.|[^\"\\])*\"?|''(?:\\.|[^''\\])*''?|`(?:\\.|[^`\\])*`?|(?:[0-9]|\.[0-9])[0-9.eExXbBoO]*|" + _OPERATORS + r"|[()\[\]{},;.]|[A-Za-z_$][\w$]*|."
_KIND_SQL = f"""CASE WHEN regexp_matches(v, '^[\\t\\n\\v\\f\\r ]') THEN 'whitespace' WHEN starts_with(v, '//') AND v <> '//' OR starts_with(v, '#') OR starts_with(v, '--') THEN 'comment' WHEN v = '//' THEN 'comment' WHEN regexp_matches(v, '^["''`]') THEN 'string' WHEN regexp_matches(v, '^\\.?[0-9]') THEN 'number'
  WHEN v IN ({', '.join(repr(o) for o in tok.OPERATORS)}) THEN 'operator' WHEN v IN ('(', ')', '[', ']', '{{', '}}', ',', ';', '.') THEN 'delimiter' WHEN v IN ({', '.join(repr(k) for k in sorted(tok.KEYWORDS))}) THEN 'keyword' WHEN regexp_matches(v, '^[A-Za-z_$]') THEN 'identifier' ELSE 'other' END"""


def _tokens_sql(source: str, keys: str, line: str, name: str) -> str:
    """name: keys, i, v, kind, and place among the tokens that are no white space and no comment."""
    return f"""{name}0 AS (SELECT {keys}, unnest(regexp_extract_all({line}, '{_TOKEN_SQL}')) AS v, generate_subscripts(regexp_extract_all({line}, '{_TOKEN_SQL}'), 1) AS i FROM {source}),
  {name}1 AS (SELECT *, {_KIND_SQL} AS kind FROM {name}0), {name} AS (SELECT *, CASE WHEN kind NOT IN ('whitespace', 'comment') THEN count(*) FILTER (kind NOT IN ('whitespace', 'comment')) OVER (PARTITION BY {keys} ORDER BY i) - 1 END AS place FROM {name}1)"""


_NORMAL = "CASE WHEN kind IN ('string', 'number') THEN '__' || kind || '_' || place || '__' ELSE v END"


@query(f"WITH {DOC_LINES}, {_tokens_sql('dl', 'doc_id, line_no', 'line', 'tk')} SELECT doc_id, line_no, string_agg(kind, ' ' ORDER BY i) AS kinds, coalesce(string_agg({_NORMAL}, ' ' ORDER BY i) FILTER (place IS NOT NULL), '') AS normalized FROM tk GROUP BY 1, 2")
def token_lines(spark, d):
    """Kinds of the tokens of each line, and its tokens with literals replaced by their places."""
    x = src.explode_lines(src.spread(_docs(spark, d).select("doc_id", "text")), "doc_id", "text").where("line != ''")
    join = lambda c, f: F.array_join(F.transform(c, lambda t: t[f]), " ")
    return x.select("doc_id", "line_no", join(tok.tokens("line"), "type").alias("kinds"), join(tok.normalized_tokens("line"), "value").alias("normalized"))


_FACE = f"{EDITED}, fc AS (SELECT pair_id, a.line_no, a.line AS x, b.line AS y FROM ol a JOIN nl b USING (pair_id, line_no))"
_LISTS = f"""{_FACE}, {_tokens_sql('fc', 'pair_id, line_no', 'x', 'ta')}, {_tokens_sql('fc', 'pair_id, line_no', 'y', 'tb')},
  la AS (SELECT pair_id, line_no, coalesce(list(kind || ' ' || v ORDER BY i) FILTER (kind <> 'whitespace'), []) AS raw, coalesce(list(kind || ' ' || {_NORMAL} ORDER BY i) FILTER (place IS NOT NULL), []) AS norm, coalesce(list(DISTINCT v) FILTER (kind = 'keyword'), []) AS kw, coalesce(list(DISTINCT v) FILTER (kind = 'identifier'), []) AS ids FROM ta GROUP BY 1, 2),
  lb AS (SELECT pair_id, line_no, coalesce(list(kind || ' ' || v ORDER BY i) FILTER (kind <> 'whitespace'), []) AS raw, coalesce(list(kind || ' ' || {_NORMAL} ORDER BY i) FILTER (place IS NOT NULL), []) AS norm, coalesce(list(DISTINCT v) FILTER (kind = 'keyword'), []) AS kw, coalesce(list(DISTINCT v) FILTER (kind = 'identifier'), []) AS ids FROM tb GROUP BY 1, 2),
  lf AS (SELECT pair_id, line_no, coalesce(la.raw, []) AS ra, coalesce(lb.raw, []) AS rb, coalesce(la.norm, []) AS na, coalesce(lb.norm, []) AS nb, coalesce(la.kw, []) AS ka, coalesce(lb.kw, []) AS kb, coalesce(la.ids, []) AS ia, coalesce(lb.ids, []) AS ib FROM fc LEFT JOIN la USING (pair_id, line_no) LEFT JOIN lb USING (pair_id, line_no)),
  lp AS MATERIALIZED (SELECT pair_id, line_no, 'raw' AS kind, ra AS a, rb AS b FROM lf UNION ALL SELECT pair_id, line_no, 'norm', na, nb FROM lf),
  dy(pair_id, line_no, kind, i, best) AS (SELECT pair_id, line_no, kind, 0, list_transform(b, lambda v: 0) FROM lp WHERE greatest(len(a), len(b)) <= {tok.LONG} AND len(a) > 0 AND len(b) > 0 UNION ALL
    SELECT p.pair_id, p.line_no, p.kind, y.i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(best[k], (CASE WHEN k > 1 THEN best[k - 1] ELSE 0 END) + CAST(b[k] = a[y.i + 1] AS INTEGER))))) FROM dy y JOIN lp p ON p.pair_id = y.pair_id AND p.line_no = y.line_no AND p.kind = y.kind WHERE y.i < len(a)),
  gr(pair_id, line_no, kind, i, pos, n) AS (SELECT pair_id, line_no, kind, 0, CAST(0 AS BIGINT), 0 FROM lp WHERE greatest(len(a), len(b)) > {tok.LONG} UNION ALL
    SELECT p.pair_id, p.line_no, p.kind, g.i + 1, g.pos + coalesce(list_position(b[g.pos + 1:], a[g.i + 1]), 0), g.n + CASE WHEN coalesce(list_position(b[g.pos + 1:], a[g.i + 1]), 0) > 0 THEN 1 ELSE 0 END FROM gr g JOIN lp p ON p.pair_id = g.pair_id AND p.line_no = g.line_no AND p.kind = g.kind WHERE g.i < len(a)),
  lc AS (SELECT y.pair_id, y.line_no, y.kind, best[len(best)] AS n FROM dy y JOIN lp p ON p.pair_id = y.pair_id AND p.line_no = y.line_no AND p.kind = y.kind AND y.i = len(p.a) UNION ALL SELECT g.pair_id, g.line_no, g.kind, g.n FROM gr g JOIN lp p ON p.pair_id = g.pair_id AND p.line_no = g.line_no AND p.kind = g.kind AND g.i = len(p.a)),
  jc AS (SELECT lf.*, CASE WHEN len(ka) + len(kb) = 0 THEN 1.0 ELSE len(list_intersect(ka, kb)) / len(list_distinct(list_concat(ka, kb))) END AS keyword, CASE WHEN len(ia) + len(ib) = 0 THEN 1.0 ELSE len(list_intersect(ia, ib)) / len(list_distinct(list_concat(ia, ib))) END AS identifier,
    coalesce(r.n, 0) AS lcs, CASE WHEN len(ra) + len(rb) = 0 THEN 1.0 ELSE 2 * coalesce(r.n, 0) / (len(ra) + len(rb)) END AS raw, CASE WHEN len(na) + len(nb) = 0 THEN 1.0 ELSE 2 * coalesce(m.n, 0) / (len(na) + len(nb)) END AS normalized
    FROM lf LEFT JOIN lc r ON r.pair_id = lf.pair_id AND r.line_no = lf.line_no AND r.kind = 'raw' LEFT JOIN lc m ON m.pair_id = lf.pair_id AND m.line_no = lf.line_no AND m.kind = 'norm')"""


@query(f"WITH RECURSIVE {_LISTS} SELECT pair_id, line_no, round(least(1.0, 0.55 * normalized + 0.25 * keyword + 0.15 * identifier + 0.05 * raw), 6) AS similarity, round(normalized, 6) AS normalized, round(keyword, 6) AS keyword, round(identifier, 6) AS identifier, round(raw, 6) AS raw, CAST(lcs AS INTEGER) AS lcs FROM jc")
def token_similarity(spark, d):
    x = _facing(spark, d).select("pair_id", "line_no", tok.token_details("old_line", "new_line").alias("s"), tok.token_lcs("old_line", "new_line").alias("lcs"))
    return x.select("pair_id", "line_no", *(F.round(f"s.{c}", 6).alias(c) for c in ("similarity", "normalized", "keyword", "identifier", "raw")), "lcs")


# languages


def _hits_sql(patterns: list[str]) -> str:
    one = lambda p: "(len(list_filter(regexp_extract_all(html, '(?m)^\\s*import\\s+(\\w+)', 1), lambda w: w <> 'java')) > 0)" if "(?!java" in p else f"regexp_matches(html, '(?m){p.replace(chr(39), chr(39) * 2)}')"
    return "(" + " + ".join(f"CAST({one(p)} AS INTEGER)" for p in patterns) + ")"


_CONTENT_SQL = f"""CASE WHEN (starts_with({TRIM.format('html')}, '{{') OR starts_with({TRIM.format('html')}, '[')) AND json_valid(html) THEN 'json' WHEN {_hits_sql(lang.TYPESCRIPT_BASE)} >= 1 AND {_hits_sql(lang.TYPESCRIPT)} >= 1 THEN 'typescript'
  WHEN {_hits_sql(lang.JAVASCRIPT)} >= 2 AND {_hits_sql(lang.NOT_JAVASCRIPT)} = 0 AND NOT (regexp_matches(html, '^\\s*def\\s+\\w+') OR (regexp_matches(html, '(?m)^\\s*@[\\w_]+') AND regexp_matches(html, '(?m)^\\s*async def'))) AND NOT (regexp_matches(html, '\\bfn\\s+\\w+\\s*\\(') AND (regexp_matches(html, '\\bmod\\s+\\w+') OR regexp_matches(html, '\\buse\\s+\\w+::') OR regexp_matches(html, '\\bimpl\\s+'))) THEN 'javascript'
  """ + " ".join(f"WHEN {_hits_sql(p)} >= 2" + (f" OR regexp_matches(html, '(?m){lang.SHEBANG}')" if k == "bash" else "") + f" THEN '{k}'" for k, p in lang.RULES.items()) + " END"
_EXT_SQL = f"regexp_extract(lower({_NAME}), '^.+(\\.[^.]*)$', 1)"
_BY_EXT_SQL = "CASE " + " ".join(f"WHEN {_EXT_SQL} IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in lang.EXTENSIONS.items()) + " END"


def _url_name():
    return F.regexp_extract("url", r"/([^/?#]*)([?#].*)?$", 1)


@query(f"SELECT page_id, {_CONTENT_SQL} AS language FROM pages")
def language_by_content(spark, d):
    return _pages(spark, d).select("page_id", lang.language_by_content(F.col("html")).alias("language"))


@query(f"SELECT page_id, nullif({_EXT_SQL}, '') AS extension, {_BY_EXT_SQL} AS extension_language, {_CONTENT_SQL} AS content_language, coalesce({_BY_EXT_SQL}, {_CONTENT_SQL}) AS final_language, coalesce({_BY_EXT_SQL}, {_CONTENT_SQL}) IS NOT NULL AS supported FROM pages")
def language_details(spark, d):
    return _pages(spark, d).select("page_id", lang.detection_details(_url_name(), F.col("html")).alias("s")).select("page_id", "s.*")


@query(f"""WITH l AS (SELECT page_id, coalesce({_BY_EXT_SQL}, {_CONTENT_SQL}) AS x, regexp_matches(html, '(console|document)\\.') AS script FROM pages), p AS (SELECT page_id, x, script, lag(page_id) OVER w AS before, lag(x) OVER w AS y, lag(script) OVER w AS script2 FROM l WINDOW w AS (ORDER BY page_id))
SELECT page_id, before, CASE WHEN x = y THEN x WHEN x IS NULL OR y IS NULL THEN coalesce(x, y) WHEN script OR script2 THEN 'javascript' END AS language FROM p WHERE before = page_id - 1""")
def common_languages(spark, d):
    """Each page and the one with the number before."""
    x = _pages(spark, d).select("page_id", _url_name().alias("name"), "html")
    y = x.select((F.col("page_id") + 1).alias("page_id"), F.col("page_id").alias("before"), F.col("name").alias("n2"), F.col("html").alias("h2"))
    return x.join(y, "page_id").select("page_id", "before", lang.common_language(F.col("n2"), F.col("name"), F.col("h2"), F.col("html")).alias("language"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{x}')" for k, x in lang.supported_extensions()) + ") AS t(language, extension)")
def supported_extensions(spark, d):
    return spark.createDataFrame(lang.supported_extensions(), "language string, extension string")


# sliders, on the rows of the degraded comparison by number

_INDENT = "length(replace(regexp_extract({0}, '^(\\s*)', 1), chr(9), '    '))"
_COMMENT = f"regexp_matches({TRIM.format('{0}')}, '{sliders.COMMENT}')"


def _scores_sql(rows: str, key: str, order: str, text: str, name: str) -> str:
    """name: rows with cur, lft, rgt."""
    holds = lambda m, side: f"(contains(t, '{m}') OR len(list_filter({side}, lambda v: contains(v, '{m}'))) > 0)"
    pairs = [(holds(a, "bef"), holds(b, "aft")) for a, b in ("()", "[]", "{}")]
    deli = f"CASE WHEN {' OR '.join(f'{x} OR {y}' for x, y in pairs)} THEN ({' + '.join(f'CASE WHEN {x} AND {y} THEN 0.8 WHEN {x} OR {y} THEN 0.3 ELSE 0.0 END' for x, y in pairs)}) / ({' + '.join(f'CASE WHEN {x} OR {y} THEN 1 ELSE 0 END' for x, y in pairs)}) ELSE 0.5 END"
    i, ib, ia = _INDENT.format("t"), _INDENT.format("bef[len(bef)]"), _INDENT.format("aft[1]")
    mean = lambda side: f"(list_sum(list_transform({side}, lambda v: {_INDENT.format('v')})) / len({side}))"
    ind = f"""CASE WHEN len(bef) + len(aft) > 0 THEN (CASE WHEN len(bef) > 0 THEN CASE WHEN {i} = {ib} THEN 0.9 ELSE 0.4 END ELSE 0.0 END + CASE WHEN len(aft) > 0 THEN CASE WHEN {i} = {ia} THEN 0.9 ELSE 0.4 END ELSE 0.0 END
      + CASE WHEN len(bef) > 0 AND len(aft) > 0 THEN 0.5 * (1 - abs({i} - ({mean('bef')} + {mean('aft')}) / 2)) ELSE 0.0 END) / (CASE WHEN len(bef) > 0 THEN 1 ELSE 0 END + CASE WHEN len(aft) > 0 THEN 1 ELSE 0 END + CASE WHEN len(bef) > 0 AND len(aft) > 0 THEN 1 ELSE 0 END) ELSE 0.5 END"""
    has = lambda side: f"len(list_filter({side}, lambda v: {_COMMENT.format('v')})) > 0"
    com = f"CASE WHEN {_COMMENT.format('t')} THEN CASE WHEN {has('bef')} OR {has('aft')} THEN 0.9 ELSE 0.5 END ELSE CASE WHEN {has('bef')} AND {has('aft')} THEN 0.2 ELSE 0.8 END END"
    brace = f"CASE WHEN contains(t, '{{') OR contains(t, '}}') THEN (CASE WHEN contains(t, '{{') THEN CASE WHEN regexp_matches(coalesce(bef[len(bef)], ''), '{sliders.SIGNATURE}') THEN 0.9 ELSE 0.4 END ELSE 0.0 END) + CASE WHEN contains(t, '}}') THEN 0.7 ELSE 0.0 END ELSE 0.5 END"
    w = sliders.OTHER
    return f"""{name}0 AS (SELECT *, {text} AS t, coalesce(list({text}) OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS bef, coalesce(list({text}) OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), []) AS aft FROM {rows}),
  {name}1 AS (SELECT *, greatest(0.0, least(1.0, CAST(0.5 AS DOUBLE) + CAST({deli} AS DOUBLE) * {w[3]} + CAST({ind} AS DOUBLE) * {w[1]} + CAST({com} AS DOUBLE) * {w[2]} + CAST({brace} AS DOUBLE) * {w[0]})) AS cur FROM {name}0),
  {name} AS (SELECT *, coalesce(lag(cur) OVER w, 0.0) AS lft, coalesce(lead(cur) OVER w, 0.0) AS rgt FROM {name}1 WINDOW w AS (PARTITION BY {key} ORDER BY {order}))"""


@query(f"WITH {EDITED}, {_scores_sql('nl', 'pair_id', 'line_no', 'line', 'sc')} SELECT pair_id, line_no, round(cur, 6) AS current_score, round(lft, 6) AS left_score, round(rgt, 6) AS right_score FROM sc")
def slider_scores(spark, d):
    x = sliders.scores(_edited(spark, d)[1], None, "pair_id", "line_no", "line")
    return x.select("pair_id", "line_no", *(F.round(c, 6).alias(c) for c in ("current_score", "left_score", "right_score")))


_FAST_ROWS = f"""{POSITIONAL}, fn AS (SELECT *, row_number() OVER (PARTITION BY pair_id, block_id, op ORDER BY seq) AS k FROM pb),
  fm AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.seq, b.seq) AS seq, CASE WHEN a.line IS NULL THEN 'added' WHEN b.line IS NULL THEN 'removed' ELSE 'modified' END AS classification, coalesce(a.line, b.line) AS text FROM (SELECT * FROM fn WHERE op = '-') a FULL JOIN (SELECT * FROM fn WHERE op = '+') b ON a.pair_id = b.pair_id AND a.block_id = b.block_id AND a.k = b.k),
  fr AS (SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY seq) AS INTEGER) AS seq, classification, text FROM (SELECT * FROM fm UNION ALL SELECT pair_id, seq, 'unchanged', line FROM pe WHERE op = '=')),
  {_scores_sql('fr', 'pair_id', 'seq', 'text', 'sr')},
  sg AS (SELECT *, abs(cur - greatest(lft, rgt)) AS gap, count(*) OVER (PARTITION BY pair_id) AS n FROM sr), sn AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY seq) AS k FROM sg WHERE n <= 10000 AND classification = 'modified' AND gap <= 0.15),
  sq AS (SELECT pair_id, seq, 1 - gap / 0.15 AS ambiguity, cur, lft, rgt, CASE WHEN lft > rgt AND lft - cur > 0.1 THEN 'shift_left' WHEN rgt > lft AND rgt - cur > 0.1 THEN 'shift_right' ELSE 'keep' END AS recommendation,
    CASE WHEN lft > rgt AND lft - cur > 0.1 THEN least((lft - cur) * 2, 1.0) WHEN rgt > lft AND rgt - cur > 0.1 THEN least((rgt - cur) * 2, 1.0) ELSE 0.0 END AS confidence FROM sn WHERE k <= 50),
  sp AS (SELECT *, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY round(confidence, 9) DESC, round(ambiguity, 9) DESC, seq) AS INTEGER) AS place FROM sq)"""


def _fast_rows(spark, d) -> DataFrame:
    rows = cmp.classify_fast(_positional(spark, d))
    return rows.select("pair_id", F.row_number().over(Window.partitionBy("pair_id").orderBy("seq")).alias("seq"), "classification", F.coalesce("removed_line", "added_line").alias("text"))


@query(f"WITH {_FAST_ROWS} SELECT pair_id, seq, round(ambiguity, 6) AS ambiguity, recommendation, round(confidence, 6) AS confidence, place FROM sp")
def slider_rows(spark, d):
    return sliders.sliders(_fast_rows(spark, d)).select("pair_id", "seq", F.round("ambiguity", 6).alias("ambiguity"), "recommendation", F.round("confidence", 6).alias("confidence"), "place")


@query(f"WITH {_FAST_ROWS} SELECT count(*) AS total, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (confidence < 0.5) AS low, count(*) FILTER (recommendation = 'keep') AS keep, count(*) FILTER (recommendation = 'shift_left') AS shift_left, count(*) FILTER (recommendation = 'shift_right') AS shift_right, 'unknown=' || count(*) AS languages FROM sp")
def slider_statistics(spark, d):
    x = sliders.slider_statistics(sliders.sliders(_fast_rows(spark, d)))
    return x.withColumn("languages", F.array_join(F.transform(F.map_entries("languages"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query(f"""WITH RECURSIVE {_FAST_ROWS}, cn AS (SELECT pair_id, seq, classification = 'modified' AS m FROM fr),
  cc AS (SELECT sp.pair_id, place, sp.seq, CASE WHEN rgt > lft AND rgt > cur THEN 1 WHEN lft > cur THEN -1 ELSE 0 END AS mv, row_number() OVER (PARTITION BY sp.pair_id ORDER BY place) AS k FROM sp LEFT JOIN cn x ON x.pair_id = sp.pair_id AND x.seq = sp.seq - 1 LEFT JOIN cn y ON y.pair_id = sp.pair_id AND y.seq = sp.seq + 1
    WHERE confidence >= 0.2 AND ((rgt > lft AND rgt > cur AND coalesce(y.m, false)) OR (NOT (rgt > lft AND rgt > cur) AND lft > cur AND coalesce(x.m, false)))),
  ct(pair_id, k, used, swaps) AS (SELECT DISTINCT pair_id, CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST([] AS INTEGER[]) FROM cc UNION ALL
    SELECT cc.pair_id, cc.k, CASE WHEN list_has_any(used, [seq - 1, seq, seq + 1]) THEN used ELSE list_concat(used, [seq, seq + mv]) END, CASE WHEN list_has_any(used, [seq - 1, seq, seq + 1]) THEN swaps ELSE list_append(swaps, CASE WHEN mv = 1 THEN seq ELSE seq - 1 END) END FROM ct JOIN cc ON cc.pair_id = ct.pair_id AND cc.k = ct.k + 1),
  cs AS (SELECT pair_id, unnest(swaps) AS a FROM ct JOIN (SELECT pair_id, max(k) AS k FROM ct GROUP BY 1) USING (pair_id, k))
SELECT fr.pair_id, fr.seq, CASE WHEN x.a IS NOT NULL THEN fr.seq + 1 WHEN y.a IS NOT NULL THEN fr.seq - 1 ELSE fr.seq END AS new_seq, classification, text AS value FROM fr LEFT JOIN cs x ON x.pair_id = fr.pair_id AND x.a = fr.seq LEFT JOIN cs y ON y.pair_id = fr.pair_id AND y.a = fr.seq - 1""")
def slider_corrections(spark, d):
    """From a confidence of 0.2 on: ambiguity up to 0.15 gives no higher one than 0.3."""
    rows = _fast_rows(spark, d)
    return sliders.correct_order(rows, sliders.sliders(rows), 0.2).select("pair_id", "seq", "new_seq", "classification", "value")


@query(f"WITH {PAGE_LINES} SELECT page_id, line_no, CASE WHEN contains(line, '{{') AND NOT contains(line, '}}') AND NOT ends_with({TRIM.format('line')}, '{{') THEN {TRIM.format('regexp_replace(line, ' + repr(chr(92) + 's*' + chr(92) + '{' + chr(92) + 's*') + ', ' + repr('') + ')')} || ' {{' ELSE line END AS line FROM gl")
def brace_boundaries(spark, d):
    return _page_lines(spark, d).select("page_id", "line_no", sliders.adjust_boundaries(F.col("line"), "javascript").alias("line"))


# greedy pairings and moves

_RATIO = "CASE WHEN a.line = b.line THEN 1.0 ELSE least(length(a.line), length(b.line)) / greatest(length(a.line), length(b.line), 1) END"


def _greedy_sql(candidates: str, keys: str, order: str, name: str) -> str:
    """name: the candidates (keys, x, y) that are taken, one after the other, if both ends are free."""
    on = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    return f"""{name}k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS k FROM {candidates}),
  {name}r({keys}, k, ux, uy, hit) AS (SELECT DISTINCT {keys}, CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST([] AS INTEGER[]), false FROM {name}k UNION ALL
    SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, c.k, CASE WHEN list_contains(ux, x) OR list_contains(uy, y) THEN ux ELSE list_append(ux, x) END, CASE WHEN list_contains(ux, x) OR list_contains(uy, y) THEN uy ELSE list_append(uy, y) END, NOT (list_contains(ux, x) OR list_contains(uy, y)) FROM {name}r r JOIN {name}k c ON {on('c', 'r')} AND c.k = r.k + 1),
  {name} AS (SELECT c.* FROM {name}r r JOIN {name}k c ON {on('c', 'r')} AND c.k = r.k WHERE r.hit)"""


_LENGTHS = f"{POSITIONAL}, gc AS (SELECT a.pair_id, a.block_id, a.old_no AS x, b.new_no AS y, {_RATIO} AS sim FROM pb a JOIN pb b ON a.pair_id = b.pair_id AND a.block_id = b.block_id AND a.op = '-' AND b.op = '+' WHERE {_RATIO} >= 0.5), {_greedy_sql('gc', 'pair_id, block_id', 'sim DESC, x, y', 'gg')}"


def _length_pairs(spark, d) -> tuple[DataFrame, DataFrame]:
    b = align.change_blocks(_positional(spark, d))
    x = b.where("op = '-'").select("pair_id", "block_id", "old_no", F.col("line").alias("p")).join(b.where("op = '+'").select("pair_id", "block_id", "new_no", F.col("line").alias("q")), ["pair_id", "block_id"])
    score = F.when(F.col("p") == F.col("q"), 1.0).otherwise(F.least(F.length("p"), F.length("q")) / F.greatest(F.length("p"), F.length("q"), F.lit(1)))
    return b, matching.greedy_pairs(x.withColumn("sim", score), 0.5)


@query(f"WITH RECURSIVE {_LENGTHS} SELECT pair_id, block_id, x AS old_no, y AS new_no, round(sim, 6) AS sim FROM gg")
def greedy_length_pairs(spark, d):
    """The greedy pairing of the comparison, with the ratio of lengths as similarity."""
    return _length_pairs(spark, d)[1].withColumn("sim", F.round("sim", 6))


@query(f"WITH RECURSIVE {_LENGTHS} SELECT pair_id, block_id, op, coalesce(old_no, new_no) AS line_no, line FROM pb WHERE NOT EXISTS (SELECT 1 FROM gg WHERE gg.pair_id = pb.pair_id AND (gg.x = pb.old_no OR gg.y = pb.new_no))")
def unpaired_lines(spark, d):
    b, pairs = _length_pairs(spark, d)
    return matching.unpaired(b, pairs).select("pair_id", "block_id", "op", F.coalesce("old_no", "new_no").alias("line_no"), "line")


def fast_similarity_sql(rows: str) -> str:
    """fx(pair_id, x, y, bx, bz, sim): the fast similarity of all removed and added lines of a pair that aren't blank, with their blocks."""
    return f"""lm AS MATERIALIZED (SELECT pair_id, block_id, op, coalesce(old_no, new_no) AS no, lower({TRIM.format('line')}) AS p, list_filter(regexp_split_to_array(lower({TRIM.format('line')}), '\\s+'), lambda w: w <> '') AS ws FROM {rows} WHERE {TRIM.format('line')} <> ''),
  fx AS (SELECT a.pair_id, a.no AS x, b.no AS y, a.block_id AS bx, b.block_id AS bz, CASE WHEN a.p = b.p THEN 1 ELSE least(1, 0.0001 + CASE WHEN greatest(length(a.p), length(b.p)) < 50 THEN len(list_filter(range(1, least(length(a.p), length(b.p)) + 1), lambda i: substr(a.p, i, 1) = substr(b.p, i, 1))) / greatest(length(a.p), length(b.p)) ELSE 2 * len(list_filter(b.ws, lambda w: list_contains(a.ws, w))) / greatest(len(a.ws) + len(b.ws), 1) END) END AS sim
    FROM lm a JOIN lm b ON a.pair_id = b.pair_id AND a.op = '-' AND b.op = '+')"""


_FAST_SIM = f"{POSITIONAL}, {fast_similarity_sql('pb')}"


@query(f"WITH RECURSIVE {_FAST_SIM}, fy AS (SELECT * FROM fx WHERE sim >= 0.9), {_greedy_sql('fy', 'pair_id', 'sim DESC, x, y', 'gm')} SELECT pair_id, x AS old_no, y AS new_no, round(sim, 6) AS sim FROM gm")
def similar_line_moves(spark, d):
    return matching.similar_moves(align.change_blocks(_positional(spark, d)), 0.9).withColumn("sim", F.round("sim", 6))


@query(f"WITH RECURSIVE {_FAST_SIM}, fy AS (SELECT * FROM fx WHERE sim >= 0.5 AND bx <> bz), {_greedy_sql('fy', 'pair_id', 'sim DESC, x, y', 'gm')} SELECT pair_id, x AS old_no, y AS new_no, round(sim, 6) AS sim FROM gm")
def cross_block_changes(spark, d):
    return matching.similar_moves(align.change_blocks(_positional(spark, d)), 0.5, other_block=True).withColumn("sim", F.round("sim", 6))


_PATIENCE_SIM = f"""{POSITIONAL}, lm AS MATERIALIZED (SELECT pair_id, op, coalesce(old_no, new_no) AS no, line, lower({TRIM.format('line')}) AS p, list_filter(regexp_split_to_array(lower({TRIM.format('line')}), '\\s+'), lambda w: w <> '') AS ws FROM pb),
  fx AS (SELECT a.pair_id, a.no AS x, b.no AS y, CASE WHEN a.line = b.line THEN 1.0 WHEN a.p = b.p THEN 0.95 WHEN len(a.ws) = 0 OR len(b.ws) = 0 THEN 0.0 ELSE 2 * len(list_filter(b.ws, lambda w: list_contains(a.ws, w))) / (len(a.ws) + len(b.ws)) END AS sim FROM lm a JOIN lm b ON a.pair_id = b.pair_id AND a.op = '-' AND b.op = '+')"""


@query(f"WITH RECURSIVE {_PATIENCE_SIM}, fy AS (SELECT * FROM fx WHERE sim >= 0.8), {_greedy_sql('fy', 'pair_id', 'x, sim DESC, y', 'gm')} SELECT pair_id, x AS from_no, y AS to_no, round(sim, 6) AS similarity FROM gm")
def patience_line_moves(spark, d):
    return matching.patience_moves(align.change_blocks(_positional(spark, d))).withColumn("similarity", F.round("similarity", 6))


def block_moves_sql(rows: str) -> str:
    """bm(pair_id, start_old, start_new, size): runs of removed lines that were added elsewhere, the longest first, without overlap."""
    return f"""bl AS (SELECT pair_id, op, coalesce(old_no, new_no) AS no, line FROM {rows} WHERE {TRIM.format('line')} <> ''), bd AS (SELECT a.pair_id, a.no AS i, b.no AS j, a.no - b.no AS dd FROM bl a JOIN bl b ON a.pair_id = b.pair_id AND a.line = b.line AND a.op = '-' AND b.op = '+'),
  bs AS (SELECT *, i - row_number() OVER (PARTITION BY pair_id, dd ORDER BY i) AS g FROM bd), br AS (SELECT pair_id, min(i) AS i, min(j) AS j, count(*) AS n FROM bs GROUP BY pair_id, dd, g),
  bc AS (SELECT pair_id, i + 100 * k AS i, j + 100 * k AS j, least(100, n - 100 * k) AS n FROM (SELECT *, unnest(range(0, (n - 1) // 100 + 1)) AS k FROM br)), bk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, i, j) AS k FROM bc),
  bt(pair_id, k, ui, uj, taken, hit) AS (SELECT DISTINCT pair_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), 0, false FROM bk UNION ALL
    SELECT b.pair_id, b.k, CASE WHEN ok THEN list_concat(ui, range(b.i, b.i + b.n)) ELSE ui END, CASE WHEN ok THEN list_concat(uj, range(b.j, b.j + b.n)) ELSE uj END, taken + CASE WHEN ok THEN 1 ELSE 0 END, ok
    FROM (SELECT bk.*, ui, uj, taken, taken < 100 AND NOT list_has_any(ui, range(bk.i, bk.i + bk.n)) AND NOT list_has_any(uj, range(bk.j, bk.j + bk.n)) AS ok FROM bt JOIN bk ON bk.pair_id = bt.pair_id AND bk.k = bt.k + 1) b),
  bm AS MATERIALIZED (SELECT bk.pair_id, CAST(i AS BIGINT) AS start_old, CAST(j AS BIGINT) AS start_new, n AS size FROM bt JOIN bk USING (pair_id, k) WHERE hit)"""


@query(f"WITH RECURSIVE {POSITIONAL}, {block_moves_sql('pb')} SELECT pair_id, start_old, start_new, size FROM bm")
def positional_block_moves(spark, d):
    return matching.block_moves(align.change_blocks(_positional(spark, d)))


_CONTENT_MOVES = f"""cl AS (SELECT pair_id, line_no, {TRIM.format('line')} AS t, 0 AS s FROM ol UNION ALL SELECT pair_id, line_no, {TRIM.format('line')}, 1 FROM nl),
  cw AS (SELECT pair_id, s, line_no AS a, list(t) OVER (PARTITION BY pair_id, s ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ts FROM cl),
  cz AS (SELECT pair_id, s, a, n, array_to_string(list_sort(list_filter(ts[1:n], lambda v: v <> '')), chr(10)) AS c FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS n FROM cw) WHERE length({TRIM.format('array_to_string(ts[1:n], chr(10))')}) >= 10),
  cy AS (SELECT pair_id, n, c, list(a ORDER BY a) AS there FROM cz WHERE s = 1 GROUP BY 1, 2, 3),
  ck AS MATERIALIZED (SELECT z.pair_id, z.a, z.n, there, row_number() OVER (PARTITION BY z.pair_id ORDER BY z.n DESC, z.a) AS k FROM cz z JOIN cy y ON y.pair_id = z.pair_id AND y.n = z.n AND y.c = z.c WHERE s = 0),
  ct(pair_id, k, gone, come, hit, b) AS (SELECT DISTINCT pair_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), false, CAST(NULL AS INTEGER) FROM ck UNION ALL
    SELECT pair_id, k, CASE WHEN ok THEN list_concat(gone, range(a, a + n)) ELSE gone END, CASE WHEN ok THEN list_concat(come, range(b, b + n)) ELSE come END, ok, b
    FROM (SELECT *, coalesce(b <> a, false) AS ok FROM (SELECT ck.pair_id, ck.k, ck.a, ck.n, gone, come, CASE WHEN list_has_any(gone, range(ck.a, ck.a + ck.n)) THEN NULL ELSE list_filter(there, lambda v: NOT list_has_any(come, range(v, v + ck.n)))[1] END AS b FROM ct JOIN ck ON ck.pair_id = ct.pair_id AND ck.k = ct.k + 1))),
  cv AS (SELECT ck.pair_id, CAST(a AS INTEGER) AS start_old, CAST(b AS INTEGER) AS start_new, CAST(n AS INTEGER) AS size FROM ct JOIN ck USING (pair_id, k) WHERE hit)"""


@query(f"WITH RECURSIVE {EDITED}, {_CONTENT_MOVES} SELECT pair_id, start_old, start_new, size FROM cv")
def content_moves(spark, d):
    return late_moves.content_moves(*_edited(spark, d))


@query(f"""WITH RECURSIVE {POSITIONAL}, fn AS (SELECT *, row_number() OVER (PARTITION BY pair_id, block_id, op ORDER BY seq) AS k FROM pb),
  fm AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.seq, b.seq) AS seq, CASE WHEN a.line IS NULL THEN 'added' WHEN b.line IS NULL THEN 'removed' ELSE 'modified' END AS c, a.old_no, b.new_no FROM (SELECT * FROM fn WHERE op = '-') a FULL JOIN (SELECT * FROM fn WHERE op = '+') b ON a.pair_id = b.pair_id AND a.block_id = b.block_id AND a.k = b.k),
  {_CONTENT_MOVES}, fl AS (SELECT pair_id, c, CASE WHEN (c = 'removed' AND EXISTS (SELECT 1 FROM cv WHERE cv.pair_id = fm.pair_id AND old_no >= start_old AND old_no < start_old + size)) OR (c = 'added' AND EXISTS (SELECT 1 FROM cv WHERE cv.pair_id = fm.pair_id AND new_no >= start_new AND new_no < start_new + size)) THEN 'moved' ELSE c END AS k FROM fm
    UNION ALL SELECT pair_id, 'unchanged', 'unchanged' FROM pe WHERE op = '=')
SELECT pair_id, count(*) AS total_changes, count(*) FILTER (k = 'added') AS added, count(*) FILTER (k = 'removed') AS removed, count(*) FILTER (k = 'modified') AS modified, count(*) FILTER (k = 'moved') AS moved, count(*) FILTER (k = 'unchanged') AS unchanged FROM fl GROUP BY 1""")
def late_move_stats(spark, d):
    """Statistics of the degraded comparison by number after the late moves of content are applied. Documents whose number repeats or is missing are compared as tables of lines, where those of one number meet."""
    docs = _docs(spark, d).select("doc_id", "text")
    met = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("k")), "repeated")
    if met.isEmpty():
        return late_moves.positional_stats(src.edited_pairs(src.spread(docs)))
    one, more = (docs.join(met, docs["doc_id"].eqNullSafe(met["k"]), how) for how in ("left_anti", "left_semi"))
    old, new = src.edited_lines(more)
    tables = cmp.stats(late_moves.apply_moves(cmp.classify_fast(positional(old, new)), late_moves.as_ranges(late_moves.content_moves(old, new))))
    return late_moves.positional_stats(src.edited_pairs(one)).unionByName(tables)


# two passes


@query(f"WITH {EDITED} SELECT DISTINCT pair_id, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS further FROM ol")
def two_pass_agrees(spark, d):
    """Rows of the one-pass edit script that two passes don't give, and the other way round."""
    key = ["pair_id", "seq", "op", "old_no", "new_no", "line"]
    one = align.line_edits(src.edited_pairs(_docs(spark, d))).select(*key)
    two = align.two_pass_edits(*_edited(spark, d)).select(*key)
    n = one.withColumn("n", F.lit(1)).union(two.withColumn("n", F.lit(-1))).groupBy(*key).agg(F.sum("n").alias("n"))
    return n.groupBy("pair_id").agg(F.sum(F.greatest("n", F.lit(0))).alias("missing"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("further"))


@query(f"WITH {EDITED} SELECT pair_id, line_no, line FROM nl")
def two_pass_keeps_new(spark, d):
    return align.two_pass_edits(*_edited(spark, d)).where("op != '-'").select("pair_id", F.col("new_no").alias("line_no"), "line")


# changes inside regions of lines, as C

_C_REGION = r"""\"(?:[^\"\\]|\\.)*\"|''(?:[^''\\]|\\.)*''|//.*|/\*(?s:.*?)(?:\*/|$)"""
_SIDE = "SELECT pair_id, line_no, CASE WHEN starts_with(v, '/') THEN 'comment' ELSE 'string' END AS type, v, row_number() OVER (PARTITION BY pair_id, line_no, starts_with(v, '/') ORDER BY i) AS k FROM (SELECT pair_id, line_no, unnest(regexp_extract_all({0}, '" + _C_REGION + "')) AS v, generate_subscripts(regexp_extract_all({0}, '" + _C_REGION + "'), 1) AS i FROM fc)"


@query(f"WITH {_FACE}, ra AS ({_SIDE.replace('{0}', 'x')}), rb AS ({_SIDE.replace('{0}', 'y')}) SELECT coalesce(ra.pair_id, rb.pair_id) AS pair_id, coalesce(ra.line_no, rb.line_no) AS line_no, coalesce(ra.type, rb.type) AS type, ra.v AS removed, rb.v AS added FROM ra FULL JOIN rb ON ra.pair_id = rb.pair_id AND ra.line_no = rb.line_no AND ra.type = rb.type AND ra.k = rb.k WHERE ra.v IS DISTINCT FROM rb.v")
def nested_region_diffs(spark, d):
    x = _facing(spark, d).withColumn("n", F.explode(reg.nested_diffs("old_line", "new_line", F.lit("c"))))
    return x.select("pair_id", "line_no", "n.type", "n.removed", "n.added")
