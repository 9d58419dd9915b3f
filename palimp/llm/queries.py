"""The registered queries of the operators, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, ngram_join, pitman_yor, quality, reshard, topk, toxicity, url_reputation, warc
from .labelled import crc_of_id
from .shared import table

TOKENIZER = "byte_bpe_50k.json"
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
NGRAM_WORDS, NGRAM_PERCENT = 4, 85
OLD_SHARDS, NEW_SHARDS = 16, 24


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *(F.round(c, 4).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def op2_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"), crc_of_id(F.col("doc_id")) % 5 == 1)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), NGRAM_WORDS, NGRAM_PERCENT)


def op4_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reshard.shard_documents(table(spark, sf_dir, "documents"), OLD_SHARDS, NEW_SHARDS)
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _classified(docs: DataFrame, scored: DataFrame, held_out, accept: float) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def op5_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), crc_of_id(F.col("doc_id")) % 4 == 2
    model = quality.learn_quality(docs, table(spark, sf_dir, "labels"), ~held)
    return _classified(docs, quality.score_quality(docs, model), held, quality.ACCEPT)


def op6_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), crc_of_id(F.col("doc_id")) % 3 == 1
    model = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels"), ~held)
    return _classified(docs, toxicity.score_toxicity(docs, model), held, toxicity.ACCEPT)


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, good of each page whose document has a quality label: the page's path ends in the document's number."""
    number = F.regexp_extract(url_reputation.path_of(F.col("url")), r"^/[a-z]+/([0-9]+)", 1)
    known = pages.select(url_reputation.host_of(F.col("url")).alias("host"), F.when(number != "", number).try_cast("long").alias("doc_id")).where("doc_id is not null")
    return known.join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id").select("host", "good")


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_reputation.judge_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels")), RULES)


def op10_prefix_dp_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_benchmark_decontamination, op2_pitman_yor_lm, op3_ngram_jaccard_join, op4_flow_resharding, op5_line_crf_quality, op6_norm_bucket_topk, op7_warc_round_trip, op8_crf_toxicity, op9_host_reputation, op10_prefix_dp_bpe, pipeline)}

_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')"
# passages of 4 * 64 * 2^c words at every half of that, for items of 64 * 2^c words at most; BM25 of the passage's words over that of the item's own; the best passage that holds 0.8 of the item's shingles
OP1_SQL = f"""
WITH it AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
     ic AS (SELECT item_id, w, len(w) AS n, CASE WHEN len(w) <= 64 THEN 0 ELSE CAST(floor(log2((len(w) - 1) // 64)) AS INTEGER) + 1 END AS c FROM it WHERE len(w) > 0),
     iz AS (SELECT c, count(*) AS items, avg(n) AS mean FROM ic GROUP BY c),
     tf AS (SELECT item_id, c, n, t, count(*) AS tf FROM (SELECT item_id, c, n, unnest(w) AS t FROM ic) GROUP BY 1, 2, 3, 4),
     df AS (SELECT c, t, count(*) AS df FROM tf GROUP BY 1, 2),
     im AS (SELECT item_id, c, t, ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) AS w FROM tf JOIN df USING (c, t) JOIN iz USING (c)),
     ix AS MATERIALIZED (SELECT item_id, c, t, w / sum(w) OVER (PARTITION BY item_id) AS w FROM im),
     dw AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
     cl AS (SELECT c, 128 * (1 << c) AS step FROM iz),
     pa AS MATERIALIZED (SELECT doc_id, c, p, w[p * step + 1 : (p + 2) * step] AS w, len(w) AS whole FROM (SELECT doc_id, c, step, w, unnest(range(0, greatest((len(w) + step - 1) // step - 1, 1))) AS p FROM dw, cl WHERE len(w) > 0)),
     sc AS (SELECT doc_id, p, c, item_id, sum(ix.w) AS score FROM (SELECT DISTINCT doc_id, p, c, unnest(w) AS t FROM pa) x JOIN ix USING (c, t) GROUP BY 1, 2, 3, 4),
     ih AS MATERIALIZED (SELECT DISTINCT item_id, c, n, unnest(list_transform(range(1, greatest(n - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM ic),
     ik AS (SELECT item_id, count(*) AS k FROM ih GROUP BY 1),
     ov AS (SELECT doc_id, p, x.c, item_id, n, whole, any_value(words) AS words, count(*) AS hit FROM (SELECT DISTINCT doc_id, c, p, whole, len(w) AS words, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM pa) x JOIN ih ON ih.c = x.c AND ih.s = x.s GROUP BY 1, 2, 3, 4, 5, 6),
     ok AS (SELECT doc_id, item_id, score, hit / k AS question_overlap, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, hit DESC) AS r FROM ov JOIN ik USING (item_id) JOIN sc USING (doc_id, p, c, item_id) WHERE 10 * hit >= 8 * k AND (n >= 5 OR n = whole))
SELECT doc_id, item_id, round(score, 4) AS score, round(question_overlap, 4) AS question_overlap, CAST(1 AS DOUBLE) AS answer_overlap FROM ok WHERE r = 1
"""

# classes of equal shingle sets, overlaps by a join on shingles, and the smallest id that recursion reaches over links
OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {NGRAM_WORDS - 1}, least(len(w), 1)) + 1), lambda i: array_to_string(w[i : i + {NGRAM_WORDS - 1}], ' ')))) AS s FROM w),
     d AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS cls, s FROM s),
     c AS MATERIALIZED (SELECT cls, any_value(n) AS n, any_value(s) AS s, count(*) AS copies, min(doc_id) AS low FROM d WHERE n > 0 GROUP BY cls),
     g AS MATERIALIZED (SELECT cls, n, unnest(s) AS g FROM c),
     o AS (SELECT a.cls AS a, b.cls AS b FROM g a JOIN g b ON a.g = b.g AND a.cls <> b.cls AND a.n * 100 >= b.n * {NGRAM_PERCENT} AND b.n * 100 >= a.n * {NGRAM_PERCENT} GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= {NGRAM_PERCENT} * (a.n + b.n - count(*))),
     r(cls, root) AS (SELECT cls, cls FROM c UNION SELECT o.b, r.root FROM r JOIN o ON o.a = r.cls),
     k AS (SELECT root AS cls, min(low) AS component_id FROM r JOIN c USING (cls) GROUP BY root),
     l AS (SELECT a AS cls, sum(copies) AS links FROM o JOIN c ON c.cls = o.b GROUP BY a)
SELECT doc_id, d.n AS n_shingles, coalesce(component_id, doc_id) AS component_id, CAST(coalesce(links, 0) + coalesce(copies, 1) - 1 AS BIGINT) AS n_links FROM d LEFT JOIN k USING (cls) LEFT JOIN l USING (cls) LEFT JOIN c USING (cls)
"""

OP6_SQL = """
WITH w AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
     bad AS (SELECT vec_id FROM w WHERE x IS NULL OR NOT isfinite(x)),
     u AS (SELECT vec_id, CAST(floor(64 * x) AS BIGINT) AS x, i FROM w WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM u q JOIN u c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha256(h) AS g FROM p),
     f AS (SELECT g, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY g HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, d.g AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.g = f.g AND n >= 100
"""

_LEVEL_SQL = """
     {name}_r AS (SELECT {low} AS lo, greatest(least(coalesce((sum(n * (x / n - q) * (x / n - q)) / nullif(sum(q * (1 - q)), 0) - 1) / nullif(avg(n) - 1, 0), {low}), 0.999), {low}) AS rho FROM {name}_q),
     {name}_p AS (SELECT k, (x + (1 - rho) / rho * q) / (n + (1 - rho) / rho) AS mean, n + (1 - rho) / rho AS weight FROM {name}_q, {name}_r)"""
_RULE_SQL = " ".join(f"WHEN (host = '{r[: r.index('/')]}' OR suffix(host, '.{r[: r.index('/')]}')) AND prefix(path, '{r[r.index('/') :]}') THEN '{r}'" for r in sorted(RULES, key=lambda r: (-len(r), r)))
_VERDICT_SQL = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items())
_SUFFIX_SQL = ", ".join(f"'{x}'" for x in url_reputation.SUFFIXES)
OP9_SQL = f"""
WITH a AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
     o AS (SELECT host, l.quality AS good FROM a JOIN labels l ON l.doc_id = try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') AS BIGINT) WHERE l.quality IS NOT NULL),
     hn AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '[.]+$', '') AS name FROM (SELECT host FROM a UNION SELECT host FROM o)),
     hl AS (SELECT host, name, string_split(name, '.') AS l, regexp_matches(name, '^([0-9]+([.][0-9]+){{3}}|[[].*[]])$') AS ip FROM hn),
     hd AS (SELECT host, CASE WHEN ip THEN name WHEN array_to_string(l[-2:], '.') IN ({_SUFFIX_SQL}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suf,
                   CASE WHEN ip THEN name WHEN array_to_string(l[-2:], '.') IN ({_SUFFIX_SQL}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM hl),
     h AS (SELECT host, domain, suf, CAST(count(*) AS DOUBLE) AS n, CAST(sum(good) AS DOUBLE) AS x FROM o JOIN hd USING (host) GROUP BY host, domain, suf),
     g AS (SELECT (coalesce(sum(x), 0) + 1) / (coalesce(sum(n), 0) + 2) AS q, coalesce(sum(n), 0) + 2 AS w FROM h),
     s_q AS (SELECT suf AS k, sum(n) AS n, sum(x) AS x, (SELECT q FROM g) AS q FROM h GROUP BY suf),{_LEVEL_SQL.format(name="s", low=0.001)},
     d_q AS (SELECT domain AS k, sum(n) AS n, sum(x) AS x, mean AS q FROM h JOIN s_p ON s_p.k = h.suf GROUP BY domain, mean),{_LEVEL_SQL.format(name="d", low=0.001)},
     h_q AS (SELECT host AS k, n, x, mean AS q FROM h JOIN d_p ON d_p.k = h.domain),{_LEVEL_SQL.format(name="h", low=0.001)},
     b AS (SELECT page_id, host, path, CASE {_RULE_SQL} END AS rule,
                  coalesce(h_p.mean, d_p.mean, s_p.mean, (SELECT q FROM g)) AS mean, coalesce(h_p.weight, d_p.weight, s_p.weight, (SELECT w FROM g)) AS weight
           FROM a JOIN hd USING (host) LEFT JOIN h_p ON h_p.k = host LEFT JOIN d_p ON d_p.k = domain LEFT JOIN s_p ON s_p.k = suf)
SELECT page_id, host, path, rule, coalesce(CASE rule {_VERDICT_SQL} END, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict FROM b
"""

ORACLES: dict[str, str] = {"op1_benchmark_decontamination": OP1_SQL, "op3_ngram_jaccard_join": OP3_SQL, "op6_norm_bucket_topk": OP6_SQL, "op7_warc_round_trip": OP7_SQL, "op9_host_reputation": OP9_SQL}
