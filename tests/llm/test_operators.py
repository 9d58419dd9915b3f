"""Operators against brute force, on odd rows: nulls, empty and long texts, repeated rows, empty tables, further columns with clashing names."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimp.llm import bpe, decontaminate, ngram_join, pitman_yor, quality, reshard, topk, toxicity, url_reputation, warc
from palimp.llm.queries import tokenizer_path

random.seed(3)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
BASE = [random.choice(WORDS) + str(random.randint(0, 99)) for _ in range(120)]


def edited(k):
    w = list(BASE)
    for _ in range(k):
        w[random.randrange(len(w))] = f"x{random.random()}"
    return " ".join(w)


ROWS = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "ONE  two"), (6, "word " * 30000), (None, "a null id with some words"), (8, "repeated row here now"), (8, "repeated row here now")]
ROWS += [(10 + i, edited(i % 9)) for i in range(40)]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("cls", "sig", "root", "size", "shard", "score", "n", "crc"):  # clashing names
        d = d.withColumn(c, F.lit("clash"))
    return d


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


def brute_components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                at[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        low[r] = min((x for x in (low.get(r), k) if x is not None), default=None)
    return sorted((k is None, k or 0, len(sets[i]), low[find(i)] or 0) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (3, 50)])
def test_ngram_join(docs, words, percent):
    got = ngram_join.ngram_join(docs, words, percent).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == brute_components(ROWS, words, percent)


def test_ngram_join_empty(spark):
    assert ngram_join.ngram_join(empty(spark)).count() == 0


def brute_leaks(rows, items):
    """Passages of 256 words at every 128th (items of 64 words at most); shares of different shingles; shorter items only where they are the whole text."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found = set()
    for i, t in items:
        w = words(t)
        want = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        for d, x in rows:
            v = words(x)
            for a in range(0, max(1, len(v) - 128), 128):
                near = v[a : a + 256]
                if w and (len(w) < 5 and near == w == v or want and 10 * len(want & {tuple(near[j : j + 5]) for j in range(len(near) - 4)}) >= 8 * len(want)):
                    found.add((d, i))
    return found


def test_leaks_of_templates_and_edits():
    """Items that share most of their words, their edits, short ones, repeated words: the same pairs as brute force."""
    rng = random.Random(9)
    frame = [f"t{i}" for i in range(54)]
    items = [" ".join([f"a{i}x{j}" for j in range(5)] + frame + [f"b{i}x{j}" for j in range(5)]) for i in range(80)]
    items += [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 64))) for _ in range(120)] + ["the", "one two three four", "x y z x y z x y z x y z", "w " * 30]
    texts = ["the", "The end", "one two three four", "one two three four five", "w " * 500, "x y z " * 90, ""]
    for _ in range(250):
        w = rng.choice(items).split()
        for _ in range(rng.randint(0, 9)):
            w[rng.choice((0, -1, rng.randrange(len(w))))] = f"new{rng.random()}"
        texts.append(" ".join([rng.choice(frame) for _ in range(rng.choice((0, 20, 200)))] + w + [rng.choice("abcdefgh") for _ in range(rng.choice((0, 100, 300)))]))
    got = {(d, i) for d, i, *_ in decontaminate.leaks(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), decontaminate.build_indexes([(t, None) for t in items], 5), 0.8)}
    want = brute_leaks(list(enumerate(texts)), list(enumerate(items)))
    assert got == want and len(want) > 1000


def test_repeated_items(spark, docs):
    items = spark.createDataFrame([(1, " ".join(BASE[5:40])), (2, " ".join(BASE[5:40])), (None, " ".join(BASE[5:40])), (4, " ".join(BASE))], "item_id long, text string")
    got = decontaminate.find_leaks(docs.where("doc_id = 10"), items).collect()
    assert sorted(str(r["item_id"]) for r in got) == ["1", "2", "4", "None"]


def test_leaks(spark, docs):
    items = spark.createDataFrame([(1, " ".join(BASE[5:40])), (2, "never seen anywhere at all"), (3, None), (4, "one two"), (5, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == brute_leaks(ROWS, [(r["item_id"], r["text"]) for r in items.collect()]) and (4, 4) in got and (10, 1) in got
    left = {r["doc_id"] for r in decontaminate.drop_leaks(docs, items).collect()}
    assert left == {k for k, _ in ROWS} - {k for k, _ in got}
    assert decontaminate.find_leaks(empty(spark), items).count() == 0 and decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def test_block_max_wand_is_exact():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 60))), None) for _ in range(700)]
    (ix,) = decontaminate.build_indexes(items, 5)
    for least in (0.3, 0.6, 1.0):
        p, t = [], []
        for q in range(50):
            terms = sorted(rng.sample(range(len(ix.terms)), rng.randint(1, 50)))
            p += [q] * len(terms)
            t += terms
        p, t = np.array(p), np.array(t)
        want = set()
        for q in range(50):
            score = np.zeros(len(ix.item))
            for x in t[p == q]:
                a, b = ix.ptr[x], ix.ptr[x + 1]
                score[ix.rows[a:b]] += ix.impact[a:b]
            want |= {(q, int(i)) for i in np.flatnonzero(score >= least - 1e-4)}
        got = set(zip(*(x.tolist() for x in decontaminate.block_max_wand(p, t, ix, least)[:2]), strict=True))
        assert got == want and want


def test_language_model(spark, docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = pitman_yor.score_texts(docs, held).collect()
    keep = lambda k: k is None or zlib.crc32(str(k).encode()) % 5 != 1
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    count = {}
    for k, t in ROWS:
        if keep(k):
            for w in tokens(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted((k is None, k or 0, len(tokens(t)), sum(w in count for w in tokens(t)), round(sum(np.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for k, t in ROWS)
    have = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got)
    assert [x[:4] for x in have] == [x[:4] for x in want] and np.allclose([x[4] for x in have], [float(x[4]) for x in want])
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got if not r["held_out"]) > sum(r["base_score"] for r in got if not r["held_out"])
    assert pitman_yor.score_texts(empty(spark), held).count() == 0


def test_context_probabilities_add_up():
    rng = np.random.default_rng(0)
    pair = np.unique(rng.integers(0, 400, 150))
    p = pitman_yor.context_probabilities(pair, rng.integers(1, 50, len(pair)), 20)
    assert np.allclose((10.0**p).sum(1), 1, atol=1e-3)


@pytest.mark.parametrize("rows", [ROWS[:5], [r for r in ROWS if r[0] is not None]])
def test_reshard(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    got = reshard.shard_documents(d, 3, 5).collect()
    assert sorted((r["doc_id"], r["size"], r["crc"]) for r in got) == sorted((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in rows)
    for s in range(5):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_reshard_empty_and_null(spark, docs):
    assert reshard.shard_documents(empty(spark), 3, 5).count() == 0
    assert reshard.shard_documents(docs, 3, 5).count() == len(ROWS)


def test_flow_is_cheapest():
    flows = reshard.min_cost_flow([10, 30, 5], [15, 15, 15], lambda i, j: int(i != j))
    assert sum(x for (i, j), x in flows.items() if i != j) == 15 and sum(flows.values()) == 45


def test_quality_and_toxicity(spark, docs):
    labels = spark.createDataFrame([(10 + i, i % 2, int(i % 4 == 0)) for i in range(40)] + [(None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    for learn, score in ((quality.learn_quality, quality.score_quality), (toxicity.learn_toxicity, toxicity.score_toxicity)):
        for sample in (labels, labels.limit(0)):
            got = score(docs, learn(docs, sample, F.lit(True))).collect()
            assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
        assert score(empty(spark), learn(docs, labels, F.lit(True))).count() == 0


def test_toxic_spans():
    good = ["the cat sat on the mat today " * 3] * 1 + [f"plain words number {i} are here" for i in range(40)]
    bad = [f"plain words number {i} you Idiot are here" for i in range(30)]
    model = toxicity.fit_toxicity([(t, 0) for t in good] + [(t, 1) for t in bad])
    score, doc, ends, _, tok = model.spans(pa.array(["über such an idiot!", "such a nice day", "", None]))
    assert score[0] > 0.7 and score[1] < 0.3 and score[2] == score[3] == 0
    assert bytes(tok.data[tok.start[ends[0, 0]] : tok.end[ends[0, 1]]]) == b"idiot"


def test_forward_backward_against_enumeration():
    from itertools import product

    from palimp.llm.crf import forward_backward

    rng = np.random.default_rng(1)
    off = np.array([0, 1, 1, 6, 13])
    u, t = rng.normal(size=13), rng.normal(size=(2, 2))
    p, e = forward_backward(u, off, t, 3, True)
    want, pairs = np.zeros(13), np.zeros((2, 2))
    for a, b in zip(off[:-1], off[1:], strict=True):
        total, x, c = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in product((0, 1), repeat=b - a):
            w = np.exp(sum(u[a + i] * y[i] for i in range(b - a)) + sum(t[y[i], y[i + 1]] for i in range(b - a - 1)))
            total += w
            x += w * np.array(y)
            for i in range(b - a - 1):
                c[y[i], y[i + 1]] += w
        if b > a:
            want[a:b] = x / total
            pairs += c / total
    assert np.allclose(p, want) and np.allclose(e, pairs)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, []), (304, [1.0]), (305, [0.0] * 8), (306, rng.normal(size=8).tolist()), (306, [2.0] * 8)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0", 7)
    m = {}
    clean = [(i, np.floor(64 * np.pad(np.array(v, float), (0, 8 - len(v)))).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, q in clean:
        if i % 20 == 0:
            best = sorted((-int(q @ v), j) for j, v in clean if j != i)[:7]
            m |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(best)}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got.collect()} == m
    assert topk.top_k(empty(spark, "vec_id long, embedding array<double>"), "vec_id % 20 = 0", 7).count() == 0


def test_warc(spark):
    rows = [(i, f"http://h/{i}", "x" * 50 if i % 5 == 0 else "long payload " * 20 if i % 3 == 0 else f"own {i} " * 40) for i in range(60)] + [(60, None, None), (61, "http://h/\n a", ""), (None, "u", "long payload " * 20)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), split=1000).collect()
    first = min(i for i, _, h in rows if h == "long payload " * 20 and i is not None)
    want = []
    for i, _, h in rows:
        h = h or ""
        again = h == "long payload " * 20 and i != first
        want.append((str(i), len(h), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", str(first if again else None)))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)


@pytest.mark.parametrize("split", [1, 7, 100, 5000])
def test_warc_ranges_own_each_record_once(split):
    data = b"".join(warc.build_record(i, "u", b"\x1f\x8b\x08" * (i * 9), "d", None, False, "d") for i in range(12))
    starts = [p for a in range(0, len(data), split) for p, _, _ in warc.records_of_range(io.BytesIO(data), len(data), a, min(a + split, len(data)))]
    assert len(starts) == len(set(starts)) == 12


def test_urls(spark):
    rules = {"org/": "allow", "example.org/es/": "block", "com/fr/": "allow", "com/de/": "block"}
    rows = [(1, "http://A.Example.ORG/es/1?x"), (2, "http://b.org/x"), (3, "nothing"), (4, None), (5, "http://c.com/de/2"), (6, "http://good.net/a"), (7, "http://bad.net/a#b"), (8, "http://org"), (8, "http://org")]
    good = spark.createDataFrame([("good.net", 1)] * 50 + [("bad.net", 0)] * 50 + [(None, 1), ("x.net", None)], "host string, good int")
    got = {r["page_id"]: r for r in url_reputation.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), good, rules).collect()}
    assert (got[1]["rule"], got[1]["verdict"], got[1]["host"], got[1]["path"]) == ("example.org/es/", "block", "a.example.org", "/es/1")
    assert got[2]["rule"] == "org/" and got[3]["host"] == got[4]["host"] == "" and got[5]["verdict"] == "block" and got[8]["rule"] is None
    assert (got[6]["verdict"], got[7]["verdict"]) == ("allow", "block")


def test_registered_domains(spark):
    names = {"user:pw@www.Shop.co.uk:8080": ("shop.co.uk", "co.uk"), "a.b.example.org.": ("example.org", "org"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "[::1]": ("[::1]", "[::1]"), "localhost": ("localhost", "localhost"), "co.uk": ("co.uk", "co.uk"), "": ("", "")}
    host = F.lower(F.col("h"))
    got = spark.createDataFrame([(k,) for k in names], "h string").select("h", url_reputation.domain_of(url_reputation.name_of(host)).alias("d"), url_reputation.suffix_of(url_reputation.name_of(host)).alias("s")).collect()
    assert {r["h"]: (r["d"], r["s"]) for r in got} == names


def test_ties_at_the_last_rank(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100 + i, [100000.0, 0.0]) for i in range(3)] + [(None, [9.0, 9.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("bid", "n", "block", "score", "rank", "id", "q", "norm"):
        d = d.withColumn(c, F.lit("clash"))
    got = topk.top_k(d, "vec_id % 20 = 0", 5).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by == {0: [100, 101, 102, 1, 2], 20: [100, 101, 102, 0, 1], 100: [101, 102, 0, 1, 2]}


def test_warc_of_nothing_and_of_clashing_columns(spark):
    schema = "page_id long, url string, html string"
    assert warc.round_trip(empty(spark, schema)).count() == 0
    d = spark.createDataFrame([(1, "u", "x" * 200), (2, "u", "x" * 200)], schema)
    for c in ("digest", "large", "same", "first", "revisit", "n"):
        d = d.withColumn(c, F.lit("clash"))
    assert sorted(tuple(r)[3:] for r in warc.round_trip(d).collect()) == [("response", None), ("revisit", 1)]
    manifest = warc.write_warc(d, warc.fresh_dir(spark, "warc-test"))
    folder = manifest.first()["path"].rsplit("/", 1)[0]
    full = warc.read_warc(warc.list_files(spark, folder), split=50).collect()
    assert sorted((r["type"], r["payload"], r["intact"]) for r in full) == [("response", bytearray(b"x" * 200), True), ("revisit", None, True)]
    assert warc.read_warc(warc.list_files(spark, folder), split=50).rdd.getNumPartitions() >= 3


def test_urls_of_nothing_and_of_clashing_columns(spark):
    good = spark.createDataFrame([], "host string, good int")
    assert url_reputation.judge_urls(empty(spark, "page_id long, url string"), good, {}).count() == 0
    d = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    for c in ("host", "path", "rule", "verdict", "mean", "weight", "domain", "suffix"):
        d = d.withColumn(c, F.lit("clash"))
    r = url_reputation.judge_urls(d, good, {}).first()
    assert (r["host"], r["path"], r["rule"]) == ("a.b", "/c", None)


def test_bpe_of_nothing_and_of_clashing_columns(spark):
    assert bpe.encode_digest(empty(spark), tokenizer_path()).count() == 0
    d = spark.createDataFrame([(1, "text"), (1, "text"), (None, None)], SCHEMA).withColumn("n_tokens", F.lit("clash")).withColumn("ids_sha256", F.lit("clash"))
    got = bpe.encode_digest(d, tokenizer_path()).collect()
    assert len(got) == 3 and sorted(r["n_tokens"] for r in got)[0] == 0


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    coder = bpe.BytePairCoder(open(path, "rb").read())
    texts = ["", "a" * 3000, "  x\n\n", "<|endoftext|>a<|endoftext|>", "naïve 😀 　\x1c", *("".join(random.choice("ab cé\n\t1'sre") for _ in range(random.randint(0, 50))) for _ in range(300))]
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert coder.encode_text(x) == ",".join(map(str, ids)) and coder.decode_text(coder.encode_text(x)) == t.decode(ids, skip_special_tokens=False)
    got = {r["doc_id"]: r for r in bpe.encode_digest(docs, path).collect()}
    for k, x in ROWS:
        assert got[k]["n_tokens"] == len(t.encode(x or "", add_special_tokens=False).ids) and got[k]["decoded_sha256"] == hashlib.sha256((x or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, path), path)
    assert sorted(str((r["doc_id"], r["text"])) for r in back.collect()) == sorted(str((k, x or "")) for k, x in ROWS)


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d)
    assert 0 < out.count() <= spark.read.parquet(f"{d}/documents.parquet").count()


def test_top_k_in_slices(spark, monkeypatch):
    """Buckets in many broadcasts, with ties, repeated ids, wide vectors and numbers beyond 2^52: the rows of brute force, and no bucket meets a block in a shuffle."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(topk, "BUCKET", 16)
    monkeypatch.setattr(topk, "QUERIES", 6)
    monkeypatch.setattr(topk, "SLICE", 30_000)
    for dim, size in ((300, 1.0), (4, 2.0**21)):
        e = np.round(rng.normal(size=(200, dim)) * rng.choice([0.2, 1, 3], (200, 1)), 1)
        e[50:60] = e[20]
        ids = [*range(199), 40]
        rows = spark.createDataFrame([(i, (x * size).tolist()) for i, x in zip(ids, e, strict=True)], "vec_id long, embedding array<double>")
        v = [[int(np.floor(64 * y)) for y in x * size] for x in e]
        want = []
        for i, x in zip(ids, v, strict=True):
            if i % 20 == 0:
                scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in zip(ids, v, strict=True) if j != i)
                want += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:7])]
        got = topk.top_k(rows, "vec_id % 20 = 0", 7)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
