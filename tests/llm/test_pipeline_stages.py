"""Every stage of the pipeline on odd rows (nulls, empty and very long texts, repeated rows, further columns with clashing names) and on an empty table, against brute force."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import brute_leaks

import corpus_pipeline
from palimp.llm import quality, toxicity
from palimp.llm.labelled import crc_of_id
from palimp.llm.queries import tokenizer_path

rng = random.Random(12)
VOCABULARY = [a + b for a in ("ta", "re", "mo", "li", "su") for b in ("n", "sk", "per", "do", "vel")]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


BASE = prose(150)
ITEM = prose(30)


def edited(k):
    w = BASE.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE two"), (None, "a null id with words of its own"), (None, "a null id with words of its own"), (7, "same row twice here"), (7, "same row twice here"), (7, "another text under the id seven")]
ROWS += [(8, "long " + prose(60_000)), (9, f"{prose(20)} {ITEM} {prose(10)}"), (10, f"{ITEM} worthless idiot scum idiot"), (11, "$$$ ### @@@ *** " * 40), (12, None), (12, "")]
ROWS += [(20 + i, edited(i % 12)) for i in range(25)] + [(100 + i, prose(40) + (" idiot scum worthless idiot" if i % 3 == 0 else "")) for i in range(90)] + [(300 + i, "%%% &&& !!! ### " * (5 + i)) for i in range(20)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for c in ("lang", "source", "n_chars", "score", "hash", "cls", "component_id", "n_shingles", "item", "n_tokens", "y", "quality"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i < 300), int(100 <= i < 300 and (i - 100) % 3 == 0)) for i, _ in ROWS if i is not None and i >= 20] + [(None, 1, 1), (4, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, "not there at all in any text"), (3, None), (4, ""), (5, "two")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rows(df):
    return sorted(str((r["doc_id"], r["text"])) for r in df.collect())


def of(pairs):
    return sorted(str(x) for x in pairs)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_empty_table(spark, folder, stage):
    docs = table(spark, folder, "documents")
    out = stage[1](spark, docs.limit(0), folder)
    assert out.count() == 0 and (stage[0] == "bpe" or out.columns == docs.columns)


def test_quality_and_toxicity(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    good = quality.learn_quality(docs, labels, crc_of_id(F.col("doc_id")) % 4 != 2)
    bad = toxicity.learn_toxicity(docs, labels, crc_of_id(F.col("doc_id")) % 3 != 1)
    for stage, model, keep in ((corpus_pipeline.keep_quality, good, lambda s: s >= 0.5), (corpus_pipeline.keep_harmless, bad, lambda s: s < toxicity.ACCEPT)):
        want = [(i, t) for i, t in ROWS if keep(model.score(pa.array([t], pa.string()))[0])]
        out = stage(spark, docs, folder)
        assert rows(out) == of(want) and out.columns == docs.columns and 0 < len(want) < len(ROWS)
        assert out.where("source != 'clash'").count() == 0


def test_one_row_of_each_group_stays(spark, folder):
    docs = table(spark, folder, "documents")
    out = corpus_pipeline.keep_distinct(spark, docs, folder)
    sets = []
    for _, t in ROWS:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    lead = list(range(len(ROWS)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in range(len(ROWS)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                lead[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(ROWS)):
        groups.setdefault(find(i), set()).add(str(ROWS[i]))
    left = rows(out)
    assert len(left) == len(groups) and all(sum(x in g for x in set(left)) >= 1 for g in groups.values()) and out.columns == docs.columns
    lowest = [min((ROWS[i][0] for i in range(len(ROWS)) if find(i) == r), key=lambda x: (x is not None, x or 0)) for r in groups]
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(map(str, lowest))


def test_decontamination(spark, folder):
    docs = table(spark, folder, "documents")
    bad = {i for i, _ in brute_leaks(list(enumerate(t for _, t in ROWS)), [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()])}
    out = corpus_pipeline.keep_uncontaminated(spark, docs, folder)
    assert rows(out) == of(x for i, x in enumerate(ROWS) if i not in bad) and len(bad) == 2 and out.columns == docs.columns


def test_encode(spark, folder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    out = corpus_pipeline.encode(spark, table(spark, folder, "documents"), folder).collect()
    want = sorted(str((i, len(ids := t.encode(x or "", add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())) for i, x in ROWS)
    assert sorted(str((r["doc_id"], r["n_tokens"], r["ids_sha256"])) for r in out) == want


def test_run_is_the_stages_in_turn(spark, folder):
    docs = table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
