"""Moves after the comparison, patience rows and block signatures, against brute force and small cases."""

import random

import pytest

from palimp.functions.edit import script_of, shortest_matches
from palimp.functions.tokens import lcs_length
from palimp.operators import align, late_moves
from palimp.operators.matching import block_moves, greedy_pairs

OLD = "import os\n\ndef first(a):\n    b = a + 1\n    return b\n\ndef second(x):\n    y = x * 2\n    z = y + 3\n    w = z - 1\n    v = w * 5\n    u = v + 8\n    return u"
NEW = "import os\n\ndef second(x):\n    y = x * 2\n    z = y + 4\n    w = z - 1\n    v = w * 5\n    u = v + 8\n    return u\n\ndef first(a):\n    b = a + 1\n    return b"


def lines(spark, texts):
    rows = [(k, i, x) for k, t in texts for i, x in enumerate(t.split("\n"))]
    return spark.createDataFrame(rows, "pair_id long, line_no int, line string")


def brute(old, new):
    """All windows against all windows."""
    content = lambda w: sorted(x.strip() for x in w if x.strip())
    gone, come, out = set(), set(), set()
    for size in range(10, 0, -1):
        for i in range(len(old) - size + 1):
            if gone & set(range(i, i + size)) or len("\n".join(x.strip() for x in old[i : i + size]).strip()) < 10:
                continue
            for j in range(len(new) - size + 1):
                if not come & set(range(j, j + size)) and content(old[i : i + size]) == content(new[j : j + size]) and len("\n".join(x.strip() for x in new[j : j + size]).strip()) >= 10:
                    if i != j:
                        gone |= set(range(i, i + size))
                        come |= set(range(j, j + size))
                        out.add((i, j, size))
                    break
    return out


def test_content_moves(spark):
    rng = random.Random(5)
    words = ["alpha beta gamma", "delta epsilon", "  zeta eta theta", "", "short", "one more line of text"]
    cases = [(k, [rng.choice(words) for _ in range(rng.randrange(1, 16))], [rng.choice(words) for _ in range(rng.randrange(1, 16))]) for k in range(40)]
    got = late_moves.content_moves(lines(spark, [(k, "\n".join(a)) for k, a, _ in cases]), lines(spark, [(k, "\n".join(b)) for k, _, b in cases])).collect()
    for k, a, b in cases:
        assert {(r["start_old"], r["start_new"], r["size"]) for r in got if r["pair_id"] == k} == brute(a, b)


def test_node_moves(spark):
    t = spark.createDataFrame([(1, OLD, NEW), (2, "not ( python", "x"), (3, None, None)], "pair_id long, old string, new string")
    moves = late_moves.node_moves(late_moves.text_nodes(t, text_col="old"), late_moves.text_nodes(t, text_col="new"), 0.7)
    got = {(r["old_start"], r["old_end"], r["new_start"], r["new_end"], r["kind"]) for r in moves.collect()}
    assert got == {(2, 4, 10, 12, "moved"), (6, 12, 2, 8, "moved-modified")}
    rows = spark.createDataFrame([(1, 0, "removed", 2, None), (1, 1, "added", None, 11), (1, 2, "unchanged", 3, 3), (1, 3, "removed", 7, None), (1, 4, "removed", 0, None)], "pair_id long, seq int, classification string, old_no int, new_no int")
    assert [r[0] for r in late_moves.apply_moves(rows, moves).orderBy("seq").select("classification").collect()] == ["moved", "moved", "unchanged", "moved-modified", "removed"]


def test_empty(spark):
    none = lines(spark, [(1, "a")]).where("false")
    assert late_moves.content_moves(none, none).count() == 0 and align.patience_rows(none, none).count() == 0 and block_moves(none.selectExpr("pair_id", "'-' AS op", "line_no AS old_no", "line_no AS new_no", "line")).count() == 0


def test_patience_rows(spark):
    got = align.patience_rows(lines(spark, [(1, "a\nb\nc\nd\nd"), (2, "x")]), lines(spark, [(1, "c\na\nb\nd"), (2, "y\ny")])).collect()
    ops = {k: sorted(r["op"] for r in got if r["pair_id"] == k) for k in (1, 2)}
    assert ops == {1: sorted("==---++"), 2: sorted("-++")}


def test_greedy_pairs(spark):
    s = spark.createDataFrame([(1, 0, 0, 0, 0.6), (1, 0, 0, 1, 0.9), (1, 0, 1, 1, 0.95), (1, 0, 2, 2, 0.4), (1, 1, 5, 5, 0.5), (1, 1, 5, 6, 0.5)], "pair_id long, block_id long, old_no int, new_no int, sim double")
    assert {tuple(r) for r in greedy_pairs(s, 0.5).collect()} == {(1, 0, 1, 1, 0.95), (1, 0, 0, 0, 0.6), (1, 1, 5, 5, 0.5)}


@pytest.mark.parametrize("bits", [1, 60, 1 << 28])
def test_shortest_in_any_table(bits):
    rng = random.Random(bits)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(40))] for _ in range(2))
        m = shortest_matches(a, b, bits)
        assert all(a[i] == b[j] for i, j in m) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:], strict=False)) and len(m) == lcs_length(a, b)


def test_large_script():
    a = [str(i % 997) for i in range(20_000)]
    b = a[500:] + a[:500]
    s = script_of(a, b)
    assert [a[i] for _, i, _ in s if i is not None] == a and [b[j] for _, _, j in s if j is not None] == b


def test_both_signatures(spark):
    from palimp.functions.signature import form_signature, line_signature
    from palimp.functions.text import normal_form

    rng = random.Random(3)
    texts = ["", None, "a", "ab", " A ", "é😀", "😀", *("".join(rng.choice("abcXYZ é😀 1") for _ in range(rng.randrange(30))) for _ in range(200))]
    x = spark.createDataFrame([(t,) for t in texts], "t string")
    assert x.where(~line_signature(x.t).eqNullSafe(form_signature(normal_form(x.t)))).count() == 0


def test_moves_by_lines_not_by_combinations(spark):
    """Both moves against all old lines by all new ones, with the native measures; the plan joins no lines by their words."""
    from pyspark.sql import functions as F

    from palimp.functions.similarity import fast_line_similarity, patience_similarity
    from palimp.operators.matching import patience_moves, similar_moves

    rng = random.Random(8)
    words = ["Alpha", "beta", "gamma delta", "epsilon zeta eta theta iota", "x", "ÄÖ", "  ", "kappa lambda mu nu xi omicron pi rho sigma"]
    rows = [(p, rng.randrange(3), op, i if op == "-" else None, None if op == "-" else i, " ".join(rng.choices(words, k=rng.randrange(0, 6)))) for p in range(12) for op in "-+" for i in range(rng.randrange(0, 14))]
    rest = spark.createDataFrame(rows, "pair_id long, block_id long, op string, old_no int, new_no int, line string")
    both = rest.where("op = '-'").selectExpr("pair_id", "block_id ba", "old_no", "line x").join(rest.where("op = '+'").selectExpr("pair_id", "block_id bb", "new_no", "line y"), "pair_id")
    all_ = both.select("pair_id", "ba", "bb", "old_no", "new_no", patience_similarity(F.col("x"), F.col("y")).alias("p"), fast_line_similarity(F.col("x"), F.col("y")).alias("s"), (F.trim("x") != "").alias("u"), (F.trim("y") != "").alias("v")).collect()

    def greedy(rows):
        out, used = set(), set()
        for _, p, i, j, s in sorted(rows):
            if not used & {(p, "-", i), (p, "+", j)}:
                used |= {(p, "-", i), (p, "+", j)}
                out.add((p, i, j, round(s, 9)))
        return out

    shown = lambda df: {(*r[:3], round(r[3], 9)) for r in df.collect()}
    moves = patience_moves(rest)
    assert shown(moves) == greedy(((r.old_no, -r.p, r.new_no), r.pair_id, r.old_no, r.new_no, r.p) for r in all_ if r.p >= 0.8)
    assert "Join" not in moves._jdf.queryExecution().executedPlan().toString()
    for least in (0.5, 0.9):
        assert shown(similar_moves(rest, least)) == greedy(((-r.s, r.old_no, r.new_no), r.pair_id, r.old_no, r.new_no, r.s) for r in all_ if r.s >= least and r.u and r.v)
    assert shown(similar_moves(rest, 0.5, True)) == greedy(((-r.s, r.old_no, r.new_no), r.pair_id, r.old_no, r.new_no, r.s) for r in all_ if r.s >= 0.5 and r.u and r.v and r.ba != r.bb)


def odd_texts():
    rng = random.Random(13)
    words = ["alpha beta gamma", "delta epsilon", "  zeta eta theta ", "", " \t", "short", "one more line of text", "ends in VT\x0b", "123456789\x0b", "123456789 ", "trail   ", " nine char", "a b c d e\r", "ÄÖ 😀 ü line"]
    return ["\n".join(rng.choice(words) + rng.choice(["", "", " x"]) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["same line of text\n" * 300, "\n" * 30, "123456789\x0b\n" * 12, "".join(f"line number {i}\n" for i in range(250)), None, ""]


def test_stats_of_pairs_are_those_of_tables(spark):
    from pyspark.sql import functions as F

    from palimp.plans.compare import classify_fast, stats
    from palimp.plans.registry import positional

    texts = odd_texts()
    rng = random.Random(4)
    rows = [(k, t, t if k % 9 == 0 else rng.choice(texts) if k % 2 or t is None else "\n".join(sorted(t.split("\n"), key=lambda x: rng.random())[: rng.randrange(1, 80)])) for k, t in enumerate(texts)]
    p = spark.createDataFrame(rows, "pair_id long, old_text string, new_text string")
    got = late_moves.positional_stats(p)
    old, new = (lines(spark, [(r[0], r[c] or "") for r in rows]) for c in (1, 2))
    want = stats(late_moves.apply_moves(classify_fast(positional(old, new)), late_moves.as_ranges(late_moves.content_moves(old, new))))
    assert got.columns == want.columns and got.select(*(F.col(c) for c in want.columns)).dtypes == want.dtypes
    a, b = (sorted(tuple(r) for r in x.collect()) for x in (got, want))
    assert a == b and len(a) == len(rows) and sum(r[5] for r in a) > 50
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan
    assert late_moves.positional_stats(p.limit(0)).count() == 0


@pytest.mark.parametrize("ids", ["keys", "repeated and missing"])
def test_late_moves_of_odd_texts_and_sql(spark, tmp_path, ids):
    """Lines with white space that SQL doesn't trim, and document numbers that repeat or are null, against the SQL; documents of one number have equal lines, as the SQL leaves the order of others open."""
    import duckdb

    from palimp.plans.catalog import ORACLES, QUERIES

    rows = list(enumerate(odd_texts()))
    if ids != "keys":
        rows = [(None if k % 5 == 1 else k, t) for k, t in rows] + [(900, "same line of text\n" * 40), (900, "same line of text\n" * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("content_moves", "late_move_stats"):
        got, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name])
        order = [want.columns.index(c) for c in got.columns]
        key = lambda r: [(v is None, v or 0) for v in r]
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key), name


def test_late_move_stats_makes_no_windows_of_tables(spark):
    from palimp.plans.catalog import QUERIES

    plan = QUERIES["late_move_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "Generate" not in plan
    windows = QUERIES["content_moves"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "sequence(1, size(" not in windows
