import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import metrics as X
from lodestone.functions import scores as S
from lodestone.functions import text as T
from lodestone.functions.registry import user_score
from lodestone.operators import advantages as A
from lodestone.operators import chunking as K
from lodestone.operators import corpus as C
from lodestone.operators import dialogue as D
from lodestone.operators import memory as M
from lodestone.operators import retrieval as R
from lodestone.plans.q_stats import reduce_by_name, upper_median
from lodestone.sources import readers
from lodestone.streaming import events


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


def test_metric_reduction_by_name(spark):
    rows = [("loss", x) for x in (1.0, 2.0, 3.0)] + [("max_reward", x) for x in (5.0, 8.0, 6.0)] + [("min_error", x) for x in (0.1, 0.05, 0.2)] + [("accuracy", x) for x in (0.8, 0.9, 0.7)]
    got = {r[0]: round(r[1], 6) for r in reduce_by_name(spark.createDataFrame(rows, "key string, value double")).collect()}
    assert got == {"loss": 2.0, "max_reward": 8.0, "min_error": 0.05, "accuracy": 0.8}


def test_upper_median(spark):
    for values in ([3], [1, 2], [5, 1, 4, 1], list(range(100)) + [7] * 50):
        got = upper_median(spark.createDataFrame([(v,) for v in values], "v long"), "v").first()[0]
        assert got == sorted(values)[len(values) // 2]


def test_normalisation(spark):
    assert one(spark, T.normalize_answer("a"), a="The  Cat, an Owl -- a dog!") == "cat owl dog"
    assert one(spark, S.token_f1(F.col("p"), F.col("g"))["f1"], p="the red red cat", g="red cat") == 0.8
    assert one(spark, S.token_f1(F.col("p"), F.col("g"))["f1"], p="yes", g="no") == 0.0
    assert one(spark, T.last_tag("a", "answer"), a="<answer>1</answer> <answer> 2 </answer>") == "2"
    assert one(spark, T.after_thinking("a"), a="<think>x</think> y") == "y"
    assert one(spark, T.last_number("a"), a="it costs 1,234. #### 56") == "56"


def test_text_metrics():
    assert X.rouge_l("a b c", "a x c") == 2 / 3
    assert X.rouge_n("a b c", "a b d", 2) == 0.5
    assert X.bleu("the cat sat on the mat", "the cat sat on the mat") == 1.0
    assert X.bleu("", "a") == 0.0 == X.rouge_l(None, "a")
    assert X.balanced_box(r"x \boxed{a {b} c} y") == "a {b} c" and X.balanced_box("x") is None
    assert X.json_object('say {"a": "}"} x') == '{"a": "}"}'
    assert X.repaired_json('{"a": some text, "b": [1,2,],') == '{"a": "some text", "b": [1, 2]}'
    assert X.same_math(r"\boxed{\frac{1}{2}}", r"\frac12") == 1.0


def test_advantages(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (2, 1, 3.0), (3, 2, 5.0)], "id long, g long, s double")
    w = Window.partitionBy("g")
    got = {r[0]: r[1:] for r in df.select("id", A.group_relative(F.col("s"), w), A.leave_one_out(F.col("s"), w), A.pass_at_k(F.col("s"), w, "id")).collect()}
    assert abs(got[1][0] + 1 / math.sqrt(2)) < 1e-5 and got[2][1] == 2.0 and got[1][1] == -2.0 and got[3][1] == 5.0
    assert got[1][2] == 0.0 == got[3][2] and abs(got[2][2] - math.sqrt(2)) < 1e-5


def test_generalised_advantage_is_the_recursion(spark):
    values = [0.3, 0.9, 0.1, 0.5]
    df = spark.createDataFrame([(1, i, i, v) for i, v in enumerate(values)], "k long, t long, id long, v double")
    got = {r[0]: r[1] for r in A.generalised_advantage(df, "k", ["t"], "id", "v", 1.0, 0.9, 0.8).collect()}
    a, nxt = 0.0, 0.0
    for i in reversed(range(4)):
        a = 1.0 + 0.9 * nxt - values[i] + 0.9 * 0.8 * a
        nxt = values[i]
        assert abs(got[i] - a) < 1e-9


def test_contains_join_is_the_comparison_of_all(spark):
    texts = [(1, "the red cat sat"), (2, "a redder cat sat"), (3, ""), (4, None)]
    parts = [("red cat sat",), ("the red cat",), ("er cat s",), ("zebra x y",)]
    got = {(r.id, r.part) for r in C.contains_join(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(parts, "part string"), "id", "text", "part").collect()}
    assert got == {(i, p) for i, t in texts for (p,) in parts if t and p in t}


def test_contains_join_finds_short_parts(spark):
    texts = [(1, "the red cat sat"), (2, "a redder cat -- sat, élan 12%"), (3, ""), (4, None), (5, "Élan; old millstones"), (6, "l'été_1 a+b 日本語の文")]
    parts = [(p,) for p in ("red", "ed c", "r", "-", "- ", "--", "", "old mill", "Éla", "éla", "12%", "本語", "t_1", "té_1 a", "xyz", "at, ", "é", "er")]
    got = [(r.id, r.part) for r in C.contains_join(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(parts, "part string"), "id", "text", "part").collect()]
    assert sorted(got) == sorted((i, p) for i, t in texts for (p,) in parts if t is not None and p in t)


def test_contains_join_in_blocks_is_the_comparison_of_all(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("ab é\n") for _ in range(rng.choice([0, 3, 40, 200])))) for i in range(80)] + [(80, None)]
    parts = sorted({"", "é", " ", "zz"} | {t[a : a + n] for i, t in texts[:80:3] for a, n in ((0, 2), (1, 5), (3, 17), (0, 64), (5, 130))} | {"ab" * 40})
    monkeypatch.setattr(C, "BLOCK", 700)
    df = C.contains_join(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in parts], "part string"), "id", "text", "part")
    assert sorted((r.id, r.part) for r in df.collect()) == sorted((i, p) for i, t in texts for p in parts if t is not None and p in t)
    texts, parts = pa.table({"id": [1, 2, 3], "text": ["xay", "bxa", ""]}), pa.table({"part": ["xa", "yb", "", "aybx"]})
    monkeypatch.setattr(C, "SLICE", 4)
    got = C._holding(texts, parts).to_pylist()
    assert sorted((r["id"], r["part"]) for r in got) == [(1, ""), (1, "xa"), (2, ""), (2, "xa"), (3, "")]
    assert not len(C._holding(texts.slice(0, 0), parts)) and not len(C._holding(texts, parts.slice(0, 0)))


def test_bm25_against_plain_python(spark):
    docs = {1: "a b b c", 2: "b c d", 3: "x y", 4: "", 5: "b b b"}
    df = spark.createDataFrame(list(docs.items()), "id long, t string")
    q = spark.createDataFrame([(1, "b c b"), (2, "nothing")], "q long, t string")
    got = {(r.q, r.id): r.score for r in R.bm25(df, q, "id", "t", "q", "t", 10).collect()}
    toks = {i: t.split() for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df_ = {w: sum(w in t for t in toks.values()) for t in toks.values() for w in t}
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df_.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    want = {}
    for i, t in toks.items():
        if set(t) & {"b", "c"}:
            want[1, i] = round(sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in "b c b".split()), 6)
    assert {k: round(v, 5) for k, v in got.items()} == {k: round(v, 5) for k, v in want.items()}


def _bm25_by_hand(docs, asked):
    toks = {i: t.split() for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    part = lambda w, t: idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg))
    return {(q, i): sum(part(w, t) for w in x.split() if w in idf) for q, x in asked.items() for i, t in toks.items() if set(t) & set(x.split())}


def test_bm25_of_blocks_and_stores_is_that_of_the_whole(spark, monkeypatch):
    docs = {i: " ".join(f"w{(i * j + j) % 11}" for j in range(1 + i % 7)) for i in range(60)} | {60: "w1 w2 w3", 61: "w1 w2 w3", 62: "", 63: "rare"}
    asked = {1: "w1 w2 w2", 2: "rare w0", 3: "none", 4: "w3", 5: ""}
    monkeypatch.setattr(R, "BLOCK", 9)
    of = lambda d, s=0: [(s, i, t) for i, t in d.items()]
    want = _bm25_by_hand(docs, asked)
    best = {q: sorted((-round(x, 6), i) for (p, i), x in want.items() if p == q)[:5] for q in asked}
    items, queries = spark.createDataFrame(of(docs), "s long, id long, t string"), spark.createDataFrame(of(asked), "s long, q long, t string")
    got = R.bm25(items, queries, "id", "t", "q", "t", 5)
    assert sorted((r.q, r["rank"], r.id) for r in got.collect()) == [(q, n + 1, i) for q in asked for n, (_, i) in enumerate(best[q])]
    two = items.unionByName(spark.createDataFrame([(1, 100, "w1 w1 x"), (1, 101, "y"), (1, 102, ""), (None, 103, "w1")], items.schema))
    got = {(r.q, r.id): r.score for r in R.bm25(two, queries.unionByName(spark.createDataFrame([(1, 9, "w1 y")], queries.schema)), "id", "t", "q", "t", 100, ["s"]).collect()}
    want |= _bm25_by_hand({100: "w1 w1 x", 101: "y", 102: ""}, {9: "w1 y"})
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_bm25_shuffles_no_pairs(spark):
    """Postings of a store are shuffled once; without stores neither they nor the pairs of queries and items are."""
    items, queries = spark.createDataFrame([(1, 1, "a b")], "s long, id long, t string"), spark.createDataFrame([(1, 1, "a")], "s long, q long, t string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().lower()
    assert plan(R.bm25(items, queries, "id", "t", "q", "t", 5, ["s"])).count("mapinarrow") == 1
    assert "cogroup" in plan(R.bm25(items, queries, "id", "t", "q", "t", 5))


def test_cosine_of_blocks_keeps_ties_by_id_and_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    rows = [(i, [float(i % 3), 1.0]) for i in range(40)] + [(40, [0.0, 0.0]), (41, None), (42, [1.0]), (43, [1.0, None])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    best = R.cosine_top_k(df, df.filter("id in (0, 1, 40, 42)").withColumnRenamed("id", "q"), "id", "v", "q", 4)
    assert sorted((r.q, r["rank"], r.id) for r in best.collect()) == [(0, n + 1, 3 * n) for n in range(4)] + [(1, n + 1, 3 * n + 1) for n in range(4)] + [(42, 1, 42)]
    assert "cogroup" in best._jdf.queryExecution().executedPlan().toString().lower()


def test_cosine_is_exact(spark):
    vs = [(i, [float((i * 7 + j * 3) % 5) - 2 for j in range(4)]) for i in range(30)] + [(30, [0.0] * 4)]
    df = spark.createDataFrame(vs, "id long, v array<float>")
    got = {}
    for r in R.cosine_top_k(df, df.filter("id < 3").withColumnRenamed("id", "q"), "id", "v", "q", 5).collect():
        got.setdefault(r.q, []).append((r.rank, r.id))

    def cos(a, b):
        na, nb = math.hypot(*a), math.hypot(*b)
        return round(sum(x * y for x, y in zip(a, b)) / na / nb, 6)

    for q in got:
        ranked = sorted((-cos(vs[q][1], v), i) for i, v in vs if any(v))
        assert [i for _, i in sorted(got[q])] == [i for _, i in ranked[:5]]


LOG = [
    (1, 1, "insert", "semantic", "a", "x"), (1, 2, "insert", "semantic", "b", "x"), (1, 3, "update", "semantic", "a", "y"), (1, 4, "update", "semantic", "q", "z"),
    (1, 5, "insert", "core", None, "no"), (1, 6, "update", "core", None, "core text"), (1, 7, "delete", "semantic", "zz", None), (2, 1, "insert", "episodic", "e", "w"), (2, 2, "delete", "episodic", "e", None),
]
LOG_SCHEMA = "instance_id long, seq long, op string, memory_type string, memory_id string, content string"


def test_memory_fold(spark):
    log = spark.createDataFrame(LOG, LOG_SCHEMA)
    assert {tuple(r)[:4] for r in M.fold(log).collect()} == {(1, "core", "core", "core text"), (1, "semantic", "a", "y")}
    status = {(r.instance_id, r.seq): r.status for r in M.outcomes(log).collect()}
    assert status[1, 2] == "skipped" and status[1, 4].startswith("error") and status[1, 7].startswith("warning") and status[1, 5].startswith("error")
    assert M.Store._bounded("w " * 600).endswith(M.CUT)


def test_memory_stream_equals_batch(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([r for r in LOG if (r[1] > 3) == bool(k)], LOG_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b={k}")
    stream = spark.readStream.schema(LOG_SCHEMA + ", b int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("b")
    out = events.run_to_memory(M.stream_fold(stream), "folded", "update", f"{tmp_path}/state")
    states = {r.instance_id: r.state for r in out.collect()}
    assert '"a", "y"' in states[1] and '"core": "core text"' in states[1] and '"episodic": []' in states[2]


def test_packing():
    assert K.pack(["a" * 8, "b" * 8, "c" * 40, "d"], 4) == ["a" * 8 + " " + "b" * 8, "c" * 40, "d"]
    assert K.pack([], 4) == [] and K.pack_sentences(None, 4) == []
    text = "One two three. Four five six! Seven? " * 20
    assert all(K.estimate(c) <= 20 for c in K.split_turn(text, 20))
    given = K.greedy_partitions({i: s for i, s in enumerate([9, 7, 5, 3, 1])}, 2)
    assert set(given) == set(range(5)) and set(given.values()) == {0, 1}


def test_dialogue(spark):
    lines = spark.createDataFrame([(1, "A", 0.0, 1.0, 1), (1, "A", 2.0, 3.0, 2), (1, "B", 3.1, 3.4, 3), (1, "A", 9.9, 10.0, 4), (1, None, 1.0, 2.0, 5)], "conv_id long, speaker string, start_time double, end_time double, line_id long")
    assert [tuple(r)[1:] for r in D.merge_turns(lines, 5.0).orderBy("start_time").collect()] == [("A", 0.0, 3.0, 2), ("B", 3.1, 3.4, 1), ("A", 9.9, 10.0, 1)]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1])], "vec_id long, embedding array<float>")
    assert [r.speaker for r in D.online_speakers(vectors, 0.7).orderBy("vec_id").collect()] == [0, 1, 0]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"i": 1, "t": "x"}\n{"i": 2, "t": broken}\n{"i": 1, "t": "later"}\nnothing\n')
    assert {tuple(r) for r in readers.read_tolerant_jsonl(spark, f"{tmp_path}/a.jsonl", readers.T.StructType.fromDDL("i long, t string"), "i").collect()} == {(1, "later"), (2, "broken")}
    (tmp_path / "b.json").write_text('[{"i": 1}, {"i": 2}]')
    assert readers.read_json_array(spark, f"{tmp_path}/b.json", readers.T.StructType.fromDDL("i long")).count() == 2
    (tmp_path / "c.txt").write_text("✓ who ... it&#39;s a\n✗ who ... b\n✓ who ... b\n")
    assert [tuple(r) for r in readers.read_marked_cache(spark, f"{tmp_path}/c.txt").collect()] == [("it's a", True)]
    files = spark.createDataFrame([("x/a/1.json",), ("x/a/2.json",), ("x/b/1.json",), ("V1_S2_I3_P1.wav",), ("V1_S2_I3_P2.wav",)], "path string")
    assert [r[0] for r in readers.directories_with(files, ["1.json", "2.json"]).collect()] == ["x/a"]
    assert [tuple(r) for r in readers.paired_files(files).collect()] == [("V1_S2_I3", ["P1", "P2"])]
    (tmp_path / "s.py").write_text("def score(p, g):\n    return len(p) / len(g)\n")
    assert one(spark, user_score(f"{tmp_path}/s.py")(F.col("p"), F.col("g")), p="ab", g="abcd") == 0.5
    readers.write_partitioned(files.withColumn("n", F.length("path")), f"{tmp_path}/out", ["n"])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_ordered_distinct(spark):
    assert one(spark, C.ordered_distinct(F.split("a", ",")), a="B, a,b,, A,c") == ["B", "a", "c"]


def test_bootstrap_has_all_draws_and_weights():
    from lodestone.plans import q_stats

    w = q_stats.poisson_weights(np.arange(4000))
    assert w.shape == (4000, 1000) and w.max() > 6
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01
    scores = np.random.default_rng(1).random(2000)
    rows = pd.DataFrame({"data_source": ["a", None] * 1000, "score": scores, "result_id": np.arange(2000)})
    made = pd.concat(q_stats.bootstrap_sums(iter([rows[:700], rows[700:]])))
    assert len(made) == 2000 and made.groupby("data_source", dropna=False).draw.nunique().tolist() == [1000, 1000]
    means = (made.total / made.weight)[made.data_source.to_numpy() == "a"]
    assert abs(means.mean() - scores[::2].mean()) < 0.002 and abs(means.std() - scores[::2].std() / 1000**0.5) < 0.001


# --- packers and partitions


def test_joined_packs_hold_their_budget_and_lose_nothing():
    rng = random.Random(8)
    for _ in range(200):
        texts = ["x" * rng.randint(0, 60) for _ in range(rng.randint(0, 30))]
        asks = [rng.random() < 0.4 for _ in texts]
        for packs in (K.joined_packs(texts, 20), K.joined_packs(texts, 20, asks)):
            assert [i for p in packs for i in p] == list(range(len(texts)))
            assert all(len(p) == 1 or len("\n".join(texts[i] for i in p)) // 4 <= 20 for p in packs)


def test_questions_stay_with_their_answers():
    texts = ["a" * 40, "q" * 20, "b" * 40]
    assert K.joined_packs(texts, 18, [False, True, False]) == [[0], [1, 2]]
    assert K.joined_packs(texts, 18, [False, False, False]) == [[0, 1], [2]]
    assert K.joined_packs(["q" * 40, "q" * 40], 12, [True, True]) == [[0], [1]]


def test_session_segments_and_chunks(spark):
    rows = [(i, i % 3 if i % 7 else None, "A" if i % 2 else "B", None if i % 11 == 0 else "word " * (i % 13)) for i in range(400)]
    lines = spark.createDataFrame([(*r, "x") for r in rows], "line_id long, conv_id long, speaker string, word string, text string")
    segments = K.pack_sessions(lines, 64, "speaker = 'A'")
    got = segments.collect()
    assert sum(r.n_lines for r in got) == 400 and all(r.tokens <= 64 and r.tokens == len(r.text) // 4 for r in got)
    chunks = K.gather_segments(segments, 200, 150).collect()
    assert sum(r.n_segments for r in chunks) == len(got) and all(r.tokens <= 200 for r in chunks)
    assert Counter("".join(r.text.split()) for r in got).total() == len(got)
    assert sorted("".join(r.text for r in chunks).split()) == sorted(w for r in rows for w in (r[3] or "").split())
    assert K.gather_segments(K.pack_sessions(lines.limit(0))).count() == 0


def test_titled_packs(spark):
    rows = [(1, i, f"t{i}", "x" * (40 + 30 * i)) for i in range(12)] + [(2, 0, None, "y" * 9000), (2, 1, "b", None), (None, 0, "c", "z"), (1, 3, "t3", "again")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "g long, place int, title string, body string, block int")
    got = K.titled_packs(df, "g", "place", "title", "body", 200).collect()
    assert all(len(r.text) // 4 <= 200 for r in got)
    assert Counter(t for r in got if r.g == 1 for t in r.titles) == Counter([f"t{i}" for i in range(12)] + ["t3"])
    assert [len(r.text) for r in got if r.g == 2] == [400] and [r.text for r in got if r.g is None] == ["Title: c\nz"]
    assert K.titled_packs(df.limit(0), "g", "place", "title", "body").count() == 0


def test_labelled_packs(spark):
    rows = [(i, "x" * (50 + 37 * i % 900)) for i in range(150)] + [(500, "y" * 5000), (501, None), (502, "")]
    got = K.labelled_packs(spark.createDataFrame(rows, "k long, t string"), "k", "t", buckets=4).collect()
    assert {r.k for r in got} == {k for k, t in rows if t is not None} and {r.n_chars for r in got if r.k == 500} == {1000}
    sums = Counter()
    for r in got:
        sums[r.bucket, r.chunk_no] += r.n_chars
    assert max(sums.values()) <= 2000 and max(r.bucket for r in got) <= 3


def test_greedy_batches(spark):
    items = spark.createDataFrame([("a", i, n, 10) for i, n in enumerate([3, 4, 5, 12, 1, None, 9])] + [("b", 1, 1, 10)], "g string, place long, n int, most int")
    got = {(r.g, r.place): r.batch for r in K.greedy_batches(items, "g", "place", "n", "most").collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("a", 4): 3, ("a", 5): 3, ("a", 6): 3, ("b", 1): 0}


def test_differencing_is_no_worse_than_greedy_and_near_the_best():
    rng = random.Random(9)
    spread = lambda sizes, given, k: (lambda x: max(x) - min(x))([sum(s for key, s in sizes.items() if given[key] == p) for p in range(k)])
    better = 0
    for _ in range(60):
        sizes = {i: rng.randint(1, 100) for i in range(rng.randint(1, 9))}
        k = rng.randint(1, 3)
        kk, greedy = K.differencing_partitions(sizes, k), K.greedy_partitions(sizes, k)
        assert set(kk) == set(sizes) and set(kk.values()) <= set(range(k))
        better += spread(sizes, kk, k) <= spread(sizes, greedy, k)
    assert better >= 50
    known = dict(enumerate([8, 7, 6, 5, 4]))
    assert spread(known, K.differencing_partitions(known, 2), 2) == 2 and K.differencing_partitions({}, 2) == {}


def test_partitions_of_tables(spark):
    df = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", None), (None, 9)], "s string, n long")
    got = {r.s: r.part for r in K.partitioned(df, "s", "n", 2, K.greedy_partitions).collect()}
    assert set(got) == set("abcd") and got["a"] != got["b"] == got["c"]
    assert K.partitioned(df.limit(0), "s", "n", 2, K.differencing_partitions).count() == 0


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from lodestone import session

    empty = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True)))
    context = SimpleNamespace(_jsc=empty, master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda name: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default)))
