import json
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import grams as G
from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import candidates, dedup, embed, generate, ivf, lsh, metrics, similarity, split
from millrace.operators.components import groups
from millrace.plans.pipeline import run_detailed
from millrace.sources import examples as X
from millrace.sources import manifest as M
from millrace.sources.settings import Settings


def topics(extra=()):
    base = [f"how to configure the {t} service in environment {k} with retries" for t in ("deploy", "database", "network", "caching", "auth") for k in range(4)]
    return [(i, t) for i, t in enumerate([*base, *extra])]


NORMAL = [("  Héllo,   WORLD!! ", "hello world"), ("Straße", "strasse"), ("fine-tuning don't_stop", "fine-tuning don't stop"), ("ﬁt ①", "fit 1"), ("ÀÉÎ-x", "aei-x"), ("日本 語", "日本 語"), ("", ""), ("!!!", ""), (None, "")]


def test_normalise(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(NORMAL)], "i int, a string, b string")
    assert T.with_normalized(df, "a", "n").where("n <> b").count() == 0
    assert [T.normalize_exactly(a) for a, _ in NORMAL] == [b for _, b in NORMAL]


def test_operators_normalise_all_of_unicode(spark):
    """Composed and decomposed copies, ligatures and full-width forms are one exact group; every operator's form is the exact one."""
    same = ["caf\u00e9 \ufb01ne", "cafe\u0301 fine", "\uff23\uff41\uff46\uff45 FINE", "CAFE fine"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*same, "other", None])], "id long, text string")
    got = {r.id: r.group_id for r in dedup.exact_groups(df).collect()}
    assert all(got[i] == 0 for i in range(4)) and got.get(4, 4) == 4
    forms = df.select("text", T.normalize(F.col("text")).alias("n"), T.tokens(T.normalize(F.col("text"))).alias("t"), T.shingle_set(T.normalize(F.col("text"))).alias("s")).collect()
    assert [r.n for r in forms] == [T.normalize_exactly(r.text) for r in forms] and len({tuple(sorted(r.s)) for r in forms[:4]}) == 1
    assert df.where("id < 4").groupBy(T.content_key(F.col("text"), F.lit("x"))).count().count() == 1
    assert M.ordered_corpus_hash(df.where("id = 0"), "id").first()[0] == M.ordered_corpus_hash(df.where("id = 1").withColumn("id", F.lit(0)), "id").first()[0]
    assert embed.HashingEmbedder(32).embed(df.where("id < 4")).select("vec").distinct().count() == 1


def test_shingles(spark):
    n = spark.createDataFrame([("a b c",), ("",)], "t string")
    got = {r[0]: (r[1], r[2]) for r in n.select("t", T.features(F.col("t")), F.size(T.shingle_set(F.col("t")))).collect()}
    assert got[""][0] == [] and got["a b c"][1] == 17 and len(got["a b c"][0]) == 17
    assert {"w:a_b", "c: a b ", "c:b c"} <= set(got["a b c"][0])


def test_band_parameters():
    want = {(64, 0.5): (13, 4), (64, 0.8): (6, 10), (64, 0.92): (3, 21), (128, 0.5): (22, 5), (128, 0.8): (10, 12), (128, 0.92): (5, 25), (256, 0.5): (42, 6), (256, 0.8): (17, 15), (256, 0.92): (8, 32)}
    assert {k: lsh.band_parameters(*k) for k in want} == want
    assert [round(lsh.jaccard_of_cosine(c), 6) for c in (0.8, 0.9, 0.92, 1.0, 0)] == [0.533333, 0.654545, 0.681481, 0.8, 0.001]


def test_lsh_covers_exact_pairs(spark):
    texts = spark.createDataFrame(topics([topics()[0][1] + " with extra words", topics()[3][1] + " plus detail"]), "id long, text string")
    vec = embed.HashingEmbedder(128).embed(texts).persist()
    truth = {(r.i, r.j) for r in similarity.pairs_above(vec, 0.9).collect()}
    sets = texts.select("id", T.shingle_set(T.normalize(F.col("text"))).alias("features"))
    got = lsh.candidate_pairs(lsh.band_keys(lsh.signatures(sets, "features", 128), 16, 8, 128))
    assert truth and truth <= {(r.i, r.j) for r in got.collect()}


def test_similarity_blocks_and_ties(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2**-0.5, 2**-0.5]), (3, [0.0, 0.0])], "id long, vec array<double>")
    top = {r.i: (r.j, round(r.sim, 6)) for r in similarity.top_k(v, 1, block=1).collect()}
    assert top[0] == (2, 0.707107) and top[1] == (2, 0.707107) and top[2] == (0, 0.707107)
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, vec array<double>").persist()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    want = {(i, j) for i, a in rows for j, b in rows if i < j and cos(a, b) >= 0.5}
    for block in (7, 512):
        assert {(x.i, x.j) for x in similarity.pairs_above(v, 0.5, block).collect()} == want
    best = {i: sorted((-cos(a, b), j) for j, b in rows if j != i)[:3] for i, a in rows}
    for block in (7, 512):
        assert {(x.i, x.rank, x.j) for x in similarity.top_k(v, 3, block).collect()} == {(i, k + 1, j) for i, found in best.items() for k, (_, j) in enumerate(found)}
    halves = v.where("id < 30"), v.where("id >= 30")
    assert abs(similarity.greatest_cosine(*halves, 7).first().sim - max(cos(a, b) for i, a in rows for j, b in rows if i < 30 <= j)) < 1e-12
    everything = ivf.candidate_pairs(v, v.where("id < 4"), 4)
    assert everything.count() == 60 * 59 // 2


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)]
    parent = {k: k for k in range(150)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    ids = spark.range(150)
    got = {x.id: x.group_id for x in groups(ids, spark.createDataFrame(edges, "i long, j long")).collect()}
    assert got == {k: find(k) for k in range(150)}
    assert groups(ids, spark.createDataFrame([], "i long, j long")).where("id <> group_id").count() == 0


def test_dedup_and_audit(spark):
    texts = spark.createDataFrame([*topics([topics()[0][1]]), (30, "!!!"), (31, "???")], "id long, text string")
    kept, audit, facts = dedup.dedup(texts, threshold=0.99, strategy="exact", embedder=embed.HashingEmbedder(128))
    rows = {r.id: r for r in audit.collect()}
    assert kept.count() == 21 and set(rows) == {20, 31}
    assert rows[20].kept_index == 0 and rows[31].survivor_index == 30 and facts["largest_group"] == 2
    with pytest.raises(ValueError):
        dedup.find_groups(texts, threshold=2)


def test_metrics(spark):
    d = spark.createDataFrame([("a b a",), ("b c",)], "t string").withColumn("toks", T.tokens(F.col("t")))
    m = metrics.diversity(d, "toks").first()
    assert (m.type_token_ratio, m.distinct_2, m.n_tokens, m.n_types) == (0.6, 1.0, 5, 3)
    s = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 10)], "x int").agg(*metrics.statistics(F.col("x"), "x")).first()
    assert [round(s[f"x_p{p}"], 4) for p in metrics.PERCENTILES] == [3.0, 7.6, 8.8, 9.76]
    tags = lambda c: spark.createDataFrame(list(c.items()), "label string, n long")
    got = metrics.distribution_drift(tags({"a": 30, "b": 10}), tags({"a": 1, "b": 1}))
    assert (round(got["chi_square"], 9), got["chi2_dof"], round(got["chi2_p_value"], 8), got["drifted"]) == (10.0, 1, 0.0015654, True)
    got = metrics.distribution_drift(tags({"a": 1, "b": 1}), tags({"a": 1}))
    assert round(got["js_distance"], 6) == 0.557923 and got["drifted"] is None and got["n_new_labels"] == 1
    assert metrics.distribution_drift(tags({"a": 4}), tags({"a": 1, "b": 1}))["chi_square"] == 4.0
    assert metrics.distribution_drift(tags({"a": 1}), tags({"b": 1}))["js_distance"] == 1.0


def test_split(spark):
    assert [split.apportion(n, (0.8, 0.1, 0.1)) for n in (0, 1, 2, 5, 10)] == [[0, 0, 0], [1, 0, 0], [2, 0, 0], [4, 1, 0], [8, 1, 1]]
    assert split.apportion(22, (0.7, 0.15, 0.15)) == [16, 3, 3]
    r = random.Random(3)
    units = spark.createDataFrame([(i, f"s{r.randrange(4)}", f"{r.random():.9f}") for i in range(150)], "unit long, stratum string, key string").persist()
    single = {x.unit: x.s for x in split.assign_singles(units).collect()}
    assert single == {x.unit: x.s for x in split.assign_weighted(units.withColumn("weight", F.lit(1))).collect()}
    w = spark.createDataFrame([(k, "x", str(k), n) for k, n in enumerate([3, 1, 1, 2, 1, 2])], "unit long, stratum string, key string, weight int")
    assert [x.s for x in split.assign_weighted(w, (0.5, 0.3, 0.2)).orderBy("unit").collect()] == [0, 1, 0, 1, 2, 0]
    with pytest.raises(ValueError):
        split.normalized_ratios((0, 0, 0))


def test_split_dataset_and_leaks(spark):
    rows = [(i, t, f"answer {i % 20}", "") for i, t in topics([topics()[0][1], topics()[2][1]])]
    ex = spark.createDataFrame(rows, "id long, input string, output string, tag string")
    done = split.split_dataset(ex, (0.7, 0.15, 0.15), 0.99, "exact", embed.HashingEmbedder(128))
    assert sum(done.counts.values()) == 22 and done.leakage.ok
    leaky = embed.HashingEmbedder(128).embed(ex.select("id", F.col("input").alias("text"))).join(ex.select("id", T.content_hash(F.col("input")).alias("key"), split.split_name((F.col("id") % 3).cast("int")).alias("split")), "id")
    found = split.audit(leaky, 0.99)
    assert not found.ok and found.counts["shared_hashes"] >= 1
    with pytest.raises(split.LeakageError):
        split.assert_no_leakage(leaky, 0.99)


def test_replies(spark):
    r = spark.createDataFrame([('[{"input":"a","output":"b"}, 3, {"input":"c"}]',), ("not json at all",), (None,)], "r string")
    assert [[(v.input, v.output) for v in x[0]] for x in r.select(generate.parsed_variants(F.col("r"))).collect()] == [[("a", "b")], [], []]
    seeds = spark.createDataFrame([(0, "a", "b", "")], "id long, input string, output string, tag string")
    more = spark.createDataFrame([(1, "a", "b2", ""), (2, "c", "d", ""), (3, "c", "e", "")], seeds.schema)
    judge = lambda p: json.dumps({"faithfulness": 3 if "output: d" in p else 9, "keep": True})
    assert [x.id for x in generate.filter_candidates(more, seeds, judge).collect()] == [3]

    def failing(p):
        raise RuntimeError("no")

    assert generate.expand(seeds, failing)[0].count() == 0


def test_pipeline(spark, tmp_path):
    seeds = tmp_path / "seeds.json"
    seeds.write_text(json.dumps([{"input": "x one", "output": "y"}]), encoding="utf-8")
    reply = json.dumps([{"input": "second question", "output": "y2"}, {"input": "third thing entirely", "output": "y3"}])
    done = run_detailed(spark, str(seeds), str(tmp_path / "out.jsonl"), lambda p: reply, lambda p: '{"faithfulness": 9, "keep": true}', report=True, settings=Settings(embedder="hash"))
    lines = [json.loads(x) for x in (tmp_path / "out.jsonl").read_text().splitlines()]
    assert done.n == len(lines) == 2 and lines[0]["messages"][0]["role"] == "user"
    again = M.read_manifest(str(tmp_path / "out.jsonl"))
    assert again.stages["expanded"] == 3 and again.same_inputs(done.manifest)
    plain = run_detailed(spark, str(seeds), str(tmp_path / "plain.jsonl"), report=True, settings=Settings(embedder="hash"))
    assert metrics.DataReport(labels={"NaN": float("nan"), "a": [float("inf"), "Infinity"]}).as_dict()["labels"] == {"NaN": None, "a": [None, "Infinity"]}
    assert plain.n == 1 and plain.report.as_dict()["n_generated"] == 0  # seeds are not held against themselves
    (tmp_path / "none.json").write_text("[]")
    assert run_detailed(spark, str(tmp_path / "none.json"), str(tmp_path / "none.jsonl")).n == 0
    for bad in ("{not-json", '{"a": 1}', "[1]", '[{"input": "a"}]'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            X.load_examples(spark, str(tmp_path / "bad.json"))
    with pytest.raises(FileNotFoundError):
        X.load_examples(spark, str(tmp_path / "missing.json"))


def test_manifest_and_settings(spark):
    df = spark.createDataFrame([("b",), ("a",)], "text string")
    assert M.corpus_hash(df).first()[0] == "ab19ec537f09499b26f0f62eed7aefad46ab9f498e06a7328ce8e8ef90da6d86"
    counts = M.stage_counts(seeds=5, expanded=20, filtered=12, deduped=9, exported=9)
    assert [counts[f"dropped_at_{s}"] for s in M.STAGES] == [0, 0, 8, 3, 0]
    assert Settings.load({"MILLRACE_API_KEY": "k", "MILLRACE_MIN_SCORE": "7.0"}).min_score == 7 and not Settings.load({}).has_key


def test_lsa_and_strategies(spark):
    texts = spark.createDataFrame(topics(), "id long, text string")
    e = embed.LsaEmbedder(dim=16, min_components=8).fit(texts)
    v = e.embed(texts)
    assert all(abs(r[0] - 1) < 1e-6 for r in v.select(V.norm(F.col("vec"))).collect())
    with pytest.raises(embed.DegenerateCorpus):
        embed.LsaEmbedder().fit(texts.limit(2))
    with pytest.raises(ValueError):
        candidates.candidate_pairs(v, None, strategy="none")


def test_stream(spark, tmp_path):
    from millrace.streaming.exact import first_of_each

    spark.createDataFrame([(1, "Same text"), (2, "same TEXT!"), (3, "other")], "id int, t string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, t string, ts timestamp").parquet(str(tmp_path / "in"))
    q = first_of_each(stream, "t", "ts").writeStream.format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 2


def random_vectors(spark, n, dim=5, seed=7, repeat=()):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    return [*rows, *[(i, [r.gauss(0, 1) for _ in range(dim)]) for i in repeat]]


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_not_sent_once_a_block(spark):
    """Each row is shuffled once, whatever the number of blocks, and results are those of a full comparison."""
    rows = random_vectors(spark, 50)
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    for df in (similarity.pairs_above(v, 0.5, 7), similarity.top_k(v, 3, 7), similarity.nearest_in(v, v, 2, 7)):
        assert "Generate" not in plan(df) and plan(df).count("Exchange") <= 1
    same = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (9, [1.0, 2.0, 2.9]), *[(k, [2.0, 2.0, 3.0]) for k in (3, 5, 4, 8)]], "id long, vec array<double>")
    for block in (1, 2, 512):  # ties go to the smaller id wherever the rows stand
        assert [r.j for r in similarity.top_k(same, 2, block).where("i = 0").orderBy("rank").collect()] == [9, 3]
        assert [r.j for r in similarity.top_k(same, 2, block).where("i = 8").orderBy("rank").collect()] == [3, 4]


def test_groups_send_pairs_of_different_groups_only(spark):
    rows = random_vectors(spark, 90)
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    for threshold in (0.8, 0.97):
        root = {i: i for i, _ in rows}
        for _ in rows:
            for i, a in rows:
                for j, b in rows:
                    if cosine(a, b) >= threshold:
                        root[i] = root[j] = min(root[i], root[j])
        for first in (5, 8_192):
            assert {r.id: r.group_id for r in similarity.near_groups(v, threshold, 11, first).collect()} == root


def test_nearest_earlier_member_by_brute_force(spark):
    rows = random_vectors(spark, 60)
    group = {i: i % 3 if i < 50 else i for i, _ in rows}
    found = spark.createDataFrame(list(group.items()), "id long, group_id long")
    got = dedup.nearest_earlier(found, spark.createDataFrame(rows, "id long, vec array<double>"))
    assert "Join" not in plan(got).split("MapInArrow")[0]  # no table of a group's pairs
    want = {i: max((cosine(a, b), -j) for j, b in rows if j < i and group[j] == group[i]) for i, a in rows if group[i] != i}
    assert {r.id: (round(r.similarity, 9), -r.kept_index) for r in got.collect()} == {i: (round(s, 9), j) for i, (s, j) in want.items()}


@pytest.mark.parametrize("repeat", [(), (4, 11)])
def test_lists_by_brute_force(spark, repeat):
    """Candidates, their verification, union and search without a table of candidates; ids that repeat count once in a pair."""
    rows = random_vectors(spark, 60, repeat=repeat)
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    centroids = spark.createDataFrame(random_vectors(spark, 6, seed=8), "id long, vec array<double>")
    lists = {(i, tuple(a)): [k for _, k in sorted((-cosine(a, c), k) for k, c in random_vectors(spark, 6, seed=8))] for i, a in rows}
    pairs = {(i, j) for i, a in rows for j, b in rows if i < j and lists[j, tuple(b)][0] in lists[i, tuple(a)][:2]}
    got = ivf.candidate_pairs(v, centroids, 2)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(pairs)
    near = {(i, j) for i, a in rows for j, b in rows if i < j and cosine(a, b) >= 0.6}
    both = ivf.union_sums(v, centroids, 2, 0.6).first()
    assert tuple(both) == (len(pairs | near), sum(i for i, _ in pairs | near), sum(j for _, j in pairs | near))
    if not repeat:
        assert "Exchange hashpartitioning(i" not in plan(got)
        good, counts = ivf.verified_pairs(v, centroids, 2, 0.6)
        assert {(r.i, r.j) for r in good.collect()} == pairs & near and tuple(counts.first()) == (len(pairs), len(pairs & near), len(pairs - near))
        asked = {(i, j) for i, j in near | {(j, i) for i, j in near}}
        known = spark.createDataFrame(sorted(asked), "i long, j long")
        assert {(r.i, r.j) for r in ivf.covered(known, v, centroids, 2).collect()} == {p for p in asked if (min(p), max(p)) in pairs}
        want = {i: sorted((-cosine(a, b), j) for j, b in rows if lists[j, tuple(b)][0] in lists[i, tuple(a)][:2])[:4] for i, a in rows}
        assert {(r.i, r.rank, r.j) for r in ivf.search(v, v, centroids, 4, 2).collect()} == {(i, k + 1, j) for i, found in want.items() for k, (_, j) in enumerate(found)}


def test_strategies_write_no_table_of_list_candidates(spark):
    rows = random_vectors(spark, 300, dim=8)
    v = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    good, counts, facts, among = candidates.verified_pairs(v, None, 0.7, "ivf", n_probe=2, n_lists=6)
    pairs, _ = candidates.candidate_pairs(v, None, 0.7, "ivf", n_probe=2, n_lists=6)
    want, n = similarity.verify(pairs, v, 0.7)
    assert {(r.i, r.j) for r in good.collect()} == {(r.i, r.j) for r in want.collect()} and tuple(counts.first()) == tuple(n.first())
    line = {r["strategy"]: r for r in candidates.benchmark(v, None, ("exact", "ivf"), 5, 0.7, 6, 2)}
    pools = ivf.rerank(pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))), v, 5)
    top = similarity.top_k(v, 5)
    assert line["ivf"]["recall_at_k"] == pools.join(top, ["i", "j"], "left_semi").count() / top.count() and line["exact"]["recall_at_k"] == 1
    assert line["ivf"]["candidates_per_row"] == pairs.count() / 300


def test_leaks_across_splits_by_brute_force(spark):
    rows = random_vectors(spark, 60)
    side = {i: ("train", "val", "test", None)[i % 4] for i, _ in rows}
    v = spark.createDataFrame([(i, side[i], a) for i, a in rows], "id long, split string, vec array<double>")
    across = {(i, j): cosine(a, b) for i, a in rows for j, b in rows if i < j and side[i] and side[j] and side[i] != side[j]}
    got = split.near_across(v, 0.7)
    assert "Join" not in plan(got)
    assert {(r.i, r.j, r.split_a, r.split_b) for r in got.collect()} == {(i, j, *sorted((side[i], side[j]))) for (i, j), s in across.items() if s >= 0.7}
    assert abs(split.greatest_across(v).first().sim - max(across.values())) < 1e-12


def test_single_units_are_dealt_without_a_slot_a_unit(spark):
    """Ranks are spread over the beginnings of keys, and a stratum's slots are a few runs: nothing as long as the units is broadcast."""
    r = random.Random(5)
    rows = [(i, f"s{min(r.randrange(6), 3)}", None if i % 41 == 0 else "" if i % 43 == 0 else f"{r.randrange(400):03x}") for i in range(300)]
    units = spark.createDataFrame(rows, "unit long, stratum string, key string")
    done = split.assign_singles(units)
    assert "Generate explode(sequence" not in plan(done)
    want = {}
    for stratum in {s for _, s, _ in rows}:
        mine = sorted((k is not None, k or "", u) for u, s, k in rows if s == stratum)
        left = split.apportion(len(mine), split.RATIOS)
        for _, _, u in mine:
            s = max(range(3), key=lambda k: (left[k], -k))
            left[s] -= 1
            want[u] = s
    assert {x.unit: x.s for x in done.collect()} == want


TEXTS = ["a b a b c", "Ünïcode straße a-b don't", "日本 語 ﬁne", None, "", "!!!", "a b a b c", "x" * 9, "a  b ", "w" * 3 + " 日" * 4]


def text_rows(spark):
    return spark.createDataFrame([(i, t, "pq"[i % 2] if i != 4 else None) for i, t in enumerate(TEXTS)], "id long, text string, lang string").repartition(3)


def test_texts_are_counted_by_batches(spark, monkeypatch):
    """Runs counted in Python are those of the expressions, for texts and for tokens, at any size of slices."""
    df = text_rows(spark)
    toks = df.withColumn("toks", T.tokens(T.normalize(F.col("text"))))
    for n in (1, 2):
        want = {tuple(r) for r in T.ngram_counts(toks, "toks", n, "lang").collect()}
        for most in (1, 40, 1 << 20):
            monkeypatch.setattr(G, "SLICE", most)
            got = G.gram_counts(df, "text", (n,), "lang").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
            assert {tuple(r) for r in got.collect()} == want
    assert "ArrowEvalPython" not in plan(metrics.diversity(df, "text", "lang"))
    for by in ((), ("lang",)):
        assert {tuple(r) for r in metrics.diversity(df, "text", *by).collect()} == {tuple(r) for r in metrics.diversity(toks, "toks", *by).collect()}
    assert {r.id: r.norm for r in G.normalized(df).collect()} == {i: T.normalize_exactly(t) for i, t in enumerate(TEXTS)}
    sizes = {r.id: (r.n, r.d) for r in toks.select("id", T.word_shingles(F.col("toks")).alias("s")).where(F.size("s") > 0).select("id", F.size("s").alias("n"), F.size(F.array_distinct("s")).alias("d")).collect()}
    assert {r.id: (r.n, r.n_distinct) for r in G.shingle_sizes(df, "id", "text").collect()} == sizes
    tf = T.ngram_counts(toks, "toks", 1, "id")
    assert {tuple(r) for r in G.row_counts(df, "id", "text").collect()} == {tuple(r) for r in tf.collect()}
    assert {tuple(r) for r in G.row_frequencies(df, "text").collect()} == {tuple(r) for r in tf.groupBy("ngram").count().collect()}


def test_exact_audit_sends_no_texts(spark):
    df = text_rows(spark).select("id", "text")
    audit = dedup.exact_audit(df)
    assert {(r.id, r.kept_index, r.preview) for r in audit.collect()} == {(6, 0, TEXTS[6]), (4, 3, ""), (5, 3, "!!!")}
    assert {r.input_hash for r in audit.where("id = 6").collect()} == {df.where("id = 6").select(T.content_hash(F.col("text"))).first()[0]}
    assert "text" not in plan(audit).split("Exchange")[1]


def test_text_signatures_and_hashed_vectors(spark, monkeypatch):
    """Signatures and vectors made by batches are those of the expressions, feature by feature."""
    monkeypatch.setattr(G, "SLICE", 64)
    df = text_rows(spark).select("id", "text")
    sets = df.select("id", T.shingle_set(T.normalize(F.col("text"))).alias("features"))
    want = {r.id: r.signature for r in lsh.signatures(sets, "features", 16).collect()}
    assert {r.id: r.signature for r in lsh.text_signatures(df, 16).collect()} == want
    bare = df.select("id", T.tokens(T.normalize(F.col("text"))).alias("features"))
    assert {r.id: r.signature for r in lsh.text_signatures(df, 8, words=(1, 1), chars=None, marked=False).collect()} == {r.id: r.signature for r in lsh.signatures(bare, "features", 8).collect()}
    for chars in (None, (3, 5)):
        found = T.features(T.normalize(F.col("text"))) if chars else F.transform(T.word_shingles(T.tokens(T.normalize(F.col("text")))), lambda x: F.concat(F.lit("w:"), x))
        sums = {i: [0.0] * 8 for i in range(len(TEXTS))}
        for r in df.select("id", F.explode(found).alias("f")).groupBy("id", "f").count().withColumn("h", F.md5(F.concat(F.lit("13:"), "f"))).collect():
            sums[r.id][int(r.h[:8], 16) % 8] += (1 if int(r.h[8:16], 16) % 2 else -1) * (1 + math.log(r["count"]))
        for r in embed.HashingEmbedder(8, chars=chars).embed(df).collect():
            size = math.sqrt(sum(x * x for x in sums[r.id]))
            assert all(abs(x - y / (size or 1)) < 1e-9 for x, y in zip(r.vec, sums[r.id], strict=True))
