import hashlib
import itertools
import os
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import crf_lstm, html_text, induced_sort, language, mixing, near_duplicates, neighbours, packing, pii, quality_model, quality_rules, repeated_bytes
from millrace.llm.common import whole_groups

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, stats string, _salt int"


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def odd_documents():
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    r = random.Random(5)
    base = sentence(r, 60)
    near = base.split()
    near[30] = "changed"
    texts = [base, base, " ".join(near), None, "", "  \n\t ", "one two three", "one  two\nthree", sentence(r, 4000), "word " * 50, "mail a.b@c.org, +1 (724) 555-7058 or 10.0.0.1 and 4111 1111 1111 1111.", "日本語 " * 20]
    rows = [(i, t, None if i % 4 == 3 else "en", None if i % 5 == 4 else f"s{i % 3}", None, 1, "x", 2) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[8]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_fixed_spans():
    r = random.Random(3)
    for _ in range(5000):
        s = "".join(r.choice("a1.@- +(9%x,256") for _ in range(r.randint(1, 40)))
        assert plain_spans(s) == pii.base_spans(s), s


def test_tagger_gradient_and_accuracy():
    rng = np.random.default_rng(1)
    t = crf_lstm.new_tagger(rng, 3, 4)
    x, y = (a[:, :12] for a in crf_lstm.tagged(crf_lstm.labelled_examples(3)))
    _, g = t.loss_and_gradient(x, y)
    for k in t.p:
        i = (int(x[0, 1]), 1) if k == "E" else tuple(rng.integers(0, s) for s in t.p[k].shape)
        was = t.p[k][i]
        t.p[k][i] = was + 1e-5
        up, _ = t.loss_and_gradient(x, y)
        t.p[k][i] = was - 1e-5
        down, _ = t.loss_and_gradient(x, y)
        t.p[k][i] = was
        assert abs((up - down) / 2e-5 - g[k][i]) < 1e-5
    tagger = crf_lstm.trained()
    x, y = crf_lstm.tagged(crf_lstm.labelled_examples(300, 99))
    p = tagger.decode(tagger.emissions(x))
    assert (p == y).mean() > 0.95 and ((p == y) & (y > 0)).sum() / (y > 0).sum() > 0.8


def test_reconciling():
    found = [(2.0, "ip", 0, 5), (3.0, "card", 4, 9), (2.5, "ip", 9, 12), (9.0, "phone", 20, 30)]
    assert pii.reconcile(found, [("email", 25, 40)]) == [("card", 4, 9), ("ip", 9, 12)]
    assert pii.masked("call 123 now", [("phone", 5, 8)]) == "call [PHONE] now"


def test_spans_over_window_edges():
    """A span that no window sees whole is put together; pieces without the rest go; a span that one window sees whole stays as it is."""
    tags = lambda at, n, first="B": [0] * at + [crf_lstm.TAGS.index(f"{first}-card")] + [crf_lstm.TAGS.index("I-card")] * (n - 1)
    size, step, length = crf_lstm.WINDOW, crf_lstm.STRIDE, 3 * crf_lstm.WINDOW

    def parts(a, b, starts):
        out = []
        for w in starts:
            x, y = max(a, w) - w, min(b, w + size) - w
            if x < y:
                row = np.array(tags(x, y - x, "B" if a >= w else "I") + [0] * (size - y))
                scores = np.zeros((size, len(crf_lstm.TAGS)))
                scores[np.arange(size), row] = 1.0
                out += pii.spans_of_tags(row, scores, w, length)
        return [x[1:] for x in pii.stitched(out)]

    every = range(0, length - size + 1, step)
    for a, b in ((step - 8, step + size - 8 + 12), (3, 9), (step - 4, step + 4), (10, 10 + size + step), (0, size + 5)):
        assert ("card", a, b) in parts(a, b, every)
    assert parts(step - 8, step + size, [step]) == []


def test_tagger_finds_whole_spans():
    """Exact spans of fresh generated examples, where the text is the tagger's alone."""
    tagger, hits, wanted, wrong = crf_lstm.trained(), 0, 0, 0
    for text, spans in crf_lstm.labelled_examples(400, 77):
        got = {(k, a, b) for _, k, a, b in pii.tagger_spans([text], tagger)[0]}
        want = {tuple(x) for x in spans}
        hits, wanted, wrong = hits + len(got & want), wanted + len(want), wrong + len(got - want)
    assert hits > 0.5 * wanted and wrong < 0.5 * wanted, (hits, wanted, wrong)


def test_pii_query(odd, none):
    rows = {r.doc_id: r for r in pii.digest(odd).collect()}
    assert pii.digest(none).count() == 0 and len(rows) == 12
    for r in odd.select("doc_id", "text").collect():
        base = plain_spans(r.text or "")
        assert rows[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(rows[r.doc_id].spans.split(","))
    assert (rows[10].n_email, rows[10].n_phone, rows[10].n_ip, rows[10].n_card) == (1, 1, 1, 1)
    masked = {r.doc_id: r for r in pii.mask_with_length(odd).collect()}
    assert "555" not in masked[10].text and masked[3].text is None and masked[0].text == rows_text(odd, 0)


def rows_text(df, i):
    return df.where(F.col("doc_id") == i).first().text


# 2


def test_quality_rules(odd, none):
    got = {r.doc_id: r for r in quality_rules.quality_query(odd).collect()}
    assert quality_rules.quality_query(none).count() == 0
    for r in odd.select("doc_id", "text").collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        cover = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)} if len(w) < 500 else set()
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_repeat_words, g.n_dup_lines) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
        assert g.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and (not g.base_failed or not g.kept)


def test_rule_order_keeps_the_verdict(odd):
    names = [r.name for r in quality_rules.raw_rules(F.col("text"))]
    assert sorted(quality_rules.measured_order(odd)) == sorted(names)
    rules = [quality_rules.Rule("short", quality_rules.word_statistics(F.col("text"))["n_words"] < 10), quality_rules.Rule("never", F.lit(False))]
    for order in itertools.permutations(rules):
        assert odd.where(quality_rules.cascade(order).isNull()).count() == odd.where(quality_rules.word_statistics(F.col("text"))["n_words"] >= 10).count()
    out = quality_rules.judge(odd)
    assert out.columns == [*odd.columns, "verdict"] and {r.stats for r in out.select("stats").collect()} == {"x"}
    with pytest.raises(ValueError):
        quality_rules.judge(out)


# 3


def sets_of(docs):
    out = {}
    for i, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute_classes(docs):
    sets, texts = sets_of(docs), {i: t or "" for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if texts[i] == texts[j] or sets[i] and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_duplicates(spark, odd, none):
    assert near_duplicates.classes(none).count() == 0
    got = near_duplicates.classes(odd).collect()
    assert len(got) == 14 and {r.doc_id: r.class_id for r in got} == brute_classes([(r.doc_id, r.text) for r in odd.collect()])
    assert near_duplicates.keep_one(odd).count() == len(set(brute_classes([(r.doc_id, r.text) for r in odd.collect()]).values()))


SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plain_classes(texts):
    """Classes over all pairs that share a run of five words, by union and find."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({"short " + " ".join(w)} if w else set())
    of, common = {}, {}
    for i, s in sets.items():
        for g in s:
            of.setdefault(g, []).append(i)
    for ids in of.values():
        for pair in itertools.combinations(ids, 2):
            common[pair] = common.get(pair, 0) + 1
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    first = {}
    links = [(a, b) for (a, b), c in common.items() if 10 * c >= 8 * (len(sets[a]) + len(sets[b]) - c)]
    for i, t in texts.items():
        links.append((first.setdefault(t or "", i), i))
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in texts}


@needs_data
def test_near_duplicates_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").orderBy("doc_id").collect()}
    assert {r.doc_id: r.class_id for r in near_duplicates.classes(docs).collect()} == plain_classes(texts)


def test_near_copies_of_near_copies(spark):
    """A base and independent edits of it: edits are near the base but not near each other."""
    r = random.Random(8)
    base = sentence(r, 200).split()
    docs = []
    for i in range(40):
        w = list(base)
        for k in range(3 if i else 0):
            w[(i * 5 + 60 * k) % 200] = f"new{i}_{k}"
        docs.append((100 - i, " ".join(w)))
    docs += [(200 + i, sentence(r, 50)) for i in range(20)]
    got = {x.doc_id: x.class_id for x in near_duplicates.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs)


def test_pairs_whose_repeats_differ(spark):
    """Plain similarity over 0.8, weighted one far below: copies that repeat a line a thousand times."""
    docs = []
    for i in range(20):
        r = random.Random(100 + i)
        base = sentence(r, 80)
        docs += [(2 * i, base), (2 * i + 1, base + f" {sentence(r, 8)}" * 1000)]
    got = {x.doc_id: x.class_id for x in near_duplicates.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = sets_of(docs)
    alike = [i for i in range(20) if 10 * len(sets[2 * i] & sets[2 * i + 1]) >= 8 * len(sets[2 * i] | sets[2 * i + 1])]
    assert len(alike) == 20 and all(got[2 * i + 1] == 2 * i for i in alike)


def test_a_second_head_unlike_all_ends_nothing(spark):
    """One bucket whose heads are too small for the others: the pair that remains is still compared."""
    words = [f"u{i}" for i in range(104)]
    runs = spark.createDataFrame([(" ".join(words),)], "text string").select(near_duplicates.shingles_of(near_duplicates.words_of(F.col("text")), 5)).first()[0]
    e = np.array(runs, np.int64).view(np.uint64)
    k = runs.index(int(near_duplicates.signatures(e, np.ones(len(e)), np.zeros(len(e), int), 1, 1).view(np.int64)[0, 0]))
    lo = min(max(0, k - 4), 85)
    texts = [words[k : k + 5], words[lo : lo + 14], words, words[:-1] if k < 99 else words[1:]]
    docs = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = {x.doc_id: x.class_id for x in near_duplicates.classes(spark.createDataFrame(docs, "doc_id long, text string"), bands=1, rows=1).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    a, b = np.arange(1, 301), np.arange(101, 401)
    e = np.concatenate([a, b]).astype(np.uint64) * np.uint64(2654435761)
    s = near_duplicates.signatures(e, np.ones(600), np.repeat([0, 1], 300), 2, 2000)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.06 and rng is not None
    w = np.where(np.isin(np.concatenate([a, b]), np.arange(101, 301)), 3.0, 1.0)  # 600 of 700 of the weight is shared
    s = near_duplicates.signatures(e, w, np.repeat([0, 1], 300), 2, 2000)
    assert abs((s[0] == s[1]).mean() - 600 / 800) < 0.06


# 4


def test_html(spark):
    page = '<div id="cookie-notice">We use the cookies of all</div><ul class=menu><li><a href=x>Home</a></ul><h1>Title</h1><p>This is the first long paragraph of the text that has many of the words we look for in an article and so on.<p>Short one.<div class="comments"><p>Great article, the best of all that I have seen in a while, thank you for it and the rest of it all.</div><p>And this is the last paragraph of the article, with a <a href=q>link</a> in it &amp; more.<p>© 2020. All rights reserved'
    want = "Title\n\nThis is the first long paragraph of the text that has many of the words we look for in an article and so on.\n\nShort one.\n\nAnd this is the last paragraph of the article, with a link in it & more."
    assert html_text.main_text(page) == want
    assert html_text.main_text("<article><h1>A</h1><p>b\n c<br>d<script>x</script></article><footer>no</footer>") == "A\n\nb c d"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "plain"), (5, "u", page), (5, "u", page), (6, "u", "<div>" * 3000 + "deep" + "</div>" * 10)]
    got = html_text.extract(spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert [r.n_chars for r in got] == [len(r.text) for r in got] and got[0].text == got[1].text == "" and got[3].text == "plain" and got[4].text == got[5].text == want
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


PROSE = "It was the first of the days in which they had not been to the town, and all of them were there with what was left of it."


def test_html_evidence():
    """Class names are believed only where something else is content; so is standing outside of an article."""
    for name in ("legal", "search", "discussion"):
        assert html_text.main_text(f'<body><div class="{name}"><h1>Title</h1><p>{PROSE}</p></div></body>') == f"Title\n\n{PROSE}"
        assert html_text.main_text(f'<body><div><p>{PROSE}</p></div><div class="{name}"><p>{PROSE} No.</p></div></body>') == PROSE
    assert html_text.main_text(f"<body><p>{PROSE}</p><article><nav>a b</nav><p>Short line</p></article></body>") == "Short line"
    assert html_text.main_text(f"<body><p>{PROSE}</p><article><nav>a b</nav></article></body>") == PROSE
    page = f'<body><p><a href="#">Home</a> <a href="#">Up</a></p><h2>Head</h2><p>{PROSE}</p><p>ok</p><p>© 2020 Somebody</p></body>'
    assert [(keep, rule) for _, keep, rule in html_text.decided(page)] == [(False, "links"), (True, "inherited"), (True, "stop words"), (True, "inherited"), (False, "rights")]


def test_inherited_labels():
    """Against looking at all decided blocks."""
    r = random.Random(3)
    for _ in range(2000):
        marks = [r.choice([None, None, True, False]) for _ in range(r.randint(0, 9))]
        headings = [r.random() < 0.2 for _ in marks]
        want = []
        for k, m in enumerate(marks):
            if m is None and any(x is not None for x in marks):
                after = [j for j in range(k, len(marks)) if marks[j] is not None]
                near = min(abs(j - k) for j, x in enumerate(marks) if x is not None)
                m = marks[after[0]] if headings[k] and after else any(marks[j] for j in (k - near, k + near) if 0 <= j < len(marks) and marks[j] is not None)
            want.append(m)
        assert html_text.inherited(marks, headings) == want


@needs_data
def test_rules_decide_the_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    count = {}
    for r in rows:
        for _, keep, rule in html_text.decided(r.html):
            count[rule, keep] = count.get((rule, keep), 0) + 1
    assert count["stop words", True] > 500 and count["sentence", True] > 100 and count["inherited", True] > 100


def test_html_is_linear():
    for page in ("<div>" * 20000 + "</p>a " * 20000, "<p>a" * 20000, "<div>x</div>" * 20000, "<p>" + "<b>" * 20000 + "<div>" * 100):
        html_text.main_text(page)


# 5


def test_plan_is_exact_and_tight():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 101, 5000), minlength=101)
    plan = packing.planned(counts, 100, rounds=32)
    used = np.zeros(101, int)
    for copies, sizes in plan.patterns:
        assert sum(sizes) <= 100
        for size in sizes:
            used[size] += copies
    assert (used == counts).all() and plan.sequences == sum(c for c, _ in plan.patterns)
    assert plan.bound <= plan.sequences <= np.ceil((counts * np.arange(101)).sum() / 100) * 1.01 + 2
    assert packing.planned(np.zeros(101, int), 100).patterns == []


def test_plan_is_never_worse_than_best_fit():
    rng = np.random.default_rng(4)
    for k in range(40):
        counts = np.bincount(rng.integers(1, 41, int(rng.integers(1, 300))), minlength=41)
        plan = packing.planned(counts, 40, rounds=int(rng.integers(1, 40)), rate=float(rng.choice([0, 0.5, 2])))
        bins: list[int] = []
        for size in np.repeat(np.arange(40, 0, -1), counts[40:0:-1]):
            fits = [(room - size, j) for j, room in enumerate(bins) if room >= size]
            if fits:
                bins[min(fits)[1]] -= size
            else:
                bins.append(40 - size)
        assert plan.bound <= plan.sequences <= len(bins), k


def test_weights_bound_small_programmes():
    """Pieces of 6 and 4 fill sequences of 10 exactly; three pieces of 6 can't share."""
    assert packing.planned(np.bincount([6] * 9 + [4] * 9, minlength=11), 10).sequences == 9
    alone = packing.planned(np.bincount([6] * 7, minlength=11), 10)
    assert alone.sequences == alone.bound == 7


def test_packing_query(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    whole = Tokenizer.from_file(path)
    encode = packing.encoder(path)
    for t in ["", "a  b", " a b ", "\n a", "x<|endoftext|>y", "it's 'll  \t z", "日本 語"]:
        assert list(struct.unpack(f"<{len(encode(t)) // 4}I", encode(t))) == whole.encode(t, add_special_tokens=False).ids
    assert packing.packing_query(none).count() == 0
    got = packing.packing_query(odd).collect()
    for r in odd.dropDuplicates(["doc_id"]).collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]
        mine = {x.piece: x for x in got if x.doc_id == r.doc_id}
        assert sum(x.length for x in mine.values()) == len(ids)
        for x in mine.values():
            assert x.ids_crc32 == zlib.crc32(struct.pack(f"<{x.length}I", *ids[x.start : x.start + x.length]))
            assert x.length == 2048 or x.piece == 0
    for _, g in itertools.groupby(sorted(got, key=lambda x: (x.sequence_id, x.offset)), key=lambda x: x.sequence_id):
        at = 0
        for x in g:
            assert x.offset == at
            at += x.length
        assert at <= 2048


# 6


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8))
    x[500:520] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [None] * 8), (2400, [])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, node int")
    visits = []
    got = neighbours.search(df, "vec_id", "embedding", block=64, visits=visits).collect()
    hits = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        hits += len({r.vec_id for r in mine} & set(want.tolist()))
        assert [r.rank for r in mine] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-12 for r in mine)
    assert hits >= 0.9 * 90 and [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)] == list(range(500, 510))
    assert sum(visits) < 9 * 900  # a small table without clusters; README has the share on larger ones
    assert neighbours.search(df.where("vec_id < 3"), "vec_id", "embedding").count() == 2
    assert neighbours.search(df.where("vec_id < 0"), "vec_id", "embedding").count() == 0


def test_walk_scores_no_pair_twice(spark, monkeypatch):
    """A pool that much falls out of, many small buckets, and queries that walk in turns."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    df = spark.createDataFrame([(i * 10, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "NODES_IN_BUCKET", 50, raising=False)
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 1000, raising=False)
    visits = []
    got = neighbours.search(df, "vec_id", "embedding", block=64, pool=30, expanded=10, visits=visits).collect()
    assert sum(visits) <= 40 * 400
    hits = 0
    for q in range(0, 400, 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len({r.vec_id for r in got if r.query_id == q * 10} & set((np.argsort(d)[:10] * 10).tolist()))
    assert hits >= 0.9 * 400


def test_met_edges():
    """Only edges that a list may take: not between two old ones, none below the bound, the nearest `kept` of each node."""
    x = np.array([[0], [1], [3], [7], [7], [20]], np.float32)
    at, ids, low = np.array([5, 5, 5, 5, 5, 6]), np.array([10, 11, 12, 13, 13, 14]), np.full(6, -np.inf, np.float32)
    fresh = np.array([False, False, True, False, True, True])
    of = lambda bound, kept: {(int(a), int(b)): float(s) for a, b, s in zip(*neighbours.met_edges(at, ids, x, fresh, bound, kept), strict=True)}
    every = {(10, 12): -9.0, (10, 13): -49.0, (11, 12): -4.0, (11, 13): -36.0, (12, 13): -16.0}
    assert of(low, 9) == every | {(b, a): s for (a, b), s in every.items()}
    assert of(low, 1) == {(10, 12): -9.0, (11, 12): -4.0, (12, 11): -4.0, (13, 12): -16.0}
    assert set(of(np.full(6, -9.0, np.float32), 9)) == {(11, 12), (12, 11)}


def test_neighbours_of_odd_vectors(spark):
    """Each length by itself, a vec_id with two vectors, a repeated row, and one huge component that leaves the others apart."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, [1.0, 2.0]), (101, [1.0, 2.5]), (102, [9.0, 2.0]), (0, [50.0, 50.0, 50.0]), (5, x[5].tolist()), (200, [1e9, 0.0, 0.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == 100), key=lambda r: r.rank)] == [(1, 101, 0.5), (2, 102, 8.0)]
    d = np.sqrt(((x - x[0]) ** 2).sum(1))
    near = np.lexsort((np.arange(40), d))[1:6].tolist()
    assert set(near) <= {r.vec_id for r in got if r.query_id == 0}
    assert len([r for r in got if r.query_id == 200]) == 10


# 7


def test_mixing(spark, odd, none):
    assert mixing.targets({"a": 100, "b": 10, None: 50}) == pytest.approx({"a": 130 * 5 / 6, "b": 30.0, None: 130 / 6})
    rng = random.Random(4)
    for _ in range(50):
        lengths = np.array(sorted(rng.sample(range(1, 60), 8)))
        counts = np.array([rng.randint(1, 30) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()))
        take = mixing.fit(lengths, counts, budget, window=500)
        assert (take >= 0).all() and (take <= counts).all() and abs(int((take * lengths).sum()) - budget) <= int(lengths.max())
    assert mixing.mixing_query(none).count() == 0
    a, b = (sorted(map(tuple, mixing.mixing_query(df).collect()), key=str) for df in (odd, odd.repartition(3)))
    assert a == b and len(a) == 14
    for _, size, source_size, target, taken in a:
        assert 0 <= taken <= 3 * size and target <= 3 * source_size


# 8


def test_language(spark, odd, none):
    assert language.of_documents(none).count() == 0
    got = {r.doc_id: r for r in language.of_documents(odd).collect()}
    assert not got[3].kept and not got[4].kept and got[3].language is None and len(got) == 12
    rows = [(1, "the cat is on the table and the dog was with them"), (2, "der Hund ist in dem Haus und die Katze ist nicht da"), (3, "Это русский текст, который никто не должен принять"), (4, "12 34")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].language, got[2].language, got[3].kept, got[4].kept) == ("en", "de", False, False)
    pages = [(i, f"https://www.h{i % 2}.example.de/x", '<html lang="de"><p>', "und der") for i in range(6)] + [(9, "https://www.h0.example.de/y", "<p>", "in")]
    got = {r.doc_id: r for r in language.of_pages(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()}
    assert all(r.language == "de" for r in got.values())


@needs_data
def test_language_held_out(spark):
    """Fitted on four fifths of the labelled rows, right on the rest."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.col("source").alias("host"))
    found = language.identify(docs.select("doc_id", "text", "host"), docs.where("doc_id % 5 <> 0").select("doc_id", "text", "lang"))
    rest = docs.where("doc_id % 5 = 0").select("doc_id", "lang").join(found.where("kept"), "doc_id")
    n, right = rest.agg(F.count(F.lit(1)), F.sum((F.col("lang") == F.col("language")).cast("int"))).first()
    assert n > 150 and right >= 0.98 * n


# 9


def brute_removal(docs):
    first, out = set(), {}
    for i, t in sorted(docs.items()):
        b = (t or "").encode()
        gone, new = bytearray(len(b)), []
        for p in range(len(b) - 49):
            if b[p : p + 50] in first:
                gone[p : p + 50] = b"\1" * 50
            else:
                new.append(b[p : p + 50])
        first.update(new)
        out[i] = (len(b), sum(gone), sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_repeated_bytes(spark, odd, none):
    r = random.Random(6)
    shared, edge = sentence(r, 40), "x" * 49
    docs = {i: f"{sentence(r, r.randint(0, 30))} {shared[: r.randint(40, 160)] if i % 2 else shared} {sentence(r, 5)} {edge if i % 3 else edge + 'x' * 30}" for i in range(60)}
    docs |= {100: "é" * 60, 101: "a" + "é" * 60, 102: shared, 103: shared, 104: None, 105: "", 106: "short", 107: "short"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeated_bytes.removal(df).collect()}
    assert got == brute_removal(docs)
    assert repeated_bytes.removal(none).count() == 0 and repeated_bytes.removal(odd).count() == 14


def test_repeated_bytes_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "small", lambda df, rows=0: df)
    monkeypatch.setattr(repeated_bytes, "SHARD", 100)
    r = random.Random(7)
    docs = {i: sentence(r, 10) + " " + " ".join(WORDS[k] for k in range(i, i + 20)) for i in range(40)}
    got = {x.doc_id: x.n_removed for x in repeated_bytes.removal(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == {i: v[1] for i, v in brute_removal(docs).items()}


def test_hot_minimizers(spark, monkeypatch):
    """A line that all texts hold, each between words of its own: no shard gets more of a minimizer than the limit."""
    for name, value in (("HOT", 500), ("HOT_WINDOW", 20)):
        monkeypatch.setattr(repeated_bytes, name, value, raising=False)
    most = []
    solve = repeated_bytes.shard_owners

    def watched(dealt):
        most.append(dealt.groupBy("value").agg(F.sum(F.length("bytes")).alias("n")).agg(F.max("n")).first()[0] or 0)
        return solve(dealt)

    monkeypatch.setattr(repeated_bytes, "shard_owners", watched)
    r = random.Random(11)
    line = sentence(r, 25)
    docs = {(i * 7) % 80: f"{sentence(r, 6)} {line if i % 3 else line[:70]} {sentence(r, 6)}" for i in range(80)}
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeated_bytes.removal(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == brute_removal(docs)
    assert most and most[0] <= 500


def test_minimizers_fill_buckets_evenly(spark):
    """A task holds a bucket; least hashes are small, so ranges of the minimizers themselves are not alike."""
    r = random.Random(6)
    docs = spark.createDataFrame([(i, "".join(r.choices("abcdefgh ", k=4000))) for i in range(60)], "doc_id long, text string")
    found = repeated_bytes.minimizer_lists(repeated_bytes.batched(docs), 16)
    sizes = [x.n for x in found.groupBy("bucket").agg(F.sum(F.length("low") / 4).alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.5 * sum(sizes) / 16


def test_only_windows_found_twice_are_sorted(monkeypatch):
    r = random.Random(8)
    base = bytes(r.choices(b"abcdefgh", k=400))
    lone = [bytes(r.choices(b"abcdefgh", k=68)) for _ in range(200)]
    pairs = [base[a : a + 60] + bytes(r.choices(b"abcdefgh", k=8)) for a in (0, 5, 100, 100)] + [b"a" * 70]
    segments, sorted_bytes, whole = [x for pair in itertools.zip_longest(lone, pairs) for x in pair if x], [], repeated_bytes.owners
    documents = np.array([r.randrange(100) for _ in segments])
    want = whole(segments, documents)
    monkeypatch.setattr(repeated_bytes, "owners", lambda s, *rest: sorted_bytes.append(sum(map(len, s))) or whole(s, *rest))
    table = pa.table({"value": np.arange(len(segments)) // 300, "id1": np.arange(len(segments)), "id2": np.zeros(len(segments), np.int64), "doc": documents, "bytes": pa.array(segments, pa.binary())})

    class Frame:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return list(run(table.to_batches()))

    got = {i: o for batch in repeated_bytes.shard_owners(Frame()) for i, o in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)}
    assert got == {i: w.tolist() for i, w in enumerate(want) if (w < documents[i]).any()}
    assert sum(sorted_bytes) < 500


def test_bits_of_shared_values():
    low, high, several = [[1, 2, 3], [3, 4], [], [5]], [[0, 0, 0], [1, 0], [], [0]], [[False, True, False], [False, False], [], [False]]
    of = lambda lists, kind: [np.array(x, kind) for x in lists]
    assert repeated_bytes.bits_of(of(low, np.uint32), of(high, np.uint16), of(several, bool)) == [b"\x40", b"\x00", b"", b"\x00"]


def test_runs_of_windows(monkeypatch):
    """Runs cover each window once, whatever blocks are, and a window's minimizer does not depend on where it stands."""
    r = random.Random(9)
    texts = [sentence(r, 80).encode(), b"", b"short", b"x" * 9000, sentence(r, 40).encode() * 2]
    body, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    found = repeated_bytes.runs_of(body, sizes)
    monkeypatch.setattr(repeated_bytes, "BLOCK", 97)
    assert all((a == b).all() for a, b in zip(found, repeated_bytes.runs_of(body, sizes), strict=True))
    at, windows, document, value = found
    assert windows.max() <= repeated_bytes.LONGEST and np.bincount(document, windows, 5).astype(int).tolist() == [max(0, len(t) - 49) for t in texts]
    for a, n, v in zip(at.tolist(), windows.tolist(), value.tolist(), strict=True):
        assert (repeated_bytes.minimizers(body[a : a + n + 49]) == v).all()


def test_one_doc_id_with_two_texts(spark):
    """Each row is judged by its own text against smaller doc_ids; a doc_id is not smaller than itself."""
    r = random.Random(12)
    line, other = sentence(r, 20), sentence(r, 20)
    rows = [(1, line + " a"), (1, "b " + line), (2, "c " + line), (2, other), (3, other), (3, other), (3, None)]
    got = sorted((x.doc_id, x.n_bytes, x.n_removed) for x in repeated_bytes.removal(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    size, shared = len(line), len(line) + 1
    assert got == sorted([(1, size + 2, 0), (1, size + 2, 0), (2, size + 2, shared + 0), (2, len(other), 0), (3, len(other), len(other)), (3, len(other), len(other)), (3, 0, 0)])


def test_suffix_sorting():
    """Against plain sorting, for all alphabets, with queues and slabs of a few tuples up to more than the text."""
    r = random.Random(1)
    for k in range(300):
        n, chars = r.randint(0, 60) if k % 7 else r.randint(200, 600), r.choice([1, 2, 3, 5, 200])
        t = [r.randrange(chars) for _ in range(n)]
        if k % 3 == 0 and n:
            t = (t[: r.randint(1, 9)] * n)[:n]
        b = bytes(t)
        with induced_sort.sorted_suffixes(np.asarray(t, np.uint8), 50, r.choice([4, 16, 64, 1 << 18])) as (sa, lcp, _):
            want = sorted(range(n), key=lambda i: b[i:])
            assert sa.tolist() == want
            for i in range(1, n):
                x, y = b[want[i - 1] :], b[want[i] :]
                assert lcp[i] == next((d for d, (p, q) in enumerate(zip(x, y, strict=False)) if p != q or d == 50), min(len(x), len(y), 50))


def test_suffix_sorting_recurses_on_disk():
    """A text far larger than the memory of the queues: several levels, tuples on disk, and the same owners as with all in memory."""
    r = random.Random(2)
    passage = sentence(r, 400)
    parts = [sentence(r, 30) + " " + passage[k : k + 400] for k in range(0, 1600, 40)]
    text = np.frombuffer("\n".join(parts).encode(), np.uint8)
    with induced_sort.sorted_suffixes(text, 50, 256) as (sa, lcp, sorter):
        assert sorter.levels >= 3 and sorter.spilled > len(text)
        small = sa.copy(), lcp.copy()
    with induced_sort.sorted_suffixes(text, 50) as (sa, lcp, sorter):
        assert sorter.spilled == 0 and (sa == small[0]).all() and (lcp == small[1]).all()
    ids = np.arange(len(parts))
    got = repeated_bytes.owners([p.encode() for p in parts], ids, 256)
    assert all((a == b).all() for a, b in zip(got, repeated_bytes.owners([p.encode() for p in parts], ids), strict=True))


# 10


@needs_data
def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.score(docs, labels).where("held_out").join(labels.where("quality is not null"), "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.95 and sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def test_quality_model(spark, odd, none):
    r = random.Random(10)
    docs = [(i, (sentence(r, 80) + ".\n") * (1 if i % 2 else 8), i % 2) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    out = quality_model.score(df.select("doc_id", "text"), df.select("doc_id", "quality")).join(df, "doc_id").where("held_out").collect()
    assert out and all(x.predicted == x.quality for x in out) and all(0 <= x.score <= 1 for x in out)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out)
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_model.score(none, nothing).count() == 0
    assert {x.score for x in quality_model.score(odd, nothing).collect()} == {0.5}


# Pipeline


def test_stages(spark, odd, none):
    """Every stage over odd rows and over none, with columns whose names are those that stages and operators use inside."""
    for docs in (none, odd):
        for name in ("kept", "times", "_id", "_lang", "verdict", "_row", "size", "h1", "class_id", "Language", "with.dot"):
            docs = docs.withColumn(name, F.lit("own"))
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            assert k == 4 or out.columns == docs.columns, name
            rows = out.collect()
            assert k == 4 or all(r["kept"] == r["_id"] == r["with.dot"] == "own" for r in rows), name
            docs = spark.createDataFrame(rows, out.schema)
    assert docs.count() > 0


def test_stages_tell_texts_of_one_doc_id_apart(spark):
    r = random.Random(4)
    a, b = sentence(r, 30), sentence(r, 30)
    rows = [(1, a), (2, b), (2, a + " end"), (3, b), (3, b), (4, None), (4, ""), (5, "other words " + sentence(r, 30))]
    got = sorted((x.doc_id, x.text or "") for x in near_duplicates.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, a), (2, b), (4, ""), (5, rows[-1][1])])
    docs = spark.createDataFrame([(1, "a b c", "s"), (1, "d e", "s"), (2, "f", "t"), (2, "f", "t")], "doc_id long, text string, source string")
    assert {x.text for x in corpus_pipeline.mix_sources(spark, docs, "").collect()} >= {"a b c", "d e", "f"}


def test_whole_groups():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"k": k}) for k in ([1, 1, 2], [2, 2], [2, 3], [], [3])]
    assert [t.column("k").to_pylist() for t in whole_groups(batches, "k")] == [[1, 1], [2, 2, 2, 2], [3, 3]]
