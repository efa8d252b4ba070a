"""The whole pipeline on a small corpus against a brute-force version of its stages."""

import random

import corpus_pipeline
from panelspark.llm import html_text, recurrent_lm, token_counts
from panelspark.llm.common import words_of
from panelspark.llm.queries import tokenizer_path


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijkmnop") for _ in range(6))
    items = [[word() for _ in range(20)] for _ in range(5)]
    docs, labels, base = [], [], []
    for i in range(160):
        words = [word() for _ in range(40)]
        if i % 8 == 0:
            words[5] = words[20] = "idiot"
        if i % 16 == 3:
            words[10:10] = [w.upper() for w in items[i % 5]]
        if i % 16 == 5 and base:
            words = list(base[i % len(base)])
            words[0] = word()  # a near copy: 36 of 38 shingles of five words are its original's
        else:
            base.append(words)
        docs.append((i, "Common line.\n" * (i % 3 == 0) + " ".join(words), "en", "src", 0))
        labels.append((i, 1, int(i % 8 == 0)))
    docs += [(900, None, "en", "src", 0), (901, "", "en", "src", 0)]
    return docs, labels, [(i, " ".join(w)) for i, w in enumerate(items)]


def expected(docs, items):
    """Stage by stage, with plain loops."""
    rows = [(d, t or "") for d, t, *_ in docs if "idiot" not in words_of(t)]
    seen = {}
    for d, t in rows:
        for line in set(t.split("\n")) - {""}:
            seen.setdefault(line.strip().lower(), set()).add(d)
    rows = [(d, "\n".join(x for x in t.split("\n") if len(seen.get(x.strip().lower(), ())) < 10)) for d, t in rows]
    sets = {d: {tuple(words_of(t)[i : i + 5]) for i in range(len(words_of(t)) - 4)} for d, t in rows}
    par = {d: d for d in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    rows = [(d, t) for d, t in rows if find(d) == d]
    return [(d, t) for d, t in rows if not any(" ".join(words_of(w)) in " ".join(words_of(t)) for _, w in items)]


def test_pipeline(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer, _ = token_counts.load(tokenizer_path("word_bpe_49k.json"))
    want = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in expected(docs, items)}
    assert {r.doc_id: r.length for r in got} == want and 100 < len(want) < 140
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_stages_keep_the_columns(spark, tmp_path):
    docs, labels, items = corpus()
    df = spark.createDataFrame(docs[:20], "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.drop_lines(spark, df, str(tmp_path))
    assert lines.columns == df.columns and all(r.n_chars == len(r.text) for r in lines.collect())


def test_rows_go_by_their_own_text(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = items[0][1]
    odd = [(None, "you idiot and idiot again", "en", "null", 0), (1000, "you idiot and idiot again", "en", "bad", 0), (1000, "a kind word", "en", "kind", 0), (None, leak, "en", "null", 0), (1001, leak, "en", "bad", 0), (1001, "a clean word", "en", "clean", 0), (None, "no id", "en", "plain", 0)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_toxic(spark, df, str(tmp_path))
    assert kept.columns == df.columns and not [r for r in kept.collect() if r.text and "idiot" in r.text]
    clean = corpus_pipeline.drop_leaks(spark, kept, str(tmp_path))
    assert clean.columns == df.columns and sorted(r.source for r in clean.collect() if r.source != "src") == ["clean", "kind", "plain"]


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, clashing names, empty tables."""
    docs, labels, items = corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([*items, (50, None), (51, ""), (None, "no item id at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = [(700, None), (700, None), (None, None), (701, ""), (702, "one word " * 30_000), (703, "\n" * 300), (704, docs[1][1]), (704, docs[1][1]), (705, "x" * 100_000)]
    names = "doc_id long, text string, lang string, n_chars long, key string, score string, predicted int, kept boolean, state int, row string, word string, n string, length long, range int, id int"
    df = spark.createDataFrame([(d, t, "en", 0, "k", "s", 1, True, 2, "r", "w", "n", 3, 4, 5) for d, t, *_ in [*docs, *odd]], names)
    at = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name
        at = stage(spark, at, str(tmp_path))
        assert at.columns == df.columns, name
    kept = at.collect()
    assert {(r.score, r.predicted, r.key, r.row) for r in kept} == {("s", 1, "k", "r")}
    ids = [r.doc_id for r in kept]
    assert ids.count(700) == 2 and ids.count(None) == 1 and {701, 702, 703, 705} <= set(ids) and 704 not in ids
    packed = corpus_pipeline.pack(spark, at, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(ids) and sum(r.length for r in packed if r.doc_id == 701) == 1
    assert corpus_pipeline.pack(spark, df.limit(0), str(tmp_path)).count() == 0


# --- language model


def test_language_model(spark):
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    rng = random.Random(12)
    follow = {w: rng.sample(["sun", "moon", "star", "sky", "sea", "sand"], 2) for w in ["sun", "moon", "star", "sky", "sea", "sand"]}
    rows = []
    for i in range(240):
        w, text = "sun", []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(follow[w])
            text.append(w if rng.random() < 0.95 else f"odd{rng.randrange(500)}")
            w = w if w in follow else "sun"
        rows.append((i, " ".join(text)))
    rows += [(500, None), (501, ""), (501, ""), (502, "never seen é.\n" * 3)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, word string, row string")
    training = F.col("doc_id") % 10 != 0
    got = recurrent_lm.score_documents(df, training, train_tokens=60_000, hidden=16)
    out = [r.asDict() for r in got.collect()]
    counts = Counter(x for d, t in rows if d % 10 for x in [*words_of(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], r)
    for d, t in rows:
        tokens = [*words_of(t), "\n"]
        r = by[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[x] > 0 for x in tokens), n)
        assert abs(r["base_score"] - sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)) < 1e-6
    held = [r for r in out if r["doc_id"] % 10 == 0]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    none = recurrent_lm.score_documents(df, F.lit(False)).collect()
    assert len(none) == len(rows) and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)
    assert recurrent_lm.score_documents(df.limit(0), training).count() == 0


def test_all_training_tokens_train_the_network(spark, monkeypatch):
    from pyspark.sql import functions as F

    trained = []
    fit = recurrent_lm.fit
    monkeypatch.setattr(recurrent_lm, "fit", lambda net, encoded, n, tokens: trained.append(fit(net, encoded, n, tokens, task_tokens=100_000, buffer_tokens=40_000)))
    rng = random.Random(13)
    cycle = ["sun", "moon", "star", "sky", "sea", "sand"]
    rows = []
    for i in range(1500):
        at = rng.randrange(6)
        rows.append((i, " ".join(cycle[(at + k) % 6] for k in range(120))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = recurrent_lm.score_documents(df, F.col("doc_id") % 10 != 0, train_tokens=1, hidden=16).collect()
    held = [r for r in out if r.doc_id % 10 == 0]
    assert trained == [1350 * 121] and out[0].train_tokens == 1350 * 121
    assert sum(r.score for r in held) > 0.985 * sum(r.base_score for r in held)


def test_copies_of_a_text_train_as_often_as_they_stand(spark, monkeypatch):
    from pyspark.sql import functions as F

    fit, seen = recurrent_lm.fit, []

    def spy(net, encoded, n, tokens):
        rounds = {(len(r["ids"]) // 4, r["round"]): r["count"] for r in encoded.groupBy("ids", "round").count().collect()}
        seen.append((n, rounds, fit(net, encoded, n, tokens, task_tokens=3_000)))

    monkeypatch.setattr(recurrent_lm, "fit", spy)
    df = spark.createDataFrame([(i, "copy of a text" if i % 3 == 0 else "sun moon") for i in range(960)], "doc_id long, text string")
    recurrent_lm.score_documents(df, F.lit(True), train_tokens=1, hidden=8).count()
    (n, rounds, trained), = seen
    assert trained == n == 320 * 5 + 640 * 3
    copies = {r: c for (size, r), c in rounds.items() if size == 5}
    assert sum(copies.values()) == 320 and set(copies) == set(range(5)) and copies[4] == 160


def test_probabilities_sum_to_one_and_state_is_carried():
    import numpy as np

    net = recurrent_lm.Net(np.array([5.0, 9, 4, 3, 2]), np.ones(recurrent_lm.SHAPES), 2, 8)
    rng = np.random.default_rng(1)
    for k in ("c", "w", "rn", "rzr"):
        net.p[k] += rng.standard_normal(net.p[k].shape).astype(np.float32) * 0.3
    h = rng.standard_normal((3, 8)).astype(np.float32)
    total = sum(np.exp(net.log_p(h, np.full(3, y))) for y in range(5 + recurrent_lm.SHAPES))
    assert np.allclose(total, 1, atol=1e-5)
    docs = [rng.integers(1, 5, n).tolist() + [0] for n in (70, 3, 0, 40)]
    alone = [float(net.score([np.array(d, np.int32)], window=1000)[0]) for d in docs]
    assert np.allclose(net.score([np.array(d, np.int32) for d in docs], lanes=2, window=7), alone, atol=1e-3)


def test_a_very_long_text_is_scored_by_windows():
    import tracemalloc

    import numpy as np

    net = recurrent_lm.Net(np.array([5.0, 9, 4, 3, 2]), np.ones(recurrent_lm.SHAPES), 2, 8)
    rng = np.random.default_rng(4)
    docs = [rng.integers(1, 5, n).astype(np.int32) for n in (20_000, *[30] * 300)]
    tracemalloc.start()
    got = net.score(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000 and np.isfinite(got).all() and (got < 0).all()  # a grid of 256 lanes took 61 MB
    assert abs(got[0] - net.score(docs[:1])[0]) < 0.5


def test_averages_in_levels_are_those_of_one(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(rng.integers(0, 5, 40).astype(np.int32).tobytes(), i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "ids binary, round int").repartition(9).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else spark.createDataFrame(rows, "ids binary, round int")
    got = []
    for fan in (64, 2):
        monkeypatch.setattr(recurrent_lm, "FAN", fan)
        net = recurrent_lm.Net(np.array([5.0, 9, 4, 3, 2]), np.ones(recurrent_lm.SHAPES), 2, 8)
        assert recurrent_lm.fit(net, df, 8000, 1, task_tokens=900) == 8000
        got.append(net.p)
    assert all(np.allclose(got[0][k], got[1][k], atol=1e-4) for k in got[0])


def test_gradients():
    import numpy as np

    net = recurrent_lm.Net(np.array([5.0, 9, 4]), np.ones(recurrent_lm.SHAPES), 2, 4)
    rng = np.random.default_rng(2)
    h, y = rng.standard_normal((6, 4)).astype(np.float32), np.array([0, 1, 2, 3, 10, 2])
    g = {k: np.zeros_like(p) for k, p in net.p.items()}
    _, dh = net.log_p(h, y, g)
    for i, j in ((0, 0), (3, 2), (5, 1)):
        up, down = h.copy(), h.copy()
        up[i, j] += 1e-2
        down[i, j] -= 1e-2
        assert abs(dh[i, j] + (net.log_p(up, y).sum() - net.log_p(down, y).sum()) / 2e-2) < 1e-2


# --- html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="<p>no</p>";</script></head><body><nav><ul><li><a href="/x">Menu {n}</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy {n}</div><div class="cookie-notice">Cookies</div>{main}<aside>Side</aside><div id="comments"><p>First!</p></div><form><p>Mail</p></form><footer>&copy; Foot</footer></body></html>"""


def test_html(spark):
    article = "<article><h1>Head &amp; {n}</h1><p>One\n  <b>bold<i>er</i></b>&nbsp;text.<br>Next<p>Two &lt;tag&gt; &#233;<div class='share'>Share</div><ul><li>a<li>b</ul></article>"
    plain = "<div class='body'><h1>Head {n}</h1><p>A long paragraph of the story, part one of {n}.</p><p>A long paragraph of the story, part two of {n}.</p></div>"
    rows = [(i, f"http://a.example/{i}", PAGE.format(n=i, main=article.format(n=i))) for i in range(6)] + [(20 + i, f"https://b.example:80/{i}", PAGE.format(n=i, main=plain.format(n=i))) for i in range(6)]
    rows += [(90, None, None), (91, "", ""), (92, "not a url", "<p>x"), (None, "http://a.example/z", "<article>lone"), (0, "http://a.example/0", rows[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, slots string")
    for options in ({}, {"max_broadcast": 0}):
        got = html_text.extract(df, **options).collect()
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        by = {r.page_id: r.text for r in got}
        assert by[3] == "Head & 3\nOne bolder text. Next\nTwo <tag> é\na\nb"
        assert by[22] == "Head 2\nA long paragraph of the story, part one of 2.\nA long paragraph of the story, part two of 2."
        assert by[90] == by[91] == "" and by[92] == "x" and by[None] == "lone"
    assert html_text.extract(df.limit(0)).count() == 0


def test_wrappers_merge_mismatches_into_options_and_groups():
    t = lambda *paths: tuple(("", p, "") for p in paths)
    assert html_text.align(t("a", "b", "c"), t("a", "c")) == (("", "a", ""), ("?", "b", ""), ("", "c", ""))
    assert html_text.fold(list(t("x", "a", "b", "a", "b", "a", "b", "y"))) == [("", "x", ""), ("", "a", "+"), ("", "b", "+"), ("", "y", "")]
    assert html_text.read(html_text.written(t("a", "b"))) == t("a", "b")


def _longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def _takes(wrapper, paths):
    """Whether an alignment's expression takes a stream, by trying all ways (no repeated groups)."""
    states = {0}
    for opt, path, _ in wrapper:
        states = {i + 1 for i in states if i < len(paths) and paths[i] == path} | (states if opt else set())
    return len(paths) in states


def test_alignment_against_brute_force(monkeypatch):
    import random

    rng = random.Random(5)
    for bits in (html_text.TRACE_BITS, 8):  # 8: halves down to single tokens
        monkeypatch.setattr(html_text, "TRACE_BITS", bits)
        for _ in range(400):
            a, b = ([rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 14))] for _ in range(2))
            got = html_text.common(a, b)
            assert len(got) == _longest(a, b) and all(a[i] == b[j] for i, j in got)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
            monkeypatch.setattr(html_text, "fold", list)
            both = html_text.align(*(tuple(("", x, "") for x in s) for s in (a, b)))
            monkeypatch.undo()
            monkeypatch.setattr(html_text, "TRACE_BITS", bits)
            assert _takes(both, a) and _takes(both, b)


def test_repeated_groups_of_any_length():
    import random

    rng = random.Random(6)
    for _ in range(300):
        block = [f"p{k}" for k in range(rng.randint(1, 40))]
        times = rng.randint(2, 5)
        paths = ["x", *block * times, "y"]
        got = html_text.repeats(paths)
        assert [paths[s[0]] for s in got] == ["x", *block, "y"] and all(len(s) == times for s in got[1:-1])
        paths = [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        got = html_text.repeats(paths)
        assert sorted(i for s in got for i in s) == list(range(len(paths))) and all(len({paths[i] for i in s}) == 1 for s in got)
        left = [paths[s[0]] for s in got]
        assert not any(left[i] == left[i + 1] for i in range(len(left) - 1))
    long = [f"p{k}" for k in range(3000)]
    assert len(html_text.repeats(long * 2)) == 3000


def test_long_streams_align_in_bounded_memory():
    import tracemalloc

    a = [f"p{k % 97}" for k in range(20_000)]
    b = [f"p{k * 7 % 89}" for k in range(20_000)]
    tracemalloc.start()
    got = html_text.common(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) > 1000 and peak < 64 << 20


def test_a_slot_is_decided_once_for_all_pages_of_its_wrapper(spark):
    """The same path before and after the story: links in one place, text in the other; wrappers of marked pages decide too."""
    top = "<div class='box'><a href='/{n}'>Link {n}</a></div>"
    page = "<body>" + top + "<div class='story'><h1>Head {n}</h1></div><div class='box'>{end}</div></body>"
    rows = [(i, "http://w.example/", page.format(n=i, end=f"The end of {i}, told at length.")) for i in range(4)]
    # one page's own links are more than half of its last box, yet the slot is text on its host
    rows.append((9, "http://w.example/9", page.format(n=9, end="<a>Mostly a link here</a> text")))
    by = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert by[2] == "Head 2\nThe end of 2, told at length." and by[9] == "Head 9\nMostly a link here text"
    found = html_text.blocks("<body><nav>Menu</nav><article><h1>A</h1><p>B</p></article><p>C</p></body>")
    wrapper = tuple(html_text.fold(list(html_text.stream(found))))
    assert [(k, p) for k, p, _ in html_text.decided(wrapper)] == [("-", "!body/nav"), ("a", "body/article/h1"), ("a", "body/article/p"), ("-", "body/p")]


def test_fixed_texts_of_a_host_are_template(spark):
    page = "<body><div class='top'>Our daily site</div><div class='story'><p>First of {n}.</p><p>Read us every day!</p><p>Last of {n}.</p></div>{more}</body>"
    rows = [(i, f"http://t.example/{i}", page.format(n=i, more="<div class='note'>Note {}</div>".format(i) if i % 2 else "")) for i in range(8)]
    rows += [(20 + i, "http://copy.example/", page.format(n=1, more="")) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for options in ({}, {"max_broadcast": 0}):
        by = {r.page_id: r.text for r in html_text.extract(df.repartition(3), **options).collect()}
        assert by[2] == "First of 2.\nLast of 2." and by[3] == "First of 3.\nLast of 3.\nNote 3"
        assert by[21] == "Our daily site\nFirst of 1.\nRead us every day!\nLast of 1."  # copies of one page show no template


def test_each_page_decides_where_its_text_is(spark):
    rows = [
        (1, "http://m.example/1", "<body><article><p>Marked.</p></article><div>Beside</div></body>"),
        (2, "http://m.example/2", "<body><div class='a'><h1>Head</h1><section><p>Dense text of a second template.</p></section><section class='b'><p>Next section.</p></section></div></body>"),
        (3, None, "<body><main><p>No url.</p></main></body>"),
        (4, "/relative", "<body><table><tr><td>Other template.</td></tr></table></body>"),
    ]
    by = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert by == {1: "Marked.", 2: "Head\nDense text of a second template.\nNext section.", 3: "No url.", 4: "Other template."}


def test_class_marks_that_name_an_absent_or_surrounded_part():
    text = "<{0}><p>Text.</p><div class='sidebar'>Side</div></{0}>"
    for mark in ("no-sidebar", "has-sidebar", "layout with-sidebar", "page--has-sidebar", "noSidebar"):
        for name in ("body", "div"):
            page = text.format(name).replace(f"<{name}>", f"<{name} class='{mark}'>")
            assert [x[1] for x in html_text.own_of(html_text.blocks(page))] == ["Text."]
    for name in ("html", "body", "main", "article"):
        assert html_text.own_of(html_text.blocks(f"<{name} class='search'><p>Text."))


def test_exps_of_logits_do_without_a_maximum_while_weights_bound_them():
    import numpy as np

    rng = np.random.default_rng(4)
    rows, of = np.arange(50), rng.integers(0, 9, 50)
    for scale in (1.0, 5.0, 400.0):
        w, b = (rng.standard_normal(x).astype(np.float32) * np.float32(scale) for x in ((6, 9), 9))
        h = np.tanh(rng.standard_normal((50, 6))).astype(np.float32)
        s = (h @ w + b).astype(float)
        want = s[rows, of] - s.max(1) - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1))
        _, total, own = recurrent_lm.exps(h @ w + b, w, b, rows, of)
        assert np.allclose(own - np.log(total), want, rtol=1e-4, atol=1e-3)


def test_words_and_shapes_are_those_of_a_loop_at_a_fraction_of_its_time():
    import time

    import pyarrow as pa

    rng = random.Random(6)
    marks = [*"aZb.,9", *map(chr, range(33)), "\x7f", "\x85", "\xa0", "　", "é", "É", "İ", "漢", "\U0001f600", "ª", "²"]
    texts = [None, "", *("".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(5000))]
    words, sizes = recurrent_lm.split(pa.array(texts, pa.string()))
    want = [(t or "").encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and [w.encode() for w in words.to_pylist()] == [w for ws in want for w in ws]
    assert recurrent_lm.shapes_of(words).tolist() == [recurrent_lm.shape_of(w) for w in words.to_pylist()]
    texts = pa.array([" ".join(rng.choices(["Sun", "moon", "star,", "sky"], k=400)) for _ in range(500)])

    def seconds(f):
        start = time.process_time()
        f()
        return time.process_time() - start

    loop = lambda: [[4 * (not w.isascii()) for w in t.lower().split()] for t in texts.to_pylist()]
    assert min(seconds(lambda: recurrent_lm.split(texts)) for _ in range(3)) < 0.7 * min(seconds(loop) for _ in range(3))


def test_sums_by_id_and_states_after_an_end():
    import numpy as np

    rng = np.random.default_rng(8)
    for m, most in ((5000, 300), (1, 9), (40, 1), (300, 2000)):
        ids, x = np.minimum(rng.zipf(1.3, m), most) - 1, rng.standard_normal((3, m, 4)).astype(np.float32)
        got = np.ones((3, most, 4), np.float32)
        want = got.astype(float)
        for j, i in enumerate(ids.tolist()):
            want[:, i] += x[:, j]
        recurrent_lm.add_by_id(got, ids, x)
        assert np.allclose(got, want, atol=1e-3)
    net = recurrent_lm.Net(np.array([5.0, 9, 4, 3, 2]), np.ones(recurrent_lm.SHAPES), 2, 8)
    for k in ("c", "w", "rn", "rzr"):
        net.p[k] += rng.standard_normal(net.p[k].shape).astype(np.float32) * 0.3
    docs = [np.array([*rng.integers(1, 5, n), 0], np.int32) for n in (7, 3, 0, 12)]
    alone = sum(net.score([d])[0] for d in docs)
    assert abs(net.score(docs, lanes=1, window=4).sum() - alone) < 1e-3  # an end's own state stays as it was
