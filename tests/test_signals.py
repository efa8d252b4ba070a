"""Adaptive trials, rasters, decisions, markup, sources and streams."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.operators import adaptive, decide, markup, raster
from panelspark.sources import artifacts
from panelspark.streaming import trials as live


def pool_of(spark, values=(-2.0, -1.0, 0.0, 1.0, 2.0)):
    return adaptive.trial_pool(spark.createDataFrame([(a, v) for a in "xy" for v in values], "axis string, value double"))


def simulated(pool, ideal=0.7, most=8):
    """A rater who prefers what is nearer the ideal, and ties when the gap is small."""
    loop, out = adaptive.Loop(pool, most), []
    while (step := loop.next()) is not None:
        t, repeat = loop.pool[step[0]], step[1]
        a, b = (t["b"], t["a"]) if repeat else (t["a"], t["b"])
        gap = abs(b - ideal) - abs(a - ideal)
        out.append("TIE" if abs(gap) < 0.18 else "A" if gap > 0 else "B")
        loop.answer(step[0], out[-1])
    return out


def test_pool_and_replay(spark):
    rows = [r.asDict() for r in pool_of(spark).collect()]
    assert len(rows) == 80 and len({r["trial_id"] for r in rows}) == 80
    said = simulated(rows)
    assert len(said) == 8
    shown = adaptive.Loop(rows, 8).replay(said)
    assert len({s["trial_id"] for s in shown}) == 8 and shown[-1]["repeat_of"] == shown[0]["trial_id"] and (shown[-1]["a"], shown[-1]["b"]) == (shown[0]["b"], shown[0]["a"])
    answers = spark.createDataFrame([(r, i, c) for r in ("u1", "u2") for i, c in enumerate(said)] + [("u1", 8, "A")], "rater string, position long, choice string")
    got = adaptive.replay(answers, rows, 8).orderBy("rater", "step").collect()
    assert [g.trial_id for g in got] == [s["trial_id"] for s in shown] * 2
    tied = answers.selectExpr("rater", "struct(0L AS ts, position AS id) AS position", "choice")  # one time for all: ids decide
    assert adaptive.replay(tied, rows, 8).orderBy("rater", "step").collect() == got


def test_many_raters_at_once_take_the_steps_of_one(spark):
    rows = [r.asDict() for r in pool_of(spark, (-1.25, -0.75, 0.25, 0.75)).collect()]
    rng = random.Random(5)
    said = {f"u{i}": [rng.choice(["A", "B", "TIE", "ABSTAIN"]) for _ in range(rng.randrange(1, 12))] for i in range(150)}
    answers = spark.createDataFrame([(r, i, c) for r, cs in said.items() for i, c in enumerate(cs)], "rater string, position long, choice string").repartition(3)
    got = {(g.rater, g.step): g for g in adaptive.replay(answers, rows, 10).collect()}
    want = [{"rater": r, **w} for r, cs in said.items() for w in adaptive.Loop(rows, 10).replay(cs)]
    assert len(got) == len(want) and all(got[w["rater"], w["step"]].asDict() == w for w in want)
    few = [r for r in rows if r["axis"] == "x"][:3]  # a pool that runs out before the closing repeat
    assert adaptive.replay(answers, few, 10).count() == sum(len(adaptive.Loop(few, 10).replay(cs)) for cs in said.values())
    assert adaptive.replay(answers, [], 10).count() == 0


@pytest.mark.parametrize("many", [3000])
def test_a_replay_starts_no_study_by_itself(many):
    """One policy serves a batch: a rater costs a row of its matrices, not a policy of its own."""
    pool = [{"trial_id": f"{a}{i}", "axis": a, "size": 16, "theme": "light", "a": float(i), "b": i + 1.0, "tie_break": f"{i}{a}", "repeat_id": "r"} for a in "xy" for i in range(-3, 3)]
    policy = adaptive.Panel(pool, 8)
    codes = np.random.default_rng(1).integers(0, 4, (many, 8))
    places, shown = policy.replay(codes, np.full(many, 8))
    assert (shown == 8).all() and (places[:, 7] == places[:, 0]).all() and all(len(set(p[:7])) == 7 for p in places.tolist())
    loop = adaptive.Loop(pool, 8)
    said = ["A", "B", "TIE", "ABSTAIN"]
    assert [policy.pool[p]["trial_id"] for p in places[0]][:7] == [t["trial_id"] for t in loop.replay([said[c] for c in codes[0]])][:7]


def test_stream_shows_what_the_batch_replays(spark, tmp_path):
    rows = [r.asDict() for r in pool_of(spark).collect()]
    said = simulated(rows)
    shown = adaptive.Loop(rows, 8).replay(said)
    source = tmp_path / "in"
    source.mkdir()
    for i, c in enumerate([*said, "A"]):
        spark.createDataFrame([("u1", i, c)], "rater string, step int, choice string").coalesce(1).write.mode("append").json(str(source))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("rater string, step int, choice string").option("maxFilesPerTrigger", 3).json(str(source))
    q = live.live_trials(stream, rows, 8).writeStream.format("memory").queryName("shown").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.step: r for r in spark.table("shown").collect()}
    assert [got[i].trial_id for i in range(7)] == [s["trial_id"] for s in shown[1:]]
    assert got[6].status == "repeat" and got[7].status == "complete" and got[8].status == "mismatch"


def test_event_windows_on_a_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.5D value, 1L user_id UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'a', 2D, 1L UNION ALL SELECT timestamp'2024-01-01 09:00:00', 'b', 0D, 2L").write.parquet(str(tmp_path / "e"))
    static = spark.read.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(static.schema).parquet(str(tmp_path / "e"))
    q = live.vote_rates(stream).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.event_type, r.n, r.total) for r in spark.table("rates").collect()] == [("a", 2, 3.5)]
    assert live.rater_sessions(static).count() == 2


def test_posteriors_and_ideal_points(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        a, b = rng.choice([-2, -1, 0, 1]), 0
        b = a + 1
        gap = abs(b - 0.7) - abs(a - 0.7)
        rows.append(("x", float(a), float(b), "TIE" if abs(gap) < 0.18 else "A" if gap > 0 else "B"))
    counts = adaptive.choice_counts(spark.createDataFrame(rows + [("x", 0.0, 1.0, "ABSTAIN")] * 50, "axis string, a double, b double, choice string"), ["axis"])
    p = adaptive.posterior(counts, ["axis"]).toPandas().sort_values("i")
    assert p.p.sum() == pytest.approx(1) and abs((p.p * p.mu).sum() - 0.7) < 0.5
    losses = adaptive.search_losses(counts, ["axis"])
    point, interval = adaptive.ideal_point(losses, ["axis"]).first(), adaptive.ideal_interval(losses, ["axis"]).first()
    assert abs(point.ideal_percent - 0.7) < 0.35 and interval.low <= point.ideal_percent <= interval.high


def test_information_prefers_the_undecided_middle(spark):
    pool = pool_of(spark)
    flat = spark.range(101).select(F.explode(F.array(F.lit("x"), F.lit("y"))).alias("axis"), adaptive.grid_point(F.col("id")).alias("mu"), F.lit(1 / 101).alias("p"))
    seen = spark.createDataFrame([(16, "light", 5)], "size int, theme string, n long")
    best = adaptive.next_trial(adaptive.information(pool, flat, seen), ["axis"]).collect()
    rows = [r.asDict() for r in pool.collect()]
    loop = adaptive.Loop(rows)
    loop.seen[16, "light"] = 5
    assert loop.pool[loop.next()[0]]["trial_id"] in {b.trial_id for b in best} and all((b["size"], b.theme) != (16, "light") for b in best)


def test_sequences_and_repeats(spark):
    rows = [("a", i, v) for i, v in enumerate("pqrsp")] + [("b", i, "p") for i in (0, 1, 3)]
    df = spark.createDataFrame(rows, "rater string, i int, v string")
    got = {r.rater: r for r in adaptive.sequence_check(df, "rater", "i", "v", "v").collect()}
    assert got["a"].contiguous and got["a"].closed and got["a"].long_enough and not got["b"].contiguous and not got["b"].long_enough
    r = adaptive.repeat_reliability(df, ["rater", "v"], ["i"], "v").first()
    assert (r.repeats, r.consistent) == (3, 3)


def test_grids(spark):
    got = spark.range(1).select(adaptive.candidate_values(F.lit(0.37), 1.0, 0.5).alias("a"), adaptive.candidate_values(F.lit(None).cast("double"), 1.0, 0.5).alias("b"), adaptive.candidate_values(F.lit(7.0), 0.5, 0.5).alias("c")).first()
    assert got.a == [-1, -0.5, 0, 0.37, 0.5, 1] and got.b == [-1, -0.5, 0, 0.5, 1] and got.c == [-0.5, 0, 0.5]
    t = adaptive.adjacent_trials(spark.createDataFrame([("s", v) for v in (0.0, 1.0, -1.0)], "s string, value double"), ["s"]).orderBy("lower").collect()
    assert [(r.lower, r.upper) for r in t] == [(-1, 0), (0, 1)]


# --- rasters


def square(x0, y0, w, h, v=255, size=8):
    a = np.zeros((size, size), int)
    a[y0 : y0 + h, x0 : x0 + w] = v
    return a


def framed(spark, *arrays):
    return spark.createDataFrame([(i, a.ravel().tolist()) for i, a in enumerate(arrays)], "id int, alpha array<int>")


def test_measures_against_loops(spark):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, (8, 8)) * (rng.random((8, 8)) < 0.5) for _ in range(12)] + [np.zeros((8, 8), int), square(2, 3, 4, 2)]
    df = framed(spark, *images)
    b, c, e = ({r.id: r for r in f(df, "id").collect()} for f in (raster.bounds, raster.centroid, raster.edge_centroid))
    for i, a in enumerate(images):
        on = np.argwhere(a > 1)
        if not len(on):
            assert b[i].min_x is None and c[i].x is None and e[i].x is None
            continue
        assert (b[i].min_x, b[i].max_x, b[i].min_y, b[i].max_y) == (on[:, 1].min(), on[:, 1].max(), on[:, 0].min(), on[:, 0].max())
        w = sx = es = ex = 0.0
        pad = np.pad(a, 1)
        for y, x in on:
            w, sx = w + a[y, x], sx + a[y, x] * (x + 0.5)
            d = sum(abs(int(a[y, x]) - int(pad[y + 1 + dy, x + 1 + dx])) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)))
            es, ex = es + d, ex + d * (x + 0.5)
        assert c[i].x == pytest.approx(sx / w) and e[i].edge_sum == es and e[i].x == pytest.approx(ex / es)


def test_symmetry(spark):
    df = spark.createDataFrame([(0, [0, 2, 5, 2, 0, 0, 0, 0]), (1, [0] * 8), (2, [1, 0, 0, 0, 0, 0, 0, 1])], "id int, p array<bigint>")
    got = {r.id: r for r in raster.symmetry(df, "id", "p").collect()}
    assert (got[0].axis2, got[0].score) == (5, 1.0) and got[1].axis2 is None and got[2].axis2 == 8


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=25))
def test_hull_holds_every_point(points):
    hull = raster.hull_of([(float(x), float(y)) for x, y in points])
    assert set(hull) <= {(float(x), float(y)) for x, y in points}
    if len(hull) >= 3:
        for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1], strict=True):
            assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for x, y in points)


def test_hull_centres_and_components(spark):
    assert raster.area_centre(raster.hull_of([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (2.0, 1.0)])) == (2.0, 1.0)
    assert raster.area_centre([(0.0, 0.0), (1.0, 1.0)]) is None
    a = square(0, 0, 2, 2) + square(5, 5, 1, 1) + square(4, 0, 1, 3)
    assert raster.component_count_of(a) == 2
    r = raster.shapes(framed(spark, a, np.zeros((8, 8), int)), "id").orderBy("id").collect()
    assert r[0].components == 2 and r[1].components == 0 and r[1].hull_x is None


def test_retention(spark):
    got = raster.shifted_retention(framed(spark, square(0, 0, 8, 8), square(2, 2, 2, 2)), "id").orderBy("id").collect()
    assert (got[0].retained, got[0].sides) == (0.875, "right,raster-loss") and (got[1].retained, got[1].sides) == (1.0, "")


# --- decisions


def combined(spark, *values, names=("alpha", "edge", "convexHull", "symmetry")):
    made = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("value")) for n, v in zip(names, values, strict=False)])
    return spark.range(1).select(decide.combine(made).alias("c")).first().c


@pytest.mark.parametrize(("values", "status", "band"), [((0.02, -0.03, 0.0), "NO_CHANGE", "strong"), ((1.0, 1.2, 1.4), "REVIEW", "strong"), ((0.5, 1.2, 1.8), "REVIEW", "mixed"), ((-1.2, 0.0, 1.2), "ABSTAIN", "conflict"), ((1.39, -1.86, 1.31), "REVIEW", "mixed"), ((1.0, float("nan"), float("inf")), "ABSTAIN", None)])
def test_signal_bands(spark, values, status, band):
    c = combined(spark, *values)
    assert (c.status, c.band) == (status, band)
    if values == (1.39, -1.86, 1.31):
        assert c.consensus == 1.31  # the edge alone can't make a conflict
    if band is None:
        assert c.reason == "insufficient-signals"


def test_proposals_reviews_and_gates(spark):
    L = F.lit
    row = spark.range(1).select(
        decide.proposal(L(4.0), L(4.0), L(None).cast("string")).alias("far"), decide.proposal(L(0.01), L(0.02), L(None).cast("string")).alias("near"), decide.proposal(L(1.0), L(-1.0), L(None).cast("string")).alias("mid"),
        decide.axis_action(L(0.0), L(1.0)).alias("a"), decide.axis_action(L(1.0), L(1.0)).alias("b"), decide.axis_action(L(2.0), L(1.0)).alias("c"),
        decide.verification(L(False), L(1.0), L(0.0), L(True), L(True)).alias("ok"), decide.verification(L(True), L(9.0), L(0.0), L(False), L(None).cast("boolean")).alias("bad"), decide.verification(L(False), L(1.0), L(0.0), L(True), L(None).cast("boolean")).alias("ask"),
        decide.apply_gate(one=L(True), two=L(None).cast("boolean")).alias("g"), decide.bounds_first(L(0.13), L(0.0), L(0.1), L(0.1)).alias("f1"), decide.bounds_first(L(0.02), L(0.0), L(0.1), L(0.1)).alias("f2"), decide.bounds_first(L(0.02), L(0.0), L(0.001), L(0.1)).alias("f3"),
        decide.pixel_offsets(L(1.38955), L(-0.000188), F.array(L(16), L(24))).alias("px"), decide.diagnosis(L(False), L(True), L(True)).alias("d"),
    ).first()
    assert row.far.reason == "proposal-out-of-range" and row.near.status == "NO_CHANGE" and (row.mid.status, row.mid.dx) == ("REVIEW", 1.0)
    assert (row.a, row.b, row.c) == ("ZERO", "ACCEPT_PROPOSAL", "OVERRIDE")
    assert row.ok.status == "PASS" and row.bad.status == "FAIL" and row.bad.codes == ["post-correction-clipping", "correction-out-of-range", "review-approval-required"] and row.ask.codes == ["comparison-required"]
    assert row.g == ["two"] and (row.f1, row.f2, row.f3) == (True, False, True) and row.px[0].dx == 0.2223 and row.d == "manual-review"


# --- markup


GOOD = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 24 24"><defs><linearGradient id="g"/></defs><path d="M0 0" style="fill: url(#g)"/></svg>'


@pytest.mark.parametrize(("text", "codes"), [
    (GOOD, set()), ("<!DOCTYPE x>" + GOOD, {"unsafe-doctype"}), ("<!ENTITY x>" + GOOD, {"unsafe-entity"}), ('<?xml version="1.0"?>' + GOOD, set()), ("<?php ?>" + GOOD, {"unsafe-processing-instruction"}),
    (GOOD.replace("<path", '<path onclick="x"'), {"unsafe-event-attribute"}), (GOOD.replace("<path", "<script/><path"), {"unsafe-element-script"}), (GOOD.replace("<path", "<blink/><path"), {"unsupported-element"}),
    (GOOD.replace("<path", '<use href="http://a"/><path'), {"external-resource"}), (GOOD.replace("<path", '<use xlink:href="#g"/><path'), set()), (GOOD.replace("url(#g)", "url(http://a)"), {"unsafe-style"}), (GOOD.replace("fill:", "f\\69ll:"), {"unsafe-style"}),
    (GOOD.replace('"0 0 24 24"', '"0 0 0 24"'), {"invalid-viewbox"}), (GOOD.replace("<path", "<g>" * 500 + "<path").replace("</svg>", "</g>" * 500 + "</svg>"), {"tree-too-deep"}),
    (GOOD.replace("<path", '<path fill="url(https://x)"'), {"external-resource"}),
])
def test_issues(spark, text, codes):
    assert {r.code for r in markup.issues(spark.createDataFrame([(1, text)], "id int, m string"), "id", "m").collect()} == codes


def test_boxes_candidates_features(spark):
    df = spark.createDataFrame([(GOOD,)], "m string").withColumn("box", markup.parse_view_box(F.lit(" 0,0 24  24 ")))
    r = df.select(markup.candidate_box(F.col("box"), F.lit(1.5), F.lit(-2.0)).alias("b"), markup.candidate(F.col("m"), F.col("box"), F.lit(1.5), F.lit(0.0)).alias("c"), markup.feature_counts(F.col("m")).alias("f"), markup.parse_view_box(F.lit("0 0 1")).alias("none"), markup.parse_view_box(F.lit("0 0 x 1")).alias("bad")).first()
    assert r.b == "-0.36 0.48 24 24" and 'viewBox="-0.36 0 24 24"' in r.c and r.c.count("viewBox") == 1 and r.f.gradients == 1 and r.none is None and r.bad is None


# --- sources and sinks


def test_jsonl_keeps_schemas_closed(spark, tmp_path):
    f = tmp_path / "rows.jsonl"
    f.write_bytes(b'{"a": 1, "b": "x"}\r\n\n   \n{"a": 1, "b": "x", "c": 2}\n{"a": 1}\nnot json\n')
    got = sorted((r.violations for r in artifacts.read_jsonl(spark, str(f), "a int, b string", ["a", "b"]).collect()), key=str)
    assert got == [[], ["missing-key"], ["unknown-key"], ["unparsed"]] or Counter(map(str, got)) == Counter(map(str, [[], ["missing-key"], ["unknown-key"], ["unparsed"]]))


def test_corpus_manifest_limits_and_sinks(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"p{i}.jsonl").write_text("".join(json.dumps({"a": i, "b": "x"}) + "\n" for _ in range(3)))
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 1, "sources": [{"source_id": f"s{i}", "family_id": "f", "group_id": "g", "audit": "a.json", "preferences": [f"p{i}.jsonl"]} for i in range(2)]}))
    rows = artifacts.read_corpus(spark, str(tmp_path / "m.json"), "a int, b string", ["a", "b"])
    assert {(r.a, r.source_id) for r in rows.collect()} == {(0, "s0"), (1, "s1")} and rows.count() == 6
    assert artifacts.limit_violations(spark, str(tmp_path / "*.jsonl"), 300) == ["too-many-sources"]
    artifacts.write_jsonl(rows.select("a", F.lit(None).cast("string").alias("n")), str(tmp_path / "out"))
    assert '"n":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    with pytest.raises(Exception, match="exist"):
        artifacts.write_jsonl(rows.select("a"), str(tmp_path / "out"))
    assert artifacts.write_report(spark.createDataFrame([(1, None)], "x int, y string"), str(tmp_path / "r.md")).splitlines()[2] == "| 1 |  |"
    broken = tmp_path / "broken.json"
    broken.write_text("{")
    assert artifacts.read_json(spark, str(broken), "a int").first()._corrupt_record is not None


def test_markup_source(spark, tmp_path):
    (tmp_path / "a.svg").write_text(GOOD)
    r = artifacts.read_markup(spark, str(tmp_path / "*.svg")).first()
    assert r.sha256 == hashlib.sha256(GOOD.encode()).hexdigest() and r.markup == GOOD
