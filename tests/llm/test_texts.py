"""Toxicity, line dedup, token counts and packing against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import line_dedup, packing, token_counts, toxicity
from panelspark.llm.queries import tokenizer_path

BPE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, " "), (4, "\n\n"), (5, "a\x00b"), (6, "x" * 5000), (6, "x" * 5000), (None, "no id"), (7, "é" * 300 + "<|endoftext|>" + "İΣς 中文　٣²")]


def frame(spark, rows, extra=""):
    """Rows of (id, text) with columns whose names operators use inside."""
    schema = "doc_id long, text string, score string, key string, n string, row string, word string, kept_text string, length string"
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], schema)


# --- line dedup


def lines_by_hand(rows, least):
    cut = {c: c + 32 for c in range(65, 91)}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(cut)
    docs = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if key(line):
                docs[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(docs.get(key(x), ())) < least]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(1)
    pool = ["Top", " top ", "TOP\t", "é", "É", "rare", "", "  ", "x\x0b", "ends"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(60)] + ODD
    got = line_dedup.drop_common_lines(frame(spark, rows), min_docs=5).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got), key=key) == sorted(lines_by_hand(rows, 5), key=key)


def test_lines_keep_columns_and_empty_tables(spark):
    df = frame(spark, [])
    out = line_dedup.drop_common_lines(df)
    assert out.count() == 0 and set(df.columns) | {"n_lines", "n_dropped"} == set(out.columns)


def test_a_line_in_every_document_goes_from_a_very_long_one(spark):
    rows = [(i, "same") for i in range(12)] + [(99, "\n".join(["same", "own"] * 20_000))]
    got = {r.doc_id: r for r in line_dedup.drop_common_lines(frame(spark, rows)).collect()}
    assert got[99].n_dropped == 20_000 and got[99].kept_text == "\n".join(["own"] * 20_000) and got[3].kept_text == ""


# --- token counts


def test_token_counts_against_the_library(spark):
    tokenizer, _ = token_counts.load(BPE)
    got = token_counts.token_counts(frame(spark, ODD), BPE).collect()
    want = [(d, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t in ODD]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    for head in (0, 3, 7):  # pre-tokens beyond the head are joined
        few = token_counts.token_counts(frame(spark, ODD), BPE, head_rows=head, table_rows=2).collect()
        assert sorted(map(str, map(tuple, few))) == sorted(map(str, want))
    assert token_counts.token_counts(frame(spark, []), BPE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z'slre09 \n\t\r\x0b\x1c\x85\xa0é中²Ⅷ٣_-!?́😀ß　<|endoftext>")), max_size=60))
def test_pieces_are_the_library_s(text):
    tokenizer, _ = token_counts.load(BPE)
    pretokens, more = token_counts.splitter(BPE)(text)
    assert more + sum(token_counts.pieces_of(pretokens, BPE)) == len(tokenizer.encode(text, add_special_tokens=False).ids)


# --- packing


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z'slRE09 \n\t\x1c\x85\xa0é中²Ⅷ٣ΣσςİÅ_-!?́😀ß　ﬁK<|endoftext>")), max_size=60))
def test_ids_are_the_library_s(text):
    tokenizer, _ = token_counts.load(WORD)
    assert packing.id_encoder(WORD)([text]) == [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(["İ", "I", "i", "a", "Σ", " ", *map(chr, range(0x300, 0x370))]), max_size=12))
def test_ids_with_combining_marks(text):
    tokenizer, _ = token_counts.load(WORD)
    assert packing.id_encoder(WORD)([text]) == [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=40), st.lists(st.integers(1, 24), max_size=10), st.booleans())
def test_a_sweep_fills_without_overlap(lengths, gaps, may_open):
    lengths = sorted(lengths, reverse=True)
    to, offset, left, opened = packing.sweep(np.array(lengths), np.array(gaps, np.int64), 24, may_open)
    assert may_open or not opened
    fill = [24 - g for g in gaps] + [0] * opened
    for n, s, at in zip(lengths, to.tolist(), offset.tolist(), strict=True):
        if s < 0:
            assert not may_open
            continue
        assert fill[s] == at
        fill[s] += n
    assert all(f <= 24 for f in fill) and [24 - f for f in fill] == left.tolist()
    if not may_open:  # what found no gap is larger than all that are left
        assert all(n > max(left.tolist(), default=0) for n, s in zip(lengths, to.tolist(), strict=True) if s < 0)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 40), min_size=1, max_size=12), st.dictionaries(st.integers(1, 24), st.integers(1, 40), max_size=12), st.integers(1, 30))
def test_ranges_take_every_piece_and_gaps_that_hold_them(pieces, gaps, most):
    home, shares, n = packing.ranges_of(pieces, gaps, most)
    assert home.keys() == pieces.keys() and all(0 <= f and f + w <= n for f, w in home.values())
    low = {f: min(x for x, (g, _) in home.items() if g == f) for f, _ in home.values()}
    for g, got in shares.items():
        assert sum(k for k, _, _ in got) <= gaps[g] and all(low[f] <= g for _, f, _ in got)


def best_fit_by_hand(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            g = min(fit)
            gaps[gaps.index(g)] = g - n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
def test_as_few_sequences_as_best_fit_decreasing(lengths):
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    assert packing.sweep(np.sort(np.repeat(list(counts), list(counts.values())))[::-1], np.zeros(0, np.int64), 20, True)[3] <= best_fit_by_hand(lengths, 20)


def test_packing_whole(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "it's", "12", "?!"]) for _ in range(rng.randint(0, 90)))) for i in range(120)] + ODD
    got = packing.pack(frame(spark, rows), WORD, capacity=32).collect()
    tokenizer, _ = token_counts.load(WORD)
    want = []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(d, p, a, len(c := ids[a : a + 32]), zlib.crc32(np.array(c, "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 32))]
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    assert packing.pack(frame(spark, []), WORD).count() == 0


# --- toxicity


@pytest.mark.parametrize(("text", "hit"), [("you IDIOT!", 1), ("you іdіоt", 1), ("1d10t", 1), ("you i​diot", 1), ("ｉｄｉｏｔ", 1), ("ídiot", 1), ("i̇diot", 1), ("i-d-i-o-t", 1), ("an i d i o t!", 1), ("a b c idiotic", 0), ("idiotic", 0), ("a trash can here", 0), ("trash", 1), ("", 0), ("10 of 34 cases", 0)])
def test_folding_and_exceptions(text, hit):
    a = toxicity.automaton({"terms": {" idiot ": 4.0, " trash ": 4.0}, "exceptions": [" trash can "]})
    assert (toxicity.matched(a, toxicity.fold(text)) > 0) == bool(hit)


def test_matching_is_what_a_plain_search_finds():
    rng = random.Random(4)
    terms = {" idio": 2.0, " idiot ": 3.0, " bad ": 1.0}
    a = toxicity.automaton({"terms": terms, "exceptions": [" bad luck "]})
    for _ in range(300):
        text = toxicity.fold(" ".join(rng.choice(["idiot", "idiotic", "bad", "luck", "x"]) for _ in range(rng.randint(0, 12))))
        total = 0.0
        for at in range(len(text)):
            if text[at] == " " and not text.startswith(" bad luck ", at):
                total += max([w for t, w in terms.items() if text.startswith(t, at)], default=0.0)
        assert toxicity.matched(a, text) == pytest.approx(total)


def test_learning_on_held_out_rows(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(400):
        words, bad = [word() for _ in range(30)], i % 4 == 0
        if bad:
            words[3] = words[9] = "grobble" + rng.choice(["", "d", "rs"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = frame(spark, [*rows, (900, None), (901, ""), (None, "grobble grobble")])
    lexicon = toxicity.learn(docs, spark.createDataFrame([*labels[:250], (None, 1), (399, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, lexicon).collect()}
    assert all(got[i].predicted == t for i, t in labels) and got[900].score == got[901].score < 0.7 and got[None].predicted == 1
    assert "key" in toxicity.score(docs, lexicon).columns
    nothing = toxicity.learn(frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(frame(spark, []), nothing).count() == 0 and toxicity.score(frame(spark, [(1, "you idiot")]), nothing).first().score > 0.5


def test_digest_of_an_empty_text(spark):
    from pyspark.sql import functions as F

    got = line_dedup.drop_common_lines(frame(spark, [(1, None)])).select(F.sha2(F.col("kept_text").cast("binary"), 256)).first()[0]
    assert got == hashlib.sha256(b"").hexdigest()
