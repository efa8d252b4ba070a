"""The lexicon transducer and the alignment of tokenizers against the libraries, and their edge cases."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import alignment, lexicon, queries, token_counts, words
from panelspark.llm.queries import tokenizer_path

WORD = tokenizer_path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, " \n"), (4, "x" * 5000), (4, "x" * 5000), (None, "no id"), (5, "é" * 300 + "<|endoftext|>" + "İΣς 中文　٣²\x00 ᲊ"), (6, "<|startoftext|> it's we'll''s 12")]


def frame(spark, rows):
    """Rows of (id, text) with columns whose names operators use inside."""
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "doc_id long, text string, ids string, word string, n string")


def sha(raw) -> str:
    return hashlib.sha256(raw).hexdigest()


def by_library(text):
    ids = token_counts.load(WORD)[0].encode(text or "", add_special_tokens=False).ids
    return ids, token_counts.load(WORD)[0].decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=5), st.lists(st.integers(0, 3), max_size=3).map(tuple), max_size=40), st.lists(st.binary(max_size=6), max_size=10))
def test_the_transducer_holds_its_words_and_no_other(entries, more):
    got = lexicon.Transducer(lexicon.compile_words(sorted(entries.items())))
    asked = [*entries, *more]
    want = [np.asarray(entries[w], "<u4").tobytes() if w in entries else None for w in asked]
    assert got.look_up(asked) == want


def test_equal_suffixes_are_one_path():
    few = lexicon.Transducer(lexicon.compile_words([(b"aing", (1, 9)), (b"bing", (2, 9)), (b"cing", (3, 9))]))
    assert len(few.ends) == 5 and len(few.keys) == 6  # three first letters, then one path
    # ids go ahead as far as words share them: 7 is written on the first byte
    ahead = lexicon.Transducer(lexicon.compile_words([(b"ab", (7, 1)), (b"ac", (7, 2))]))
    assert ahead.look_up([b"ab", b"ac", b"a"]) == [np.array(x, "<u4").tobytes() for x in ((7, 1), (7, 2))] + [None]
    assert lexicon.Transducer(lexicon.compile_words([])).look_up([b"a", b""]) == [None, None]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abtheing'slre09é中²٣́😀ß_-!?")), min_size=1, max_size=40))
def test_merging_is_the_library_s(text):
    merge, split = lexicon.merger(WORD), words.text_splitter(WORD)
    assert [i for w in split(text) for i in merge(w)] == by_library(text)[0]


def test_marks_and_new_characters_are_read_as_the_library_does():
    rng, split, merge = random.Random(5), words.text_splitter(WORD), lexicon.merger(WORD)
    marks = [*map(chr, range(0x300, 0x370)), "᷷", "֤", "ᲊ", "Ᲊ", "ꟋA", "ꟋÅ", "ᄀ", "ᅡ", "ᆨ", "가", "া", "ে", "İ", "Σ", "a", "B", " ", "1"]
    for _ in range(3000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(1, 8)))
        assert [i for w in split(text) for i in merge(w)] == by_library(text)[0], text


def test_encoding_and_decoding_against_the_library(spark):
    rng = random.Random(2)
    pool = ["the", "The", "walking", "talking", "walked", "q" * 70, "naïve", "x1y22", "don't", "\n"]
    rows = ODD + [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for i in range(10, 60)]
    df = frame(spark, rows)
    want = sorted(str((d, len(ids), np.asarray(ids, "<u4").tobytes(), text)) for d, (ids, text) in ((d, by_library(t)) for d, t in rows))
    for most in (131_072, 4, 0):  # all words in the lexicon, some, none
        file = lexicon.build_lexicon(df, WORD, lexicon_words=most, table_rows=5)
        out = lexicon.decode(lexicon.encode(df, WORD, file, merged_rows=2), WORD).collect()
        assert sorted(str((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded)) for r in out) == want
    none = frame(spark, [])
    assert lexicon.decode(lexicon.encode(none, WORD, lexicon.build_lexicon(none, WORD)), WORD).count() == 0


def test_decoding_of_odd_ids(spark):
    df = spark.createDataFrame([(1, bytearray(np.array([320, 4_000_000, 49407], "<u4").tobytes())), (2, None), (3, bytearray())], "k long, ids binary")
    got = {r.k: r.decoded for r in lexicon.decode(df, WORD).collect()}
    library = token_counts.load(WORD)[0]
    assert got == {1: library.decode([320, 49407], skip_special_tokens=False), 2: None, 3: ""}


def test_op13_on_its_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op13_bpe_lexicon(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids, text = by_library(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha(text.encode()))


# --- alignment

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def tokens_by_hand(text):
    """Both token lists of a whole text with their bytes, or none."""
    tokenizer, bytes_a = alignment.load_bytes(A)
    pieces, bytes_b = alignment.load_pieces(B)
    if not text:
        return [], []
    a = [(i, bytes_a[i]) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes_b[i]) for i in pieces.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def align_by_hand(rows):
    links, groups, sizes = [], [], []
    for _, text in rows:
        a, b = map(spans, tokens_by_hand(text))
        links.append([(i, j) for i, s, e in a for j, t, f in b if s < f and t < e])
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups.append([([i for i, _, e in a if low < e <= high], [j for j, _, e in b if low < e <= high]) for low, high in zip([0, *cuts], cuts, strict=False)])
        sizes.append((len(a), len(b)))
    counts, most = {}, {}
    for pair in (p for each in links for p in each):
        counts[pair] = counts.get(pair, 0) + 1
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for (d, _), (n_a, n_b), each, parts in zip(rows, sizes, links, groups, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in parts)
        best = sum(counts[p] == most[p[1]] for p in each)
        out.append((d, n_a, n_b, len(parts), len(each), best, sum(counts[p] for p in each), sha(text.encode()) if text else ""))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z'slre09é中²ß;){}_-!? \n\r\t\x0b\x1c\x85\xa0\x00\x01\u3000\u200a😀<|endoftext|>▁")), max_size=40))
def test_segments_are_tokenised_as_whole_texts_are(text):
    a, b = tokens_by_hand(text)
    assert bool(a) == bool(alignment.readable(B)(text))
    if a:
        segments = alignment.segmenter(B)(text)
        assert "".join(segments) == " " + text
        got = list(alignment.aligner(A, B)(segments))
        assert [i for x in got for i in x[0]] == [i for i, _ in a] and [i for x in got for i in x[1]] == [i for i, _ in b]


def test_columns_of_alignments_against_brute_force():
    words = [" Walking", " naïve", "\tx1y22", " <|endoftext|>", "\n);\r\n", " 中文字", " ", "  ", " \U0001f600\U0001f600", " don't"]
    segments = [words[i % 10] + words[i // 10 % 10].strip() * (i % 7) for i in range(700)] + [" " + "ab中" * 3000]
    a, b, columns = alignment.column_aligner(A, B)(segments)
    got = list(zip(*(c.to_pylist() for c in columns), strict=True))
    at = bt = 0
    for n_a, n_b, n_groups, groups, pairs, times in got[:-1]:
        x, y = spans([(i, alignment.load_bytes(A)[1][i]) for i in a[at : at + n_a].tolist()]), spans([(j, alignment.load_pieces(B)[1][j]) for j in b[bt : bt + n_b].tolist()])
        at, bt = at + n_a, bt + n_b
        assert Counter(dict(zip(pairs, times, strict=True))) == Counter(i << 32 | j for i, s, e in x for j, t, f in y if s < f and t < e)
        cuts = sorted({e for _, _, e in x} & {e for _, _, e in y})
        text = ";".join(",".join(str(i) for i, _, e in x if low < e <= high) + "|" + ",".join(str(j) for j, _, e in y if low < e <= high) for low, high in zip([0, *cuts], cuts, strict=False))
        assert (n_groups, groups) == (len(cuts), text)


def test_aligning_costs_less_than_tokenising():
    rng = random.Random(5)
    segments = [" " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz,.", k=rng.randint(4, 14))) for _ in range(4000)]
    run, tokenizer, pieces = alignment.column_aligner(A, B), alignment.load_bytes(A)[0], alignment.load_pieces(B)[0]

    def least(f):
        took = []
        for _ in range(3):
            t = time.process_time()
            f()
            took.append(time.process_time() - t)
        return min(took)

    both = least(lambda: ([e.ids for e in tokenizer.encode_batch_fast(segments, add_special_tokens=False)], pieces.encode(segments, num_threads=1)))
    assert least(lambda: run(segments)) < 2 * both


def test_no_break_before_what_pieces_reach_over():
    assert "\r" not in alignment.breaks(B) and {" ", "\n"} <= set(alignment.breaks(B))


def test_alignment_against_brute_force(spark):
    rng = random.Random(4)
    pool = ["Walking", "talking", "naïve", "x1y22", "don't", "\n", ");\r\n", "<|endoftext|>", "<s>", "中文字", "  ", "z" * 90]
    rows = ODD + [(70, "a▁b"), (71, " "), (72, "ends "), (73, "<0x41>")]
    rows += [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))) for i in range(10, 60)]
    df = frame(spark, rows)
    want = sorted(map(str, align_by_hand(rows)))
    assert sum("0, 0, 0, 0, 0, 0" in x for x in want) >= 3
    for head, pairs, counted in ((262_144, 1_000_000, 300_000), (3, 0, 2), (0, 5, 10)):  # all shipped; most joined; all joined
        got = alignment.align(df, A, B, head_rows=head, pair_rows=pairs, table_rows=counted).collect()
        assert sorted(str(tuple(r)) for r in got) == want
    assert alignment.align(frame(spark, []), A, B).count() == 0


def test_op12_on_its_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    short = [(d, t) for d, t in rows if len(t) < 3000]  # the plain version compares all tokens with all
    got = {r.doc_id: tuple(r) for r in queries.op12_alignment(spark, sf).collect()}
    assert len(got) == len(rows)
    for d, n_a, n_b, n_groups, n_links, *_, digest in align_by_hand(short):
        assert got[d][:5] == (d, n_a, n_b, n_groups, n_links) and got[d][-1] == digest
