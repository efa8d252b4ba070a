"""Registered corpus queries on a given table, held against plain versions with the queries' own conditions."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from panelspark.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def by_id(df):
    rows = df.collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def crc(n):
    return zlib.crc32(str(n).encode())


def test_op1(spark, docs):
    got = by_id(queries.op1_toxicity(spark, SF))
    assert set(got) == set(docs)
    assert all(r.held_out == (crc(d) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for d, r in got.items())


def test_op2(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, matrix = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    got = {}
    for r in queries.op2_nearest(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        scores = matrix @ matrix[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -scores)).tolist() if ids[i] != q][:20]
        assert [f[0] for f in found] == list(range(1, len(order) + 1))
        assert all(abs(scores[np.flatnonzero(ids == v)[0]] - s) < 1e-9 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(ids[order].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_op3(spark, docs):
    from collections import Counter

    got = by_id(queries.op3_recurrent_lm(spark, SF))
    tokens = {d: [*WORD.findall(t.translate(LOWER)), None] for d, t in docs.items()}
    counts = Counter(x for d, ts in tokens.items() if crc(d) % 10 for x in ts)
    n, v = sum(counts.values()), len(counts)
    for d, ts in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(d) % 10 == 0, len(ts), sum(x in counts for x in ts), n)
        assert abs(r.base_score - sum(np.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts)) < 1e-6
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_op4(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    for d, r in by_id(queries.op4_token_counts(spark, SF)).items():
        n = len(library.encode(docs[d], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[d].encode()), n, n > 512)


def test_op5(spark, docs):
    first: dict[bytes, int] = {}
    raw = {d: t.encode() for d, t in sorted(docs.items())}
    for d, b in raw.items():
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    got = by_id(queries.op5_substring_dedup(spark, SF))
    for d, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g)
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())


def test_op6(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    library.no_truncation(), library.no_padding()
    pieces, sequences = {}, {}
    for r in queries.op6_packing(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(docs)
    total = 0
    for d, parts in pieces.items():
        ids = np.array([*library.encode(docs[d], add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        parts.sort(key=lambda r: r.piece)
        cut = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in parts] == [(i, i * 2048, len(c), zlib.crc32(c.tobytes())) for i, c in enumerate(cut)]
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 1 + len(sequences) // 20


def test_op9(spark, docs):
    keys = {d: [line.strip(" \t\n\x0b\x0c\r").translate(LOWER) for line in t.split("\n")] for d, t in docs.items()}
    seen: dict[str, int] = {}
    for ks in keys.values():
        for k in set(ks):
            seen[k] = seen.get(k, 0) + 1
    for d, r in by_id(queries.op9_line_dedup(spark, SF)).items():
        lines = docs[d].split("\n")
        kept = [line for line, k in zip(lines, keys[d], strict=True) if not k or seen[k] < 10]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_op10(spark, docs):
    sets = {}
    for d, t in docs.items():
        w = WORD.findall(t.translate(LOWER))
        sets[d] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    home = {d: d for d in sets}

    def top(d):
        while home[d] != d:
            d = home[d]
        return d

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                home[y] = x
    for d, r in by_id(queries.op10_near_dedup(spark, SF)).items():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[d]), top(d), d == top(d))
