"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text and normalised by length.

Folding lower-cases, maps look-alike letters of other scripts and digits or signs that stand for letters to ASCII, drops
invisible characters and turns punctuation into spaces. Patterns are whole words (' idiot ') and word beginnings (' idio'),
which catch inflected forms; marks on letters go, and words spelt out letter by letter (i-d-i-o-t) are joined. Exception phrases (' trash can ') take back the weight of the match inside them. Weights are
log odds learned from labelled rows; the score is logistic in the matched weight as such and per word of text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, slices

# Look-alikes of Latin letters (Cyrillic, Greek and others), in the order of the letters they stand for.
LOOK_ALIKES = {
    "a": "аαɑ＠@4", "b": "ьвβ", "c": "сϲ", "d": "ԁ", "e": "еεєҽ3", "g": "ɡ", "h": "һ", "i": "іıι1!|", "j": "јϳ", "k": "кκ", "l": "ӏ", "m": "м",
    "n": "ո", "o": "оοσօ0", "p": "рρ", "q": "ԛ", "s": "ѕ5$", "t": "тτ7", "u": "υս", "v": "ѵν", "w": "ԝѡ", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
# General insults that a lexicon starts from when labels say nothing about them.
SEED_TERMS = ("idiot", "moron", "stupid", "dumb", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown", "imbecile", "filth", "vermin", "subhuman", "freak", "retard", "bastard", "coward", "creep")
# Phrases in which a seed term carries no insult.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "dumb bell", "creep rate", "stupid question")

_INVISIBLE = "­​‌‍⁠﻿"
_SOFT = set("@4310!|5$7")  # also punctuation or plain digits: letters only inside a word


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {ord(x): None for x in _INVISIBLE}
    for c in range(33, 128):
        if not chr(c).isalnum():
            out[c] = " "
    for c in (9, 10, 11, 12, 13, *range(0x2010, 0x2028), 0xA0, 0xAB, 0xBB, 0xBF, 0xA1):
        out[c] = " "
    for letter, others in LOOK_ALIKES.items():
        out.update((ord(x), letter) for x in others if x not in _SOFT)
    return out


_FOLD = _table()
_LETTER_FOR = {x: letter for letter, others in LOOK_ALIKES.items() for x in others if x in _SOFT}


SOFT = re.compile(r"[@4310!|5$7]")
#: Such signs between letters, or at a word's beginning or end next to one.
INSIDE = re.compile(r"(?<=[^\W\d_])[@4310!|5$7]+(?=[^\W\d_])|(?<!\S)[@4310|5$7]+(?=[^\W\d_])|(?<=[^\W\d_])[@4310$57]+(?!\S)")


MARKS = re.compile("[\u0300-\u036f]+")
#: Three or more single letters in a row: a word that is spelt out.
SPELT = re.compile(r"(?<= )(?:[^\W\d_] ){2,}[^\W\d_](?= )")


def fold(text: str) -> str:
    """The text as the lexicon sees it: words with one space between them and one at both ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():  # letters without their marks
        text = MARKS.sub("", unicodedata.normalize("NFD", text))
    if SOFT.search(text):
        text = INSIDE.sub(lambda m: "".join(_LETTER_FOR[x] for x in m[0]), text)
    text = " " + " ".join(text.translate(_FOLD).split()) + " "
    return SPELT.sub(lambda m: m[0].replace(" ", ""), text)


def features(folded: str, prefixes: tuple[int, ...]) -> set[str]:
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) >= 3}
    for n in prefixes:
        out |= {f" {w[:n]}" for w in words if len(w) > n}
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, prefixes: tuple[int, ...] = (4, 5, 6), seed_weight: float = 4.0) -> dict:
    """A lexicon and the weights of the score, fitted on at most about max_rows labelled rows (documented bound of the fit).

    Rows with a null id or label are left out. Where there are more labels than the bound, a hash of the id picks an even
    share; that share is what is broadcast to meet the documents. With no rows, or rows of one label only, the seed lexicon
    stands with its own weights.
    """
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label"))
    n = named.count()
    if n > max_rows:
        named = named.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < int(max_rows / n * 1_000_000))
    rows = keep(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(named), "id").select("text", "label"))
    sums = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    clean, toxic = sums.get(0, 0), sums.get(1, 0)
    if not clean or not toxic:
        return {"terms": {f" {s} ": seed_weight for s in SEED_TERMS}, "exceptions": [f" {x} " for x in EXCEPTIONS], "weights": [-3.0, 1.0, 1.0, 0.0]}

    def count(wanted: set[str] | None):
        def run(source):
            for batch in source:
                seen: Counter = Counter()
                for text in batch.column(0).to_pylist():
                    got = features(fold(text), prefixes)
                    seen.update(got if wanted is None else got & wanted)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

        return run

    def counted(label: int, wanted: set[str] | None) -> DataFrame:
        return rows.where(F.col("label") == label).select("text").mapInArrow(count(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    # terms of toxic rows that chance alone would hardly put there so often, then how many clean rows have those
    base = toxic / (clean + toxic)
    floor = max(3, math.ceil(math.log(1e-7) / math.log(base)))
    seeds = {f" {s} " for s in SEED_TERMS}
    bad = {r["term"]: r["n"] for r in counted(1, None).where((F.col("n") >= min(floor, toxic)) | F.col("term").isin(list(seeds))).collect()}
    good = {r["term"]: r["n"] for r in counted(0, bad.keys() | seeds).collect()}
    terms: dict[str, float] = {}
    for t, k in bad.items():
        odds = math.log((k + 0.5) / (toxic + 1)) - math.log((good.get(t, 0) + 0.5) / (clean + 1))
        # a term counts by a bound of its log odds, so that few rows can't carry it
        sure = odds - 1.64 * math.sqrt(1 / (k + 0.5) + 1 / (good.get(t, 0) + 0.5))
        if odds > 2.0 and (t in seeds or sure > 1.0):
            terms[t] = max(odds, seed_weight / 2) if t in seeds else odds
    starts = sorted((t for t in terms if not t.endswith(" ")), key=len)
    for t in starts:  # a beginning with clean hits gives way to a longer one that keeps its toxic ones
        if good.get(t, 0) and any(u.startswith(t) and u != t and bad[u] >= 0.9 * bad[t] and good.get(u, 0) < good[t] for u in starts):
            del terms[t]
    for t in [t for t in terms if not t.endswith(" ")]:  # a longer beginning adds nothing to a shorter one
        if any(t[:k] in terms for k in range(2, len(t))):
            del terms[t]
    terms |= {s: seed_weight for s in seeds - bad.keys() - good.keys()}
    lexicon = {"terms": terms, "exceptions": [f" {x} " for x in EXCEPTIONS], "weights": []}
    return lexicon | {"weights": _fit(rows, lexicon)}


def automaton(lexicon: dict):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, weight in lexicon["terms"].items():
        a.add_word(term, (len(term), weight, False))
    for phrase in lexicon["exceptions"]:
        a.add_word(phrase, (len(phrase), 0.0, True))
    a.make_automaton()
    return a


def matched(a, folded: str) -> float:
    """Summed weight of a text: the best match at each word, none inside an exception phrase."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, weight, exception) in a.iter(folded):
        start = end - n + 1
        if exception:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    return sum(w for s, w in best.items() if not any(x <= s < y for x, y in spared)) if best else 0.0


def measures(a, text: str) -> tuple[float, float, float]:
    """log weight, weight per word on a square-root scale (long texts dilute, slowly), log words."""
    folded = fold(text)
    words = folded.count(" ")
    total = matched(a, folded)
    return math.log1p(total), total / math.sqrt(words + 1), math.log1p(words) if total else 0.0


def _fit(rows: DataFrame, lexicon: dict) -> list[float]:
    """Logistic weights of the three measures by Newton's method with a small ridge; at most max_rows short rows come here."""

    def run(source):
        a = automaton(lexicon)
        for batch in source:
            m = np.array([measures(a, t) for t in batch.column(0).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(m[:, k]) for k in range(3)), batch.column(1)], names=["a", "b", "c", "label"])

    got = rows.mapInArrow(run, "a double, b double, c double, label int").toPandas().sort_values(["a", "b", "c", "label"]).to_numpy(float)
    x, y = np.c_[np.ones(len(got)), got[:, :3]], (got[:, 3] > 0).astype(float)
    w, ridge = np.zeros(4), np.diag([0.01, 0.1, 0.1, 0.1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def score_text(a, weights: list[float], text: str) -> float:
    m = measures(a, text)
    z = weights[0] + sum(w * v for w, v in zip(weights[1:], m, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, lexicon: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold) added; these two names are replaced, others pass.

    Null texts are empty; an empty text gets the score of a text without matches. Rows are scored one by one, so repeated
    rows get equal scores, and an empty table gives an empty table.
    """
    base = docs.drop("score", "predicted")

    def run(source):
        a = automaton(lexicon)
        at = base_names.index(text_col)
        for batch in source:
            for part in slices(batch, at):
                s = [score_text(a, lexicon["weights"], t or "") for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=[*base_names, "score", "predicted"])

    base_names = base.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{schema}, score double, predicted int")


def drop_toxic(docs: DataFrame, lexicon: dict, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows that score less than threshold, with all their columns whatever their names."""
    at = docs.columns.index(text_col)

    def run(source):
        a = automaton(lexicon)
        for batch in source:
            for part in slices(batch, at):
                yield part.filter(pa.array([score_text(a, lexicon["weights"], t or "") < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
