"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

1. Tasks send the normalised words of their texts with how often they stand, which an aggregate brings together.
2. The most frequent words, at most `lexicon_words`, are merged once and compiled into an acyclic transducer that reads a
   word's bytes and writes its ids. Words come sorted, so every state that no later word can change is looked up in a
   register and shared if an equal one is there: equal suffixes with equal ids are one path. Ids are written as early as
   the words that share a prefix allow.
3. The transducer is one flat file in the shared folder, of which each executor gets a copy; its workers map it into memory.
4. A task looks up the distinct words of each slice of texts together, one step of the transducer a byte; words that it
   lacks are merged exactly, pair by pair in the order of the merges' ranks.

Decoding joins the strings of the ids by one space, as a file without a decoder is decoded by its library.
"""

from __future__ import annotations

import heapq
import json
import mmap
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hand_out, keep, slices
from .words import text_splitter

# --- exact merging


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is visible Latin-1, else one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = {b: chr(b) for b in seen}, 256
    for b in range(256):
        if b not in out:
            out[b], more = chr(more), more + 1
    return [out[b] for b in range(256)]


@lru_cache(maxsize=2)
def merger(path: str):
    """A function from a word to its ids: of all neighbours that can merge those of the least rank do, the leftmost first."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, close = model["vocab"], model["end_of_word_suffix"] or ""
    first = [vocab[c] for c in byte_symbols()]
    last = [vocab[c + close] for c in byte_symbols()]
    ranks = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        ranks[vocab[a], vocab[b]] = rank, vocab[a + b]

    def merge(word: str) -> list[int]:
        raw = word.encode()
        n = len(raw)
        ids = [first[b] for b in raw[:-1]] + [last[raw[-1]]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def offer(i: int, j: int) -> None:
            found = ranks.get((ids[i], ids[j]))
            if found is not None:
                heapq.heappush(queue, (found[0], i, j, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, a, b, new = heapq.heappop(queue)
            if ids[i] != a or after[i] != j or ids[j] != b:
                continue  # one of them has merged with another neighbour
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [i for i in ids if i >= 0]

    return merge


# --- the transducer


def compile_words(entries: list[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """A minimal acyclic transducer of different non-empty words, in ascending order of their bytes, with their ids.

    The file: eight longs (states, arcs, outputs, ids, root, longest word), arcs by (state, byte) with target and output, the
    last output of each state (-1: no word ends there), where each output's ids begin, and the ids.
    """
    register: dict[tuple, int] = {}
    frozen: list[tuple] = []
    numbers: dict[tuple[int, ...], int] = {(): 0}

    def freeze(arcs: list[list], final) -> int:
        key = (final, tuple(map(tuple, arcs)))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    # the path of the word read last: arcs of each of its states as [byte, target, output], and what is written where a word ends
    arcs, finals, last = [[]], [None], b""

    def close(depth: int) -> None:
        """Freeze the states of the path that are deeper than so many bytes."""
        while len(arcs) > depth + 1:
            target = freeze(arcs.pop(), finals.pop())
            arcs[-1][-1][1] = target

    for word, ids in entries:
        shared = 0
        while shared < len(last) and shared < len(word) and last[shared] == word[shared]:
            shared += 1
        close(shared)
        for depth in range(shared):  # an arc keeps what both write, what only others write moves behind it
            arc = arcs[depth][-1]
            have = arc[2]
            same = 0
            while same < len(have) and same < len(ids) and have[same] == ids[same]:
                same += 1
            if same < len(have):
                rest = have[same:]
                arc[2] = have[:same]
                for later in arcs[depth + 1]:
                    later[2] = rest + later[2]
                if finals[depth + 1] is not None:
                    finals[depth + 1] = rest + finals[depth + 1]
            ids = ids[same:]
        for b in word[shared:]:
            arcs[-1].append([b, -1, ids])
            arcs.append([])
            finals.append(None)
            ids = ()
        finals[-1] = ids
        last = word
    close(0)
    root = freeze(arcs[0], finals[0])

    def number(output) -> int:
        return numbers.setdefault(output, len(numbers))

    keys, targets, outputs, ends = [], [], [], []
    for state, (final, of_state) in enumerate(frozen):
        ends.append(-1 if final is None else number(final))
        for b, target, output in of_state:
            keys.append(state << 8 | b), targets.append(target), outputs.append(number(output))
    pool = [i for output in numbers for i in output]
    begins = np.cumsum([0, *map(len, numbers)])
    head = [len(frozen), len(keys), len(numbers), len(pool), root, max((len(w) for w, _ in entries), default=0), 0, 0]
    parts = [(head, "<i8"), (keys, "<i8"), (begins, "<i8"), (targets, "<i4"), (outputs, "<i4"), (ends, "<i4"), (pool, "<u4")]
    return b"".join(np.asarray(values, kind).tobytes() for values, kind in parts)


class Transducer:
    """What compile_words wrote, read where it lies."""

    def __init__(self, content):
        states, arcs, outputs, ids, self.root, self.longest = np.frombuffer(content, "<i8", 8).tolist()[:6]
        at = 64
        for name, kind, n in (("keys", "<i8", arcs), ("begins", "<i8", outputs + 1), ("targets", "<i4", arcs), ("outputs", "<i4", arcs), ("ends", "<i4", states), ("pool", "<u4", ids)):
            setattr(self, name, np.frombuffer(content, kind, n, at))
            at += n * np.dtype(kind).itemsize

    def look_up(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word as little-endian unsigned 32-bit integers, or None."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        state = np.full(len(words), self.root, np.int64)
        alive = np.flatnonzero((size > 0) & (size <= self.longest))
        ended, owner, written = np.full(len(words), -1, np.int64), [], []
        for step in range(self.longest):
            if not len(alive) or not len(self.keys):
                break
            key = state[alive] << 8 | data[start[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            alive, arc = alive[hit], arc[hit]
            owner.append(alive), written.append(self.outputs[arc])
            state[alive] = self.targets[arc]
            stop = size[alive] == step + 1
            ended[alive[stop]] = self.ends[state[alive[stop]]]
            alive = alive[~stop]
        found = np.flatnonzero(ended >= 0)
        owner, written = np.concatenate([*owner, found]), np.concatenate([*written, ended[found]]).astype(np.int64)
        keep_it = (ended[owner] >= 0) & (self.begins[written + 1] > self.begins[written])
        owner, written = owner[keep_it], written[keep_it]
        order = np.argsort(owner, kind="stable")  # a word's outputs in the order of its bytes
        owner, written = owner[order], written[order]
        n = self.begins[written + 1] - self.begins[written]
        flat = self.pool[np.repeat(self.begins[written] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        upto = np.cumsum(np.bincount(owner, weights=n, minlength=len(words))).astype(np.int64) * 4
        raw, at, out = flat.tobytes(), [0, *upto.tolist()], []
        for i, ok in enumerate((ended >= 0).tolist()):
            out.append(raw[at[i] : at[i + 1]] if ok else None)
        return out


_MAPPED: dict[str, Transducer] = {}  # of this worker process, by file


def mapped(name: str) -> Transducer:
    from pyspark import SparkFiles

    if name not in _MAPPED:
        _MAPPED.clear()
        with open(SparkFiles.get(name), "rb") as f:
            _MAPPED[name] = Transducer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    return _MAPPED[name]


# --- the operators


def count_words(docs: DataFrame, tokenizer: str, text_col: str, table_rows: int) -> DataFrame:
    """word and n, how often it stands in all texts, one row each; special strings are no words."""

    def run(source):
        split, seen = text_splitter(tokenizer), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in source:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(split(text))
                if len(seen) > table_rows:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", lexicon_words: int = 131_072, word_bytes: int = 64, table_rows: int = 300_000) -> str:
    """Compile the most frequent words of all texts; returns the name under which executors have the file.

    Words of more than word_bytes bytes stay outside, as do those of the frequency class (sixteenths of a power of two) that
    would exceed lexicon_words and of all rarer ones: the file is bounded whatever the texts are.
    """
    counted = keep(count_words(docs, tokenizer, text_col, table_rows).where(F.octet_length("word") <= word_bytes))
    step = F.floor(F.log2("n") * 16).cast("int")
    cut, room = None, lexicon_words
    for b, c in sorted(map(tuple, counted.groupBy(step.alias("b")).count().collect()), reverse=True):
        room -= c
        if room < 0:
            break
        cut = b

    def price(source):
        merge = merger(tokenizer)
        for batch in source:
            ids = [np.asarray(merge(w), "<u4").tobytes() for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["word", "ids"])

    entries = []
    if cut is not None:
        head = counted.where(step >= cut).select("word").mapInArrow(price, "word string, ids binary").toArrow()
        entries = sorted((w.encode(), tuple(np.frombuffer(i, "<u4").tolist())) for w, i in zip(head["word"].to_pylist(), head["ids"].to_pylist(), strict=True))
    return hand_out(docs.sparkSession, compile_words(entries), "lexicon")


def special_ids(tokenizer: str) -> dict[str, bytes]:
    with open(tokenizer, encoding="utf-8") as f:
        return {x["content"]: np.uint32(x["id"]).tobytes() for x in json.load(f).get("added_tokens", [])}


def encode(docs: DataFrame, tokenizer: str, lexicon: str, id_col: str = "doc_id", text_col: str = "text", merged_rows: int = 200_000) -> DataFrame:
    """id, n_tokens and ids (little-endian unsigned 32-bit integers) of each whole text, without added special tokens.

    Special strings inside a text are their ids, as the library has them by default. Null and empty texts have no ids. One
    row out for each row in, repeated rows and null ids included; other columns are left out; an empty table gives no rows.
    A worker keeps the ids of at most merged_rows words that the lexicon lacks.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(source):
        split, merge, transducer, special = text_splitter(tokenizer), merger(tokenizer), mapped(lexicon), special_ids(tokenizer)
        merged: dict[str, bytes] = {}
        for batch in source:
            for part in slices(batch, 1):
                texts = [split(t or "") for t in part.column(1).to_pylist()]
                words = list(set().union(*texts))
                table = dict(zip(words, transducer.look_up([w.encode() for w in words]), strict=True)) | special
                for word, ids in table.items():
                    if ids is None:
                        if word not in merged:
                            if len(merged) >= merged_rows:
                                merged.clear()
                            merged[word] = np.asarray(merge(word), "<u4").tobytes()
                        table[word] = merged[word]
                ids = [b"".join(map(table.__getitem__, words)) for words in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "n_tokens", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The table with the text of each row's ids as one more column (null where ids are null); ids that the file lacks are passed over."""
    with open(tokenizer, encoding="utf-8") as f:
        if json.load(f)["decoder"] is not None:
            raise ValueError("only files without a decoder are decoded by joining their strings")
    schema = T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())])
    at = encoded.columns.index(ids_col)

    def run(source):
        with open(tokenizer, encoding="utf-8") as f:
            data = json.load(f)
        strings = {i: s for s, i in data["model"]["vocab"].items()} | {x["id"]: x["content"] for x in data.get("added_tokens", [])}
        for batch in source:
            for part in slices(batch, at):
                texts = []
                for raw in part.column(at).to_pylist():
                    ids = None if raw is None else np.frombuffer(raw, "<u4").tolist()
                    try:
                        texts.append(None if ids is None else " ".join(map(strings.__getitem__, ids)))
                    except KeyError:
                        texts.append(" ".join(strings[i] for i in ids if i in strings))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, text_col])

    return encoded.mapInArrow(run, schema)
