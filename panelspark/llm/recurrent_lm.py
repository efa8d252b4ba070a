"""LM scoring: a gated recurrent language model over words with a class-factored output.

P(token | state) = P(class | state) P(token | class, state). The most frequent words are dealt by frequency into classes
of equal size, each with its own softmax over its words. All other words stand in tail classes by their shape (script and
last character); inside those, a word's share comes from its discounted count in the training documents, and what the discount
frees is the share of all words that they lack, which are one token, as in the unigram model. The recurrent part is trained by truncated backpropagation in
numpy on every token of every training row, copies included: tasks train from common parameters on their own rows, and the
parameters are averaged by tokens after each of a few rounds, which share out the rows, in the same way at every size. Nothing of the corpus goes to the
driver. Scoring carries the state across windows from a document's first token to its last.

The vocabulary is never broadcast whole: its head is (a fixed number of words), and each document's other words meet their
counts in a join on the word.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, slices

END = ""  # no word is empty
SHAPES = 8
ROWS = 2048  # of logits at once


def shape_of(word: str) -> int:
    last = word[-1]
    return 4 * (not word.isascii()) + (1 if last == "." else 2 if last == "," else 0 if last.isalpha() else 3)


def shape_column(word):
    last = F.right(word, F.lit(1))
    return (F.when(F.octet_length(word) != F.char_length(word), 4).otherwise(0) + F.when(last == ".", 1).when(last == ",", 2).when(last.rlike(r"\p{L}"), 0).otherwise(3)).cast("int")


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    full = pc.binary_length(words).to_numpy() > 0  # white space at an end leaves an empty string there
    if not full.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full], minlength=len(sizes))
        words = words.filter(pa.array(full))
    return words, sizes


def shapes_of(words: pa.Array) -> np.ndarray:
    """shape_of each word; last characters are judged once each."""
    last = pc.utf8_slice_codeunits(words, -1).dictionary_encode()
    ends = np.array([shape_of(x) % 4 for x in last.dictionary.to_pylist()], np.int64)
    wide = pc.not_equal(pc.binary_length(words), pc.utf8_length(words)).to_numpy(zero_copy_only=False)
    return 4 * wide + (ends[last.indices.to_numpy()] if len(words) else 0)


# --- counts ---------------------------------------------------------------------------------------------------------


def count_words(docs: DataFrame) -> DataFrame:
    """word and n (its count in training rows; 0 for words of held-out rows alone) of all words of docs(text, training)."""

    def run(source):
        for batch in source:
            for piece in slices(batch, 0, rows=10_000, size=32_000_000):
                for training in (True, False):
                    words = split(piece.column(0).filter(pc.equal(piece.column(1), training)))[0]
                    met = words.value_counts()
                    n = met.field("counts")
                    yield pa.RecordBatch.from_arrays([met.field("values"), n if training else pa.array(np.zeros(len(n), np.int64))], names=["word", "n"])

    return docs.select("text", "training").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- the recurrent part ---------------------------------------------------------------------------------------------


def sigmoid_of_negative(x):
    """1 / (1 + exp(x)), in place; an exp that overflows gives 0, as it should."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def narrow(x: np.ndarray, most: int) -> np.ndarray:
    """Small numbers in 16 bits, which a stable sort goes through by digits."""
    return x.astype(np.int16) if most < 1 << 15 else x


def exps(s: np.ndarray, w: np.ndarray, b: np.ndarray, rows: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In place: exps of logits s = h w + b up to a factor a row, their sums, and the logit of each row less that factor's log.

    No state leaves [-1, 1], so weights bound the logits: as long as exp takes them as they are, no row's maximum is sought.
    w and b may be those of several softmaxes, of which each row takes one.
    """
    reach = np.abs(w).sum(-2)
    if not ((b + reach).max() < 80 and (b - reach).max() > -80):
        s -= s.max(1, keepdims=True)
    own = s[rows, of]
    e = np.exp(s, out=s)
    return e, e @ np.ones(e.shape[1], np.float32), own


def add_by_id(sums: np.ndarray, ids: np.ndarray, x: np.ndarray, few: int = 16) -> None:
    """sums[:, i] += x[:, j] for all j with ids[j] = i: frequent ids one by one, the others by their first row, their second, and so on."""
    order = np.argsort(narrow(ids, sums.shape[1]), kind="stable")
    x, ids = np.take(x, order, axis=1), ids[order]
    first = np.flatnonzero(np.diff(ids, prepend=-1) != 0)
    n = np.diff(first, append=len(ids))
    by_n = np.argsort(-n, kind="stable")
    first, n = first[by_n], n[by_n]
    many = int(np.searchsorted(-n, -few))
    own, one = np.take(x, first, axis=1), np.ones(n[0], x.dtype)
    for k in range(many):
        np.matmul(one[: n[k]], x[:, first[k] : first[k] + n[k]], out=own[:, k])
    for k in range(1, int(n[many]) if many < len(n) else 0):
        to = int(np.searchsorted(-n, -k))  # the first that has no such row
        own[:, many:to] += np.take(x, first[many:to] + k, axis=1)
    sums[:, ids[first]] += own


def adam(p, g, m, v, room, t: int, rate: float, scale: float, block: int = 16_384) -> None:
    """One step t of Adam on the flat parameters p with gradients g * scale, in blocks that stay in the cache.

    m and v are sums of g and g * g that fade, so that neither is scaled: the constants go into the step and its floor.
    """
    part = scale * math.sqrt(0.01 / (1 - 0.99**t))
    step, floor = np.float32(rate * 0.1 / (1 - 0.9**t) * scale / part), np.float32(1e-6 / part)
    for a in range(0, len(p), block):
        gb, mb, vb, rb = g[a : a + block], m[a : a + block], v[a : a + block], room[: min(block, len(p) - a)]
        mb *= np.float32(0.9)
        mb += gb
        vb *= np.float32(0.99)
        gb *= gb
        vb += gb
        np.sqrt(vb, out=rb)
        rb += floor
        np.divide(mb, rb, out=rb)
        rb *= step
        p[a : a + block] -= rb


class Net:
    """Inputs 0..words (0 is the end) and tail shapes after them; classes of `size` words, then one a shape."""

    def __init__(self, counts: np.ndarray, tail: np.ndarray, size: int, hidden: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.words, self.size, self.hidden = len(counts), size, hidden
        self.groups = -(-self.words // size)
        self.classes = self.groups + SHAPES
        full = np.zeros(self.groups * size)
        full[: self.words] = counts + 0.5
        full = full.reshape(self.groups, size)
        mass = np.concatenate([full.sum(1), tail + 0.5])
        with np.errstate(divide="ignore"):
            inner = np.where(full > 0, np.log(full / full.sum(1, keepdims=True)), -1e4)
        f = np.float32
        gates = lambda x: np.ascontiguousarray(x.reshape(len(x), -1, hidden).swapaxes(0, 1), f)
        self.p = {  # "u": what inputs add to the gates keep and reset and to the candidate; a gate's numbers lie together
            "u": gates(rng.standard_normal((self.words + SHAPES, 3 * hidden)) * 0.1), "rzr": gates(rng.standard_normal((hidden, 2 * hidden)) * 0.2), "rn": (rng.standard_normal((hidden, hidden)) * 0.2).astype(f),
            "c": np.zeros((hidden, self.classes), f), "cb": np.log(mass / mass.sum()).astype(f), "w": np.zeros((self.groups, hidden, size), f), "wb": inner.astype(f),
        }
        self.p["u"][0] += 1.0  # keep more than is replaced, at first

    @staticmethod
    def step(a: np.ndarray, old: np.ndarray, against: np.ndarray, rn: np.ndarray, kept: np.ndarray, out: np.ndarray, room: np.ndarray) -> None:
        """The state out after old. a: rows of "u" for the inputs, which become the gates; kept: the old state that reset lets through; against: -"rzr"."""
        zr, c = a[:2], a[2]
        np.matmul(old, against, out=room)
        np.subtract(room, zr, out=zr)
        sigmoid_of_negative(zr)
        np.multiply(zr[1], old, out=kept)
        np.matmul(kept, rn, out=room[0])
        c += room[0]
        np.tanh(c, out=c)
        np.subtract(old, c, out=out)
        out *= zr[0]
        out += c

    def class_of(self, y: np.ndarray) -> np.ndarray:
        return np.where(y < self.words, y // self.size, y - self.words + self.groups)

    def log_p(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None):
        """Natural log probabilities of targets y (words, or tail shapes as such) from states h; with grads also dh of their negative sum."""
        p, size, n = self.p, self.size, len(y)
        cls, rows, one = self.class_of(y), np.arange(n), np.ones(n, np.float32)
        out, dh = np.empty(n), None if grads is None else np.empty_like(h)
        # blocks of rows whose logits stay in the cache
        for a in range(0, n, ROWS):
            at = slice(a, min(a + ROWS, n))
            s = h[at] @ p["c"]
            s += p["cb"]
            r = rows[: len(s)]
            e, total, own = exps(s, p["c"], p["cb"], r, cls[at])
            np.subtract(own, np.log(total), out=out[at])
            if grads is not None:
                e *= np.reciprocal(total)[:, None]
                e[r, cls[at]] -= 1
                grads["c"] += h[at].T @ e
                grads["cb"] += one[: len(s)] @ e
                np.matmul(e, p["c"].T, out=dh[at])
        # targets that are words, by class: rows of one matrix, so that only products go class by class
        order = np.argsort(narrow(cls, self.classes), kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(self.groups + 1))
        order = order[: bounds[-1]]
        mine, inner, lp = np.take(h, order, axis=0), y[order] % size, np.empty(len(order))
        back, bounds, last = None if grads is None else np.empty_like(mine), bounds.tolist(), 0
        while last < self.groups:
            first, a = last, bounds[last]
            last += 1
            while last < self.groups and bounds[last + 1] - a <= ROWS:
                last += 1
            s = np.empty((bounds[last] - a, size), np.float32)
            held = [(k, slice(bounds[k], bounds[k + 1]), s[bounds[k] - a : bounds[k + 1] - a]) for k in range(first, last) if bounds[k] < bounds[k + 1]]
            for k, at, part in held:
                np.matmul(mine[at], p["w"][k], out=part)
                part += p["wb"][k]
            at, r = slice(a, bounds[last]), rows[: len(s)]
            e, total, own = exps(s, p["w"][first:last], p["wb"][first:last], r, inner[at])
            np.subtract(own, np.log(total), out=lp[at])
            if grads is not None:
                e *= np.reciprocal(total)[:, None]
                e[r, inner[at]] -= 1
                for k, at, part in held:
                    grads["w"][k] += mine[at].T @ part
                    grads["wb"][k] += one[: len(part)] @ part
                    np.matmul(part, p["w"][k].T, out=back[at])
        out[order] += lp
        if grads is not None:
            dh[order] += back
        return out if grads is None else (out, dh)

    @np.errstate(over="ignore")
    def train(self, docs: list[np.ndarray], tokens: int, lanes: int = 48, window: int = 20, rate: float = 0.004, seed: int = 2, span: tuple[float, float] = (0.0, 1.0)) -> None:
        """Truncated backpropagation with Adam over all docs, and again up to about `tokens` tokens (12 times at most).

        Lanes run through the documents end to end; the last ones are filled up with the first tokens. span is the part of
        the whole training that this is, by which the rate falls.
        """
        if not docs:
            return
        rng = np.random.default_rng(seed)
        have = sum(len(d) for d in docs)
        total = max(1, round(tokens / max(1, have))) if have < tokens else 1
        steps = max(1, total * have // (lanes * window))
        n = self.hidden
        value = np.concatenate([x.ravel() for x in self.p.values()])
        grad, m, v, room = (np.zeros(len(value), np.float32) for _ in range(4))
        at = np.cumsum([0, *(x.size for x in self.p.values())])
        views = lambda flat: {k: flat[a : a + x.size].reshape(x.shape) for a, (k, x) in zip(at, self.p.items(), strict=False)}
        g, t = views(grad), 0
        self.p = p = views(value)
        for _ in range(min(total, 12)):
            flat = np.concatenate([docs[i] for i in rng.permutation(len(docs))])
            used = min(lanes, len(flat))
            width = -(-len(flat) // used)
            grid = np.resize(flat, width * used).reshape(used, width).T
            h, before = np.zeros((used, n), np.float32), np.zeros(used, np.int64)
            gates, d, states, olds, kept = (np.empty((*k, window, used, n), np.float32) for k in ((3,), (3,), (), (), ()))
            pair, to, drh = np.empty((2, used, n), np.float32), np.empty((used, n), np.float32), np.empty((used, n), np.float32)
            for a in range(0, width, window):
                y = grid[a : a + window]
                x = np.concatenate([before[None], y[:-1]])
                before = y[-1]
                if len(y) < window:
                    gates, d, states, olds, kept = (np.empty((*k, len(y), used, n), np.float32) for k in ((3,), (3,), (), (), ()))
                np.take(p["u"], x, axis=1, out=gates, mode="clip")
                ended = [np.flatnonzero(row == 0) for row in x]  # the state starts anew after an end
                against, rn = -p["rzr"], p["rn"]
                for i in range(len(x)):
                    olds[i] = h
                    olds[i][ended[i]] = 0
                    h = states[i]
                    self.step(gates[:, i], olds[i], against, rn, kept[i], h, pair)
                grad.fill(0)
                _, dout = self.log_p(states.reshape(-1, n), y.ravel(), g)
                dout = dout.reshape(states.shape)
                carry = np.zeros_like(h)
                rn, rzr = rn.T, p["rzr"].swapaxes(1, 2)
                for i in range(len(x) - 1, -1, -1):
                    (z, r, c), (dz, dr, dc), dh = gates[:, i], d[:, i], dout[i]
                    dh += carry
                    # what a change of the new state, or of the kept old one, is to each gate
                    np.subtract(1, z, out=to)
                    to *= dh
                    np.subtract(olds[i], c, out=dz)
                    dz *= z
                    dz *= to
                    c *= c
                    np.subtract(1, c, out=c)
                    np.multiply(to, c, out=dc)
                    np.matmul(dc, rn, out=drh)
                    np.subtract(1, r, out=dr)
                    dr *= kept[i]
                    dr *= drh
                    np.matmul(d[:2, i], rzr, out=pair)
                    np.multiply(dh, z, out=carry)
                    drh *= r
                    carry += drh
                    carry += pair[0]
                    carry += pair[1]
                    carry[ended[i]] = 0
                # weights of the recurrence and inputs over all steps at once
                flat_d = d.reshape(3, -1, n)
                g["rn"] += kept.reshape(-1, n).T @ flat_d[2]
                g["rzr"] += olds.reshape(-1, n).T @ flat_d[:2]
                add_by_id(g["u"], x.ravel(), flat_d)
                t += 1
                lr = rate * min(1.0, t / 20) * max(0.05, 1 - span[0] - (span[1] - span[0]) * t / (steps + 1))
                adam(value, grad, m, v, room, t, lr, 1 / used)

    @np.errstate(over="ignore")
    def score(self, docs: list[np.ndarray], lanes: int = 256, window: int = 32) -> np.ndarray:
        """Natural log probability of each document: targets are its ids (words or tail shapes) and the end."""
        out = np.zeros(len(docs))
        if not docs:
            return out
        heap = [(0, i) for i in range(min(lanes, len(docs)))]
        held: list[list[int]] = [[] for _ in heap]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):  # longest first, to the lane that ends first
            n, i = heapq.heappop(heap)
            held[i].append(d)
            heapq.heappush(heap, (n + len(docs[d]), i))
        held.sort(key=lambda ds: -sum(len(docs[d]) for d in ds))
        size = np.array([sum(len(docs[d]) for d in ds) for ds in held])
        # lanes end to end: a step takes one token of each that still goes, so memory is the ids and one window, however long a lane
        order = np.array([d for ds in held for d in ds])
        flat = np.concatenate([docs[d] for d in order])
        ends = np.cumsum([len(docs[d]) for d in order])
        first = np.cumsum(size) - size
        n, longest = self.hidden, int(size[0])
        going = np.searchsorted(-size, -np.arange(longest)).tolist()  # lanes that reach a step: sizes fall
        h = np.zeros((len(held), n), np.float32)
        pair, kept = np.empty((2, len(held), n), np.float32), np.empty((len(held), n), np.float32)
        against, rn = -self.p["rzr"], self.p["rn"]
        for a in range(0, longest, window):
            ks = going[a : a + window]
            stops = np.cumsum(ks).tolist()
            at = np.concatenate([first[:k] + i for i, k in enumerate(ks, a)])
            x = flat[at - 1] if a else np.concatenate([np.zeros(ks[0], flat.dtype), flat[at[ks[0] :] - 1]])
            inputs, states = np.take(self.p["u"], x, axis=1), np.empty((len(at), n), np.float32)
            fresh = np.split(np.flatnonzero(x == 0), np.searchsorted(np.flatnonzero(x == 0), stops[:-1]))
            for k, stop, anew in zip(ks, stops, fresh, strict=True):
                here = slice(stop - k, stop)
                h = h[:k]
                if len(anew):
                    h = h.copy()
                    h[anew - (stop - k)] = 0
                self.step(inputs[:, here], h, against, rn, kept[:k], states[here], pair[:, :k])
                h = states[here]
            out += np.bincount(order[np.searchsorted(ends, at, side="right")], weights=self.log_p(states, flat[at]), minlength=len(docs))
        return out


# --- training over partitions ---------------------------------------------------------------------------------------

ROUND_OF = (0, 4, 2, 4, 3, 4, 3, 4, 1, 4, 2, 4, 3, 4, 3, 4)  # of every 16 rows of a task; models part little in the first rounds
ENDS = (0.0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0)
CHUNKS, FAN = 64, 64


def fit(net: Net, encoded: DataFrame, n: int, train_tokens: int, task_tokens: int = 2_000_000, buffer_tokens: int = 1_000_000) -> int:
    """Trains net on all rows of encoded(ids, round) and returns how many tokens that were, repetitions not counted.

    n tokens in all: about task_tokens of a round's a task. Every size goes through the same rounds; a buffer's rows are gone
    through train_tokens / n times in its round, and once from train_tokens on. Adam's moments start anew with each buffer,
    whose steps sweep its round's span of rates. Parameters are averaged in levels of FAN tasks, so no task takes more than
    FAN parts however many trained. A task holds buffer_tokens and a document of ids at once, the driver one set of parameters.
    """
    kinds = [(k, x.shape, x.size) for k, x in net.p.items()]
    again = max(1.0, train_tokens / max(1, n))
    trained = 0
    for k in range(len(ENDS) - 1):
        span = (ENDS[k], ENDS[k + 1])
        tasks = max(1, math.ceil(n * (span[1] - span[0]) / task_tokens))  # a round has its span's share of the rows; small parts would train in narrow lanes

        def run(source, net=net, span=span):
            from pyspark import TaskContext

            held, size, seen = [], 0, 0

            def learn():
                net.train(held, int(size * again), lanes=min(256, max(48, size // 4000)), span=span)

            for batch in source:
                for raw in batch.column(0).to_pylist():
                    held.append(np.frombuffer(raw, np.int32))
                    size += len(held[-1])
                    if size >= buffer_tokens:
                        learn()
                        seen, held, size = seen + size, [], 0
            if held:
                learn()
            seen += size
            if seen:
                flat = np.concatenate([x.ravel() for x in net.p.values()])
                parts = [x.tobytes() for x in np.array_split(flat, CHUNKS)]
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([task] * CHUNKS, pa.int32()), pa.array(range(CHUNKS), pa.int32()), pa.array([seen] * CHUNKS, pa.int64()), pa.array(parts, pa.binary())], names=["task", "chunk", "tokens", "part"])

        def mean(rows: pa.Table) -> pa.Table:
            w = rows["tokens"].to_numpy().astype(float)
            total = sum(a * np.frombuffer(x, np.float32) for a, x in zip(w / w.sum(), rows["part"].to_pylist(), strict=True))
            return pa.table([rows["task"][:1], rows["chunk"][:1], pa.array([int(w.sum())], pa.int64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["task", "chunk", "tokens", "part"])

        schema = "task int, chunk int, tokens long, part binary"
        parts, width = encoded.where(F.col("round") == k).select("ids").coalesce(tasks).mapInArrow(run, schema), tasks
        while True:
            parts, width = parts.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("chunk", "task").applyInArrow(mean, schema), -(-width // FAN)
            if width == 1:
                break
        got = sorted(parts.drop("task").collect())
        if got:
            trained += got[0]["tokens"]
            flat, at = np.frombuffer(b"".join(r["part"] for r in got), np.float32), 0
            for name, shape, size in kinds:
                net.p[name] = flat[at : at + size].reshape(shape).copy()
                at += size
    return trained


# --- the operator ---------------------------------------------------------------------------------------------------


def score_documents(docs: DataFrame, training, net_words: int = 2047, class_size: int = 64, hidden: int = 32, head_words: int = 131_072, train_tokens: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, training, n_tokens, n_known, train_tokens, base_score, score (both log10).

    training: a condition on docs that says which rows the model learns from. Tokens are words (lower-cased A-Z, split at
    ASCII white space) and one end a text; null texts are empty. n_known counts tokens that training rows hold, base_score
    is the unigram model with 0.1 added, score the model's. The recurrent part is trained on all training rows; where they
    hold less than train_tokens, each round's rows are gone through several times. head_words and net_words bound what is broadcast. Rows are scored one by one, repeated ones alike; with no training row every
    token is unknown. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    counts = keep(count_words(base))
    ends = base.where("training").count()
    shape = shape_column(F.col("word"))
    n_words, v_words = counts.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    n, v = (n_words or 0) + ends, (v_words or 0) + (ends > 0)
    floor = n + 0.1 * (v + 1)
    usable = (F.col("n") > 1) & (F.octet_length("word") <= 64)
    # the head: all words of the largest counts, by sixteenths of a power of two, while they are at most head_words; a top-k
    # by sorting would send as many rows from every task
    step = F.floor(F.log2("n") * 16).cast("int")
    cut, room = None, head_words
    for b, c in sorted(map(tuple, counts.where(usable).groupBy(step.alias("b")).count().collect()), reverse=True):
        room -= c
        if room < 0:
            break
        cut = b
    head = sorted(((r["word"], r["n"]) for r in counts.where(usable & (step >= cut)).collect()), key=lambda x: (-x[1], x[0])) if cut is not None else []
    inner = head[:net_words]
    # absolute discounting in each tail class, by how many of its words training rows hold once and twice
    mass, kinds, cut = np.zeros(SHAPES), np.zeros(SHAPES), np.full(SHAPES, 0.5)
    shapes = counts.where("n > 0").groupBy(shape.alias("s")).agg(F.sum("n"), F.count(F.lit(1)), F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1)))
    for s, total, types, once, twice in shapes.collect():
        mass[s], kinds[s], cut[s] = total, types, min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    for w, c in inner:
        mass[shape_of(w)] -= c
        kinds[shape_of(w)] -= 1
    unknown = np.where(mass > 0, cut * kinds, 1.0)

    def tail_scores(words: pa.Array, c: np.ndarray) -> np.ndarray:
        """log10 of each word's share of its tail class; all words that training rows lack are one, as in the unigram model."""
        s = shapes_of(words)
        return np.log10(np.where(c > 0, c - cut[s], unknown[s])) - np.log10(mass[s] + (mass[s] == 0))

    # the head's words with, in their order: id of input and target, log10 of the unigram and of the share of the tail class
    heads, head_n = pa.array([w for w, _ in head], pa.string()), np.array([c for _, c in head], float)
    head_ids, head_own = np.arange(1, len(head) + 1, dtype=np.int32), np.zeros(len(head))
    head_ids[len(inner) :] = len(inner) + 1 + shapes_of(heads[len(inner) :])
    head_own[len(inner) :] = tail_scores(heads[len(inner) :], head_n[len(inner) :])
    head_uni = np.log10((head_n + 0.1) / floor)
    end_base = math.log10(((ends if ends else 0) + 0.1) / floor)
    net = Net(np.array([ends, *(c for _, c in inner)], float), mass, class_size, hidden)

    def encode(texts: pa.Array):
        """ids of all texts on end with their ends, where each text's stop, and: places in the head of all words (-1: none), their texts, the words outside of the head."""
        words, sizes = split(texts)
        at = pc.fill_null(pc.index_in(words.cast(pa.string()), value_set=heads), -1).to_numpy()
        out = at < 0
        other = words.filter(pa.array(out))
        ids = np.empty(len(at), np.int32)
        ids[~out] = head_ids[at[~out]]
        ids[out] = len(inner) + 1 + shapes_of(other)
        row, stops = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes + 1)
        flat = np.zeros(len(ids) + len(sizes), np.int32)
        flat[np.arange(len(ids)) + row] = ids
        return flat, stops, at, row, other

    def code(source):
        seen = 0
        for batch in source:
            for piece in slices(batch, 0, rows=10_000, size=8_000_000):
                m = piece.num_rows
                rounds = np.take(np.array(ROUND_OF, np.int32), np.arange(seen, seen + m) % len(ROUND_OF))
                seen += m
                flat, stops, *_ = encode(piece.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.split(flat, stops[:-1])], pa.binary()), pa.array(rounds)], names=["ids", "round"])

    if ends:
        fit(net, keep(base.where("training").select("text").mapInArrow(code, "ids binary, round int")), n, train_tokens)

    def run(source):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        names = ["word", "row", "k", "id", "training", "n_tokens", "n_known", "base", "score"]
        for batch in source:
            for piece in slices(batch, 1, rows=4000, size=16_000_000):
                m = piece.num_rows
                flat, stops, at, of, other = encode(piece.column(1))
                model = net.score(np.split(flat, stops[:-1])) / math.log(10)
                ids, sizes = np.arange(row, row + m), np.diff(stops, prepend=0)
                row += m
                known = at >= 0
                total = lambda x, of=of[known], at=at[known], m=m: np.bincount(of, weights=x[at], minlength=m)
                n_known = np.bincount(of[known], minlength=m) + (ends > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f" {i}" for i in ids.tolist()]), pa.array(ids), pa.array(np.ones(m, np.int32)), piece.column(0), piece.column(2), pa.array(sizes), pa.array(n_known), pa.array(end_base + total(head_uni)), pa.array(model + total(head_own))],
                    names=names,
                )
                # other words, once a text with their count there
                words = other.dictionary_encode()
                met, k = np.unique(of[~known] * max(1, len(words.dictionary)) + words.indices.to_numpy(), return_counts=True)
                of, word = np.divmod(met, max(1, len(words.dictionary)))
                nothing = [pa.nulls(len(met), t) for t in (piece.column(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(word)), pa.array(ids[of]), pa.array(k.astype(np.int32)), *nothing], names=names)

    def price(source):
        for batch in source:
            c = batch.column(1).to_numpy().astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((c > 0).astype(np.int64)), pa.array(np.log10((c + 0.1) / floor)), pa.array(tail_scores(batch.column(0), c))], names=["word", "w_known", "w_base", "w_score"])

    scored = base.select("id", "text", "training").mapInArrow(run, f"word string, row long, k int, id {kind}, training boolean, n_tokens long, n_known long, base double, score double")
    prices = counts.mapInArrow(price, "word string, w_known long, w_base double, w_score double")
    met = scored.join(prices, "word", "left")
    each = lambda own, price: F.sum(F.coalesce(own, F.col("k") * price)).alias(own)
    out = met.groupBy("row").agg(
        F.first("id", ignorenulls=True).alias("id"), F.first("training", ignorenulls=True).alias("training"), F.sum("n_tokens").alias("n_tokens"),
        each("n_known", F.col("w_known")), each("base", F.col("w_base")), each("score", F.col("w_score")),
    )
    return out.select(F.col("id").alias(id_col), "training", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
