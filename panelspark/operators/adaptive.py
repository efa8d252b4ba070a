"""Adaptive trials: pools, posteriors, information, replay, sequences and tie-aware ideal points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import coin, fixed, unordered_id
from ..functions.numeric import choice_probabilities, r6, share

GRID = 101  # points of the posterior: -5, -4.9, ..., 5
MU, WIDTH = 201, 31  # points of the search: -5, -4.95, ..., 5 and 0, 0.05, ..., 1.5


def grid_point(i: Column) -> Column:
    return i / 10.0 - 5.0


def candidate_values(recommended: Column, radius: float, step: float) -> Column:
    """0, +-radius, all +-k * step below it, and the recommendation if within 5; distinct and sorted."""
    base, k, value = {0.0, radius, -radius}, 1, step
    while value < radius - step / 1000:
        base |= {round(value, 6), -round(value, 6)}
        k += 1
        value = k * step
    own = F.when(recommended.isNotNull() & ~F.isnan(recommended) & (F.abs(recommended) <= 5), F.array(F.round(recommended, 6) + 0.0)).otherwise(F.array().cast("array<double>"))
    return F.array_sort(F.array_distinct(F.concat(F.array(*[F.lit(round(v, 6)) for v in sorted(base)]), own)))


def adjacent_trials(candidates: DataFrame, keys: list[str], value: str = "value", seed: str = "panel") -> DataFrame:
    """Each candidate with the next larger one of its study and axis."""
    w = Window.partitionBy(*keys).orderBy(value)
    rows = candidates.withColumn("upper", F.lead(value).over(w)).where("upper IS NOT NULL").withColumnRenamed(value, "lower")
    ident = unordered_id("fixed", F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), fixed(F.col("lower"), 6), fixed(F.col("upper"), 6))
    return rows.select(*keys, "lower", "upper", ident.alias("trial_id")).withColumn("flipped", coin(seed, F.col("trial_id")))


def trial_pool(candidates: DataFrame, axis: str = "axis", value: str = "value", sizes=(16, 24), themes=("light", "dark"), seed: str = "panel") -> DataFrame:
    """All pairs of an axis's candidates (25 at most by contract) under each condition, shown one way or the other."""
    low = candidates.select(F.col(axis).alias("axis"), F.col(value).alias("low"))
    high = candidates.select(F.col(axis).alias("axis"), F.col(value).alias("high"))
    pairs = low.join(high, "axis").where("low < high")
    rows = pairs.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("theme", F.explode(F.array(*map(F.lit, themes))))
    ident = unordered_id("adaptive", F.concat_ws(":", "axis", F.col("size").cast("string"), "theme"), fixed(F.col("low")), fixed(F.col("high")))
    flip = coin(seed, F.col("trial_id"))
    return rows.withColumn("trial_id", ident).select("trial_id", "axis", "size", "theme", F.when(flip, F.col("high")).otherwise(F.col("low")).alias("a"), F.when(flip, F.col("low")).otherwise(F.col("high")).alias("b"), F.sha2(F.concat(F.lit(f"{seed}:acquisition:"), "trial_id"), 256).alias("tie_break"), F.sha2(F.concat(F.lit(f"repeat:{seed}:"), "trial_id"), 256).alias("repeat_id"))


def likelihood(choice: Column, mu: Column, a: Column, b: Column, tie=0.2, temperature: float = 0.35) -> Column:
    p_a, p_b, p_t = choice_probabilities(mu, a, b, tie, temperature)
    return F.when(choice == "A", p_a).when(choice == "B", p_b).when(choice == "TIE", p_t)


def choice_counts(votes: DataFrame, keys: list[str]) -> DataFrame:
    """What a likelihood needs of any number of votes: counts by keys, values and choice, abstentions left out."""
    return votes.where("choice <> 'ABSTAIN'").groupBy(*keys, "a", "b", "choice").agg(F.count(F.lit(1)).alias("n"))


def posterior(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, mu, p: the posterior over the grid from a flat start."""
    on = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))).withColumn("mu", grid_point(F.col("i")))
    logs = on.groupBy(*keys, "i", "mu").agg(F.sum(F.col("n") * F.log(likelihood(F.col("choice"), F.col("mu"), F.col("a"), F.col("b")))).alias("l"))
    return _normalised(logs, keys)


def _normalised(logs: DataFrame, keys: list[str]) -> DataFrame:
    top = logs.groupBy(*keys).agg(F.max("l").alias("m"))
    e = logs.join(top, keys).withColumn("e", F.exp(F.col("l") - F.col("m")))
    total = e.groupBy(*keys).agg(F.sum("e").alias("t"))
    return e.join(total, keys).select(*keys, "i", "mu", (F.col("e") / F.col("t")).alias("p"))


def running_posterior(votes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """After each answer of a sequence: step, posterior mean and entropy.

    A sequence is one rater's on one axis, short by contract: it is gathered by one shuffle, and Arrow batches of gathered
    sequences are folded over the grid.
    """
    code = F.when(F.col("choice") == "A", 0).when(F.col("choice") == "B", 1).otherwise(2)
    gathered = votes.where("choice <> 'ABSTAIN'").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "a", "b", code.alias("c")))).alias("s"))
    flat = gathered.select(*keys, F.transform("s", lambda v: v["a"]).alias("_a"), F.transform("s", lambda v: v["b"]).alias("_b"), F.transform("s", lambda v: v["c"]).alias("_c"))
    n_keys = len(keys)
    mu = -5 + np.arange(GRID) / 10

    def run(source):
        for batch in source:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                a, b, c = (part.column(n_keys + i).flatten().to_numpy() for i in range(3))
                size = np.diff(part.column(n_keys).offsets.to_numpy())
                values, which = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
                step_log = np.log(_log_choice(values[0], values[1]))[which.ravel(), c]  # one row of the grid an answer
                total = np.concatenate([np.cumsum(x, axis=0) for x in np.split(step_log, np.cumsum(size)[:-1])]) if len(size) else step_log
                e = np.exp(total - total.max(1, keepdims=True))
                p = e / e.sum(1, keepdims=True)
                entropy = -(p * np.log(np.where(p > 0, p, 1.0))).sum(1)
                step = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size) + 1
                take = pa.array(np.repeat(np.arange(part.num_rows), size))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(take) for i in range(n_keys)), pa.array(step.astype(np.int32)), pa.array(p @ mu), pa.array(entropy)], names=[*keys, "step", "mean", "entropy"])

    schema = ", ".join(f"`{k}` {flat.schema[k].dataType.simpleString()}" for k in keys)
    return flat.mapInArrow(run, f"{schema}, step int, mean double, entropy double")


def information(pool: DataFrame, post: DataFrame, seen: DataFrame) -> DataFrame:
    """Pool trials with their expected gain of information less penalties for repeated conditions and far midpoints.

    post: axis, mu, p; seen: size, theme, n. Both are a few rows; the pool is bounded by the study.
    """
    on = pool.join(post, "axis")
    p_a, p_b, p_t = choice_probabilities(F.col("mu"), F.col("a"), F.col("b"))
    term = lambda q: F.when(q > 0, q * F.log(F.when(q > 0, q))).otherwise(0.0)
    agg = on.groupBy(*pool.columns).agg(
        F.sum(F.col("p") * p_a).alias("pa"), F.sum(F.col("p") * p_b).alias("pb"), F.sum(F.col("p") * p_t).alias("pt"),
        F.sum(F.col("p") * -(term(p_a) + term(p_b) + term(p_t))).alias("inner"), F.sum(F.col("p") * F.col("mu")).alias("mean"),
    ).join(seen, ["size", "theme"], "left")
    outer = -(term(F.col("pa")) + term(F.col("pb")) + term(F.col("pt")))
    score = outer - F.col("inner") - F.coalesce("n", F.lit(0)) * 0.003 - F.abs((F.col("a") + F.col("b")) / 2 - F.col("mean")) * 0.02
    return agg.select(*pool.columns, score.alias("score"))


def next_trial(scored: DataFrame, keys: list[str], k: int = 1) -> DataFrame:
    """The k best by score, ties by the seeded hash."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "tie_break")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_losses(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Loss over the grid of ideals and widths, from counts of distinct (values, choice): n votes cost no more than few."""
    on = counts.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(MU - 1)))).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))))
    mu, width = F.col("m") * 0.05 - 5.0, F.col("w") * 0.05
    p = likelihood(F.col("choice"), mu, F.col("a"), F.col("b"), width, 0.25)
    return on.groupBy(*keys, "m", "w").agg(F.sum(-F.col("n") * F.log(F.greatest(F.lit(1e-12), p))).alias("loss"))


def ideal_point(losses: DataFrame, keys: list[str]) -> DataFrame:
    """The least loss (to 8 digits), then the ideal nearest to 0, then the smaller width."""
    best = losses.groupBy(*keys).agg(F.min(F.struct(F.round("loss", 8).alias("loss"), F.abs(F.col("m") - 100).alias("near"), "m", "w")).alias("s"))
    return best.select(*keys, r6(F.col("s.m") * 0.05 - 5.0, 4).alias("ideal_percent"), r6(F.col("s.w") * 0.05, 4).alias("indifference_percent"), F.col("s.loss").alias("loss"))


def ideal_interval(losses: DataFrame, keys: list[str]) -> DataFrame:
    """Where the running weight of ideals first reaches 2.5 % and 97.5 %."""
    logs = losses.select(*keys, F.col("m"), (-F.col("loss")).alias("l"))
    top = logs.groupBy(*keys).agg(F.max("l").alias("t"))
    by = logs.join(top, keys).groupBy(*keys, "m").agg(F.sum(F.exp(F.col("l") - F.col("t"))).alias("e"))
    run = by.withColumn("c", F.sum("e").over(Window.partitionBy(*keys).orderBy("m"))).withColumn("all", F.sum("e").over(Window.partitionBy(*keys)))
    at = lambda q: r6(F.min(F.when(F.col("c") >= q * F.col("all"), F.col("m"))) * 0.05 - 5.0, 4)
    return run.groupBy(*keys).agg(at(0.025).alias("low"), at(0.975).alias("high"))


def sequence_check(rows: DataFrame, rater: str, index: str, first_from: str | None = None, last_from: str | None = None, least: int = 5) -> DataFrame:
    """Per rater: length, whether indices run from 0 without gaps or repeats, whether long enough, and whether the last repeats the first."""
    agg = rows.groupBy(rater).agg(F.count(F.lit(1)).alias("length"), F.min(index).alias("_lo"), F.max(index).alias("_hi"), F.countDistinct(index).alias("_d"), *([F.min_by(first_from, index).alias("_f"), F.max_by(last_from, index).alias("_l")] if first_from else []))
    whole = (F.col("_lo") == 0) & (F.col("_hi") == F.col("length") - 1) & (F.col("_d") == F.col("length"))
    return agg.select(rater, "length", whole.alias("contiguous"), (F.col("length") >= least).alias("long_enough"), *([F.col("_l").eqNullSafe(F.col("_f")).alias("closed")] if first_from else []))


def repeat_reliability(rows: DataFrame, keys: list[str], order: list[str], answer: str) -> DataFrame:
    """Of raters' second looks at the same trial, how many agree with the first: repeats, consistent, rate."""
    w = Window.partitionBy(*keys).orderBy(*order)
    looks = rows.withColumn("_r", F.row_number().over(w)).withColumn("_first", F.first(answer).over(w)).where("_r > 1")
    agg = looks.agg(F.count(F.lit(1)).alias("repeats"), F.count(F.when(F.col(answer) == F.col("_first"), 1)).alias("consistent"))
    return agg.select("repeats", "consistent", r6(share(F.col("consistent"), F.col("repeats"))).alias("rate"))


# --- one step of the live loop, for batches and streams alike ---------------------------------------------------------


def _log_choice(a: np.ndarray, b: np.ndarray, tie: float = 0.2, temperature: float = 0.35) -> np.ndarray:
    mu = -5 + np.arange(GRID) / 10
    gain = np.abs(mu[None, :] - b[:, None]) - np.abs(mu[None, :] - a[:, None])
    p_a = 1 / (1 + np.exp(-(gain - tie) / temperature))
    p_b = 1 / (1 + np.exp(-(-gain - tie) / temperature))
    return np.stack([p_a, p_b, np.maximum(1e-12, 1 - p_a - p_b)], 1)


class Loop:
    """A rater's study: which trial comes next, and what an answer does to the state.

    State is plain data (answers so far), so that a stream can keep it; posterior and counts follow from it step by step.
    """

    CHOICE = {"A": 0, "B": 1, "TIE": 2}

    def __init__(self, pool: list[dict], most: int = 16):
        self.pool = sorted(pool, key=lambda t: t["trial_id"])
        self.most = most
        self.p = _log_choice(np.array([t["a"] for t in self.pool], float), np.array([t["b"] for t in self.pool], float)) if pool else np.zeros((0, 3, GRID))
        self.inner = -(self.p * np.log(self.p)).sum(1)
        self.at = {t["trial_id"]: i for i, t in enumerate(self.pool)}
        self.history: list[tuple[int, str]] = []
        self.post = {"x": np.full(GRID, 1 / GRID), "y": np.full(GRID, 1 / GRID)}
        self.seen: dict[tuple, int] = {}

    def resume(self, history: list[tuple[int, str]], post: dict[str, np.ndarray] | None = None) -> None:
        """Go on from kept answers and the posterior that they led to (flat where none is kept); nothing is replayed."""
        self.history = list(history)
        self.post = post or {"x": np.full(GRID, 1 / GRID), "y": np.full(GRID, 1 / GRID)}
        self.seen = {}
        for place, _ in self.history:
            condition = self.pool[place]["size"], self.pool[place]["theme"]
            self.seen[condition] = self.seen.get(condition, 0) + 1

    def next(self) -> tuple[int, bool] | None:
        """Place of the next trial in the pool and whether it is the closing repeat; None when the study is over."""
        if len(self.history) >= self.most or not self.pool:
            return None
        if len(self.history) == self.most - 1:
            return self.history[0][0], True
        mu = -5 + np.arange(GRID) / 10
        used = {i for i, _ in self.history}
        best = None
        score = np.full(len(self.pool), -np.inf)
        for axis in ("x", "y"):
            rows = np.array([i for i, t in enumerate(self.pool) if t["axis"] == axis and i not in used], int)
            if not len(rows):
                continue
            w = self.post[axis]
            predictive = self.p[rows] @ w
            gain = -(predictive * np.log(predictive)).sum(1) - self.inner[rows] @ w
            middle = np.array([(self.pool[i]["a"] + self.pool[i]["b"]) / 2 for i in rows])
            often = np.array([self.seen.get((self.pool[i]["size"], self.pool[i]["theme"]), 0) for i in rows])
            score[rows] = gain - often * 0.003 - np.abs(middle - w @ mu) * 0.02
        for i in np.flatnonzero(score > -np.inf).tolist():
            key = (-round(float(score[i]), 12), self.pool[i]["tie_break"])
            if best is None or key < best[0]:
                best = key, i
        return None if best is None else (best[1], False)

    def answer(self, place: int, choice: str) -> None:
        t = self.pool[place]
        repeat = len(self.history) == self.most - 1
        if choice != "ABSTAIN":
            row = self.CHOICE[choice]
            if repeat and row < 2:  # the closing repeat is shown the other way round
                row = 1 - row
            w = self.post[t["axis"]] * self.p[place, row]
            self.post[t["axis"]] = w / (w.sum() or 1)
        self.seen[t["size"], t["theme"]] = self.seen.get((t["size"], t["theme"]), 0) + 1
        self.history.append((place, choice))

    def replay(self, answers: list[str]) -> list[dict]:
        """Trials that the policy shows for answers given in order."""
        out = []
        for i, choice in enumerate(answers):
            step = self.next()
            if step is None:
                break
            place, repeat = step
            t = self.pool[place]
            out.append({"step": i, "trial_id": t["repeat_id"] if repeat else t["trial_id"], "repeat_of": t["trial_id"] if repeat else None, "axis": t["axis"], "a": t["b"] if repeat else t["a"], "b": t["a"] if repeat else t["b"], "choice": choice})
            self.answer(place, choice)
        return out


class Panel:
    """The policy of Loop for many raters at once: posteriors are rows of one matrix a study's axis, a step is a few products.

    A pair of values is scored once, whichever way and under whichever condition it is shown, so trials that the policy
    can't tell apart have the same score to the last bit; places are in order of the hash that decides between those.
    """

    def __init__(self, pool: list[dict], most: int):
        self.pool = sorted((t for t in pool if t["axis"] in ("x", "y")), key=lambda t: (t["tie_break"], t["trial_id"]))
        self.most = most
        conditions = {c: i for i, c in enumerate(sorted({(t["size"], t["theme"]) for t in self.pool}))}
        self.conditions = np.array([conditions[t["size"], t["theme"]] for t in self.pool], int)
        self.n_conditions = len(conditions)
        self.axis = np.array(["xy".index(t["axis"]) for t in self.pool], int)
        a, b = (np.array([t[side] for t in self.pool], float) for side in "ab")
        self.p = _log_choice(a, b)
        self.groups = []  # by axis: places, each one's pair of values, chances, what they leave open, middles
        for axis in range(2):
            at = np.flatnonzero(self.axis == axis)
            if len(at):
                values, pair = np.unique(np.stack([np.minimum(a, b)[at], np.maximum(a, b)[at]]), axis=1, return_inverse=True)
                chances = _log_choice(values[0], values[1])
                self.groups.append((axis, at, pair.ravel(), chances.reshape(-1, GRID).T, -(chances * np.log(chances)).sum(1).T, values.sum(0) / 2))

    def next(self, post: np.ndarray, seen: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Each rater's next place; post: raters, axes, grid; seen: raters, conditions; used: raters, places."""
        mu = -5 + np.arange(GRID) / 10
        score = np.empty(used.shape)
        for axis, at, pair, chances, inner, middle in self.groups:
            w = post[:, axis]
            predictive = (w @ chances).reshape(len(w), -1, 3)
            gain = -(predictive * np.log(predictive)).sum(2) - w @ inner
            score[:, at] = gain[:, pair] - seen[:, self.conditions[at]] * 0.003 - np.abs(middle - (w @ mu)[:, None])[:, pair] * 0.02
        return np.where(used, -np.inf, np.round(score, 12)).argmax(1)

    def replay(self, choices: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places by rater and step, and how many of them were shown; choices: codes of A, B, TIE and ABSTAIN by rater and step."""
        n = len(lengths)
        post, seen, used = np.full((n, 2, GRID), 1 / GRID), np.zeros((n, self.n_conditions)), np.zeros((n, len(self.pool)), bool)
        places, shown = np.zeros((n, self.most), int), np.zeros(n, int)
        for step in range(self.most if self.pool else 0):
            repeat = step == self.most - 1
            who = np.flatnonzero(lengths > step)
            if not len(who) or (step >= len(self.pool) and not repeat):
                break
            place = places[who, 0] if repeat else self.next(post[who], seen[who], used[who])
            told = choices[who, step] < 3
            asked, at, row = who[told], place[told], choices[who[told], step]
            w = post[asked, self.axis[at]] * self.p[at, np.where(repeat & (row < 2), 1 - row, row)]  # the closing repeat is shown the other way round
            total = w.sum(1, keepdims=True)
            post[asked, self.axis[at]] = w / np.where(total == 0, 1, total)
            seen[who, self.conditions[place]] += 1
            used[who, place] = True
            places[who, step] = place
            shown[who] = step + 1
        return places, shown


REPLAY = "rater string, step int, trial_id string, repeat_of string, axis string, a double, b double, choice string"


def replay(answers: DataFrame, pool: list[dict], most: int = 16, rater: str = "rater", order: str = "position") -> DataFrame:
    """Every rater's sequence re-run through the policy; pool is a study's trials (bounded by contract).

    order is any column that sorts, a struct too where times alone may tie. A rater's answers are gathered by the shuffle
    that orders them; Arrow batches of many raters go through the policy together.
    """
    def run(source):
        import pyarrow.compute as pc

        policy = Panel(pool, most)
        kept = policy.pool
        ids, repeats, axes = (pa.array([t[c] for t in kept], pa.string()) for c in ("trial_id", "repeat_id", "axis"))
        a, b = (np.array([t[c] for t in kept], float) for c in "ab")
        for batch in source:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                said, length = part.column(1).flatten(), np.diff(part.column(1).offsets.to_numpy())
                code = pc.index_in(said, pa.array([*Loop.CHOICE, "ABSTAIN"]))
                if code.null_count:
                    raise ValueError("an answer that is none of A, B, TIE and ABSTAIN")
                step = np.arange(len(said)) - np.repeat(np.cumsum(length) - length, length)
                who = np.repeat(np.arange(len(length)), length)
                codes = np.full((len(length), most), 3)
                codes[who, step] = code.to_numpy()
                places, shown = policy.replay(codes, length)
                real = step < shown[who]
                who, step, said = who[real], step[real], said.filter(pa.array(real))
                place = places[who, step]
                closing = step == most - 1
                trial, again = ids.take(pa.array(place)), repeats.take(pa.array(place))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(who)), pa.array(step.astype(np.int32)), pc.if_else(pa.array(closing), again, trial), pc.if_else(pa.array(closing), trial, pa.scalar(None, pa.string())), axes.take(pa.array(place)),
                    pa.array(np.where(closing, b[place], a[place])), pa.array(np.where(closing, a[place], b[place])), said,
                ], names=[c.split()[0] for c in REPLAY.split(", ")])

    # answers past a study's length can't be shown: they go before a rater is gathered
    w = Window.partitionBy(rater).orderBy(order)
    kept = answers.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    gathered = kept.groupBy(rater).agg(F.array_sort(F.collect_list(F.struct("_n", "choice"))).alias("s"))
    return gathered.select(F.col(rater).cast("string"), F.transform("s", lambda v: v["choice"]).alias("choices")).mapInArrow(run, REPLAY)
