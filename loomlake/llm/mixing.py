"""Mixing sources to target weights by iterative proportional fitting, then sampling by calibrated probabilities.

Documents fall in cells of source, language and topic; topics are clusters of hashed terms, learned from all documents.
A document of a cell is drawn with probability p = min(1, rate * product of one factor for each margin value). The factors
are raked: margin after margin, each value's factor is multiplied by its target over its expected share, where the
expected tokens count p with its bound of 1. So cells that are taken whole stay fixed and the others are raked on, until
all margins are met (``tolerance``) or ``steps`` are done. Values with too few tokens for their target at this rate leave
a deviation; the rate is then lowered (by factors of 0.8, the first that does) until no expected share is further than
``allowed`` from its target. Where targets contradict each other so that no rate does, the least of the rates tried
counts. The rate used and the largest deviation come with every row. A hash of id and text decides the draw, so it is the
same whenever it is made; copies with one id are drawn together.

The cell table has a row for each combination of margin values. Up to ``max_cells`` of them it is raked on the driver;
beyond, each step is a DataFrame aggregation and the probabilities are joined by a shuffle: the same steps and bounds.

Null margin values are a value of their own; targets for values that no document has are left out and the rest scaled
up. Without targets a margin aims at its own shares to the power ``power``. Null and empty texts have 0 tokens; a cell
without tokens gets weight 1. Very long texts are read whole, one at a time. Repeated rows get equal results; empty
tables give empty tables. Columns of any name go through: names are not used inside.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import batches, cut, drop_cut, texts_of
from loomlake.llm.pseudo_likelihood import word_hashes
from loomlake.llm.token_fst import groups

MARGINS = ("source", "lang", "topic")
POWER = {"source": 0.5, "lang": 0.7, "topic": 0.5}
NULL = "\0null"
TOPICS, DIMENSIONS, ROUNDS = 8, 256, 4
U = np.uint64


def term_vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, vector) of each text: square roots of counts of hashed words, scaled to length 255."""
    n, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), DIMENSIONS), np.uint8)
    for i, j in groups(texts):
        h, n[i:j] = word_hashes(texts[i:j])
        at = np.repeat(np.arange(j - i), n[i:j]) * DIMENSIONS + (h % U(DIMENSIONS)).astype(np.int64)
        x = np.sqrt(np.bincount(at, minlength=(j - i) * DIMENSIONS).reshape(j - i, DIMENSIONS))
        out[i:j] = np.round(x * 255 / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9))
    return n, out


def featured(df: DataFrame, text: str, keep: list[str], draw) -> DataFrame:
    """c0, c1, .. (the columns ``keep``), n_tokens, draw, vector."""
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], draw.alias("draw"), F.col(f"`{text}`").alias("text"))
    k = len(keep)
    schema = rows.drop("text").schema.add("n_tokens", "long").add("vector", "binary")

    def run(batches_):
        for b in batches(batches_):
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                n, v = term_vectors(texts_of(part.column(k + 1)))
                yield pa.RecordBatch.from_arrays([*part.columns[: k + 1], pa.array(n), pa.array([x.tobytes() for x in v], pa.binary())], [*(f"c{j}" for j in range(k)), "draw", "n_tokens", "vector"])

    return rows.mapInArrow(run, schema)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DIMENSIONS).astype(np.float32)


class Topics:
    """Centres of clusters of term vectors, the mean of all vectors taken off."""

    def __init__(self, mean: np.ndarray, centres: np.ndarray):
        self.mean, self.centres = mean, centres

    def of(self, x: np.ndarray) -> np.ndarray:
        y = x - self.mean
        return (y @ self.centres.T - (self.centres**2).sum(1) / 2).argmax(1)


def _sums(vectors: DataFrame, topics: Topics | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number sums of the vectors of each cluster and their number: the same for any partitioning."""
    shared = vectors.sparkSession.sparkContext.broadcast(topics)

    def run(rows):
        total = np.zeros((k, DIMENSIONS + 1), np.int64)
        for b in batches(rows):
            x = _matrix(b.column(0))
            at = shared.value.of(x) if shared.value else np.zeros(len(x), np.int64)
            for c in np.unique(at).tolist():
                total[c, :-1] += x[at == c].sum(0, dtype=np.float64).astype(np.int64)
                total[c, -1] += int((at == c).sum())
        c, d = np.nonzero(total)
        if len(c):
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), pa.array(total[c, d])], ["c", "d", "x"])

    got = vectors.mapInArrow(run, "c long, d long, x long").groupBy("c", "d").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros((k, DIMENSIONS + 1))
    out[got.column("c").to_numpy(), got.column("d").to_numpy()] = got.column("x").to_numpy()
    return out[:, :-1], out[:, -1]


def learn_topics(rows: DataFrame, k: int = TOPICS, rounds: int = ROUNDS, first: int = 512) -> Topics:
    """k-means over the vectors of all rows. Only the first centres come from a sample: the ``first`` rows in order of
    draw, of which each centre is the one furthest from those before it."""
    vectors = rows.select("vector")
    total, n = _sums(vectors, None, 1)
    mean = (total[0] / max(n[0], 1)).astype(np.float32)
    some = rows.orderBy("draw", "vector").limit(first).select("vector").toArrow().column("vector")
    centres = np.zeros((1, DIMENSIONS), np.float32)
    if len(some):
        y = _matrix(some) - mean
        chosen, far = [0], ((y - y[0]) ** 2).sum(1)
        while len(chosen) < min(k, len(y)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((y - y[chosen[-1]]) ** 2).sum(1))
        centres = y[chosen]
    topics = Topics(mean, centres)
    for _ in range(rounds):
        total, n = _sums(vectors, topics, len(centres))
        topics = Topics(mean, np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None] - mean, topics.centres).astype(np.float32))
    return topics


def with_topics(rows: DataFrame, topics: Topics) -> DataFrame:
    """The vector column gives way to topic: t0, t1, .."""
    shared, at = rows.sparkSession.sparkContext.broadcast(topics), rows.columns.index("vector")
    schema = rows.drop("vector").schema.add("topic", "string")

    def run(batches_):
        for b in batches(batches_):
            names = pa.array([f"t{i}" for i in shared.value.of(_matrix(b.column(at)))], pa.string())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), names], schema.names)

    return rows.mapInArrow(run, schema)


def targets_of(totals: dict[str, float], wanted: dict[str, float] | None, power: float) -> dict[str, float]:
    """Shares that sum to 1 over the values with tokens."""
    have = {v: t for v, t in totals.items() if t > 0}
    raw = {v: max(0.0, wanted.get(v, 0.0)) for v in have} if wanted is not None else {v: t**power for v, t in have.items()}
    total = sum(raw.values())
    if have and total <= 0:
        raise ValueError("no value with tokens has a target")
    return {v: x / total for v, x in raw.items()}


_MOST = 1e15  # of a factor: values whose cells are all taken whole would grow without end


def rake(cells: np.ndarray, mass: np.ndarray, targets: list[np.ndarray], rate: float, steps: int, tolerance: float) -> tuple[np.ndarray, float]:
    """cells (n, margins) of value numbers -> (probabilities, largest deviation of a share from its target)."""
    u, goal = np.ones(len(mass)), rate * mass.sum()

    def shares(k: int) -> np.ndarray:
        return np.bincount(cells[:, k], mass * np.minimum(1.0, rate * u), len(targets[k]))

    for _ in range(steps):
        for k, want in enumerate(targets):
            have = shares(k) / goal
            u = np.minimum(_MOST, u * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[cells[:, k]])
        if max(np.abs(shares(k) / goal - t).max() for k, t in enumerate(targets)) < tolerance:
            break
    drawn = max(shares(0).sum(), 1e-300)
    return np.minimum(1.0, rate * u), max(np.abs(shares(k) / drawn - t).max() for k, t in enumerate(targets))


def lowered(try_rate, rate: float, allowed: float, times: int = 48):
    """The first of rate, 0.8 * rate, .. (``times`` at most) whose result (.., deviation) is allowed, by halving."""
    got = try_rate(rate)
    if got[-1] <= allowed:
        return rate, got
    low, high, best = 0, times, try_rate(rate * 0.8**times)
    if best[-1] > allowed:
        return rate * 0.8**times, best
    while high - low > 1:
        middle = (low + high) // 2
        got = try_rate(rate * 0.8**middle)
        if got[-1] <= allowed:
            high, best = middle, got
        else:
            low = middle
    return rate * 0.8**high, best


def calibrate(cells: DataFrame, targets: dict, power: dict, rate: float, margins, max_cells: int, allowed: float, steps: int, tolerance: float) -> tuple[DataFrame, bool]:
    """cells (m0, .., mass) -> (m0, .., weight, probability, rate, deviation); whether it is small."""
    keys = [f"m{i}" for i in range(len(margins))]
    spark = cells.sparkSession
    got = cells.limit(max_cells + 1).toArrow()
    if got.num_rows > max_cells:
        return calibrate_distributed(cells, targets, power, rate, margins, allowed, steps, tolerance), False
    got = got.sort_by([(k, "ascending") for k in keys])  # sums in one order, whatever the partitions
    mass = got.column("mass").to_numpy().astype(float)
    values = [got.column(k).to_pylist() for k in keys]

    def table(weight: np.ndarray, probability: np.ndarray, rate: float, off: float) -> DataFrame:
        """From Arrow: rows of Python objects would be read by workers that stay on beside the next stage's."""
        columns = {"weight": weight, "probability": probability, "rate": np.full(len(mass), float(rate)), "deviation": np.full(len(mass), float(off))}
        return spark.createDataFrame(pa.table({k: pa.array(v, pa.string()) for k, v in zip(keys, values)} | columns))

    if not mass.sum():
        return table(np.ones(len(mass)), np.full(len(mass), float(rate)), rate, 0.0), True
    numbers, goals = [], []
    for v, m in zip(values, margins):
        names = sorted(set(v))
        at = {x: i for i, x in enumerate(names)}
        numbers.append([at[x] for x in v])
        want = targets_of(dict(zip(names, np.bincount(numbers[-1], mass, len(names)))), targets.get(m), power.get(m, 1.0))
        goals.append(np.array([want.get(x, 0.0) for x in names]))
    numbers = np.array(numbers).T
    rate, (p, off) = lowered(lambda r: rake(numbers, mass, goals, r, steps, tolerance), rate, allowed)
    weight = np.where(mass > 0, p / rate, 1.0)
    p = np.where(mass > 0, p, rate)
    return table(weight, p, rate, off), True


def calibrate_distributed(cells: DataFrame, targets: dict, power: dict, rate: float, margins, allowed: float, steps: int, tolerance: float) -> DataFrame:
    """The same steps as aggregations and joins, for any number of cells. Each step is a table in the shared folder."""
    keys = [f"m{i}" for i in range(len(margins))]
    spark = cells.sparkSession
    cells = cut(cells.select(*keys, "mass"))
    total = cells.agg(F.sum("mass")).first()[0] or 0
    if not total:
        return cells.select(*keys, F.lit(1.0).alias("weight"), *[F.lit(float(rate)).alias(c) for c in ("probability", "rate")], F.lit(0.0).alias("deviation"))
    goals = []
    for k, m in zip(keys, margins):
        have = cells.groupBy(k).agg(F.sum("mass").alias("t")).where("t > 0")
        if targets.get(m) is not None:
            wanted = spark.createDataFrame([(v, float(x)) for v, x in targets[m].items()], f"{k} string, raw double")
            have = have.join(wanted, k, "left").select(k, F.greatest(F.coalesce("raw", F.lit(0.0)), F.lit(0.0)).alias("raw"))
        else:
            have = have.select(k, F.pow("t", F.lit(power.get(m, 1.0))).alias("raw"))
        whole = have.agg(F.sum("raw")).first()[0]
        if not whole:
            raise ValueError("no value with tokens has a target")
        goals.append(cut(have.select(k, (F.col("raw") / whole).alias("want"))))

    def against(now: DataFrame, k: str, goal: DataFrame, share) -> DataFrame:
        have = now.groupBy(k).agg((F.sum(drawn) / share).alias("have"))
        return have.join(goal, k, "left").select(k, "have", F.coalesce("want", F.lit(0.0)).alias("want"))

    def deviation(now: DataFrame, share) -> float:
        parts = [against(now, k, goal, share).select(F.abs(F.col("have") - F.col("want")).alias("d")) for k, goal in zip(keys, goals)]
        return reduce(DataFrame.union, parts).agg(F.max("d")).first()[0]

    def try_rate(r: float):
        nonlocal drawn
        drawn = F.col("mass") * F.least(F.lit(1.0), F.col("u") * r)
        now = cut(cells.withColumn("u", F.lit(1.0)))
        for _ in range(steps):
            last = now
            for k, goal in zip(keys, goals):
                factor = against(now, k, goal, r * total).select(k, F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(0.0).alias("f"))
                now = now.join(factor, k).select(*keys, "mass", F.least(F.lit(_MOST), F.col("u") * F.col("f")).alias("u"))
            now = cut(now)
            drop_cut(last)
            if deviation(now, r * total) < tolerance:
                break
        return now, deviation(now, now.agg(F.sum(drawn)).first()[0])

    drawn = F.lit(0.0)
    rate, (now, off) = lowered(try_rate, rate, allowed)
    some = F.col("mass") > 0
    p = F.least(F.lit(1.0), F.col("u") * rate)
    return now.select(*keys, F.when(some, p / rate).otherwise(1.0).alias("weight"), F.when(some, p).otherwise(rate).alias("probability"), F.lit(float(rate)).alias("rate"), F.lit(float(off)).alias("deviation"))


def mix(
    df: DataFrame, keep: list[str], targets: dict[str, dict[str, float]] | None = None, rate: float = 0.5, allowed: float = 0.02, power: dict[str, float] = POWER,
    margins=MARGINS, seed: int = 17, max_cells: int = 100_000, steps: int = 200, tolerance: float = 1e-6, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """c0, c1, .. (the columns ``keep`` of df), m0, .. (its margin values), topic, n_tokens, weight, probability, rate,
    deviation, sampled. The margin ``topic`` is the learned one, if df has no such column."""
    if not 0 < rate <= 1:
        raise ValueError("rate is over 0 and at most 1")
    own = [m for m in margins if m in df.columns]
    if missing := set(margins) - set(own) - {"topic"}:
        raise ValueError(f"no column {sorted(missing)}")
    draw = F.pmod(F.xxhash64(f"`{id_col}`", f"`{text_col}`", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    vectors = cut(featured(df, text_col, [*keep, *own], draw))
    rows = cut(with_topics(vectors, learn_topics(vectors)))
    drop_cut(vectors)
    values = {m: F.col(f"c{len(keep) + i}") for i, m in enumerate(own)}
    full = rows.withColumns({f"m{i}": F.coalesce(values.get(m, F.col("topic")).cast("string"), F.lit(NULL)) for i, m in enumerate(margins)})
    keys = [f"m{i}" for i in range(len(margins))]
    cells = full.groupBy(*keys).agg(F.sum("n_tokens").cast("double").alias("mass"))
    weights, small = calibrate(cells, targets or {}, power, rate, margins, max_cells, allowed, steps, tolerance)
    return full.join(F.broadcast(weights) if small else weights, keys).withColumn("sampled", F.col("draw") < F.col("probability"))


def mixture(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, rate, deviation, sampled) of each row of df."""
    out = mix(df, [id_col, "source", "lang"], id_col=id_col, **options)
    return out.select(F.col("c0").cast("long").alias("doc_id"), F.col("c1").alias("source"), F.col("c2").alias("lang"), "topic", "n_tokens", "weight", "probability", "rate", "deviation", "sampled")


def sample(df: DataFrame, **options) -> DataFrame:
    """The rows of df that are drawn, with the columns of df."""
    return mix(df, df.columns, **options).where("sampled").select(*[f"c{i}" for i in range(len(df.columns))]).toDF(*df.columns)
