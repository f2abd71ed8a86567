"""Training with candidates: soft and weighted targets, linear and two-layer models, with and without neighbourhood features,
every candidate on every fold side by side.

A round is one pass over the sample table: each task adds up loss and gradient of all models over its rows, the sums are
added in two steps, and the driver moves every model on by L-BFGS. The driver holds parameters only, whatever the number
of samples."""
from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import SLICE, materialize
from . import grid as G
from .learning import calibrate, folds, mean_dice

ALL = -1   # The fold that holds nothing out
SLOTS = 16


@dataclass(frozen=True)
class Net:
    """A model's shape: parameters are one flat vector."""
    kind: str
    context: int
    width: int
    hidden: int = 64

    @property
    def name(self) -> str:
        return f"{self.kind}, context {self.context}"

    @property
    def size(self) -> int:
        return self.width + 1 if self.kind == "linear" else (self.width + 2) * self.hidden + 1

    def start(self, seed: int) -> np.ndarray:
        if self.kind == "linear":
            return np.zeros(self.size)
        rng = np.random.default_rng([seed, self.context])
        h = self.hidden
        return np.concatenate([rng.normal(0, 1 / np.sqrt(self.width), self.width * h), np.zeros(h), rng.normal(0, 1 / np.sqrt(h), h), np.zeros(1)])

    def parts(self, p: np.ndarray):
        w, h = self.width, self.hidden
        return p[:w * h].reshape(w, h), p[w * h:(w + 1) * h], p[(w + 1) * h:-1], p[-1]

    def logits(self, p: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.kind == "linear":
            return x @ p[:-1] + p[-1]
        a, b, c, d = self.parts(p)
        return np.tanh(x @ a + b) @ c + d

    def sums(self, p: np.ndarray, x: np.ndarray, t: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted cross-entropy with soft targets and its gradient, summed over rows."""
        if self.kind == "linear":
            z = x @ p[:-1] + p[-1]
            e = w * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - t)
            grad = np.concatenate([x.T @ e, [e.sum()]])
        else:
            a, b, c, d = self.parts(p)
            y = np.tanh(x @ a + b)
            z = y @ c + d
            e = w * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - t)
            back = e[:, None] * c * (1 - y * y)
            grad = np.concatenate([(x.T @ back).ravel(), back.sum(0), y.T @ e, [e.sum()]])
        return float((w * (np.logaddexp(0, z) - t * z)).sum()), grad


class Descent:
    """L-BFGS of one model; every point it asks for is evaluated in a pass it shares with all other models."""

    def __init__(self, start: np.ndarray, memory: int = 10):
        self.at, self.value, self.grad = start, None, None
        self.history: deque = deque(maxlen=memory)
        self.step, self.direction, self.done = 1.0, None, False
        self.asked = start

    def told(self, value: float, grad: np.ndarray) -> None:
        if self.done:
            return
        if self.value is not None and not value <= self.value + 1e-4 * self.step * (self.grad @ self.direction):
            self.step *= 0.3   # Too far
            self.done = self.step < 1e-8
        else:
            if self.value is not None:
                s, y = self.asked - self.at, grad - self.grad
                if s @ y > 1e-12:
                    self.history.append((s, y))
            self.at, self.value, self.grad = self.asked, value, grad
            self.done = bool(np.abs(grad).max() < 1e-6)
            q, kept = grad.copy(), []
            for s, y in reversed(self.history):
                a = (s @ q) / (s @ y)
                q -= a * y
                kept.append((a, s, y))
            if self.history:
                s, y = self.history[-1]
                q *= (s @ y) / (y @ y)
            else:
                q /= max(1.0, float(np.linalg.norm(grad)))
            for a, s, y in reversed(kept):
                q += (a - (y @ q) / (s @ y)) * s
            self.direction, self.step = -q, 1.0
        self.asked = self.at + self.step * self.direction


def featured(patches: DataFrame, dim: int, contexts: tuple[int, ...], keys: list[str] = SLICE) -> DataFrame:
    """keys, gy, gx and a vector column x<context> for every context: the own vector, with the neighbourhood's mean behind it
    where the context is above 1."""
    out = patches.select(*keys, "gy", "gx", F.transform("vec", lambda e: e.cast("double")).alias("x1"))
    for c in contexts:
        if c > 1:
            wide = G.context_mean(patches.select(*keys, "gy", "gx", "vec"), dim, c, keys=keys)
            out = out.join(wide.select(*keys, "gy", "gx", F.col("vec").alias(f"x{c}")), [*keys, "gy", "gx"])
    return out.select(*keys, "gy", "gx", *[f"x{c}" for c in contexts])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


@dataclass
class Trained:
    """Parameters by model and fold, and the samples with features and folds they were trained on."""
    nets: list[Net]
    params: dict[tuple[str, int], np.ndarray]
    samples: DataFrame
    rounds: int

    def net(self, name: str) -> Net:
        return next(n for n in self.nets if n.name == name)


def train_folds(samples: DataFrame, dim: int, kinds=("linear", "two-layer"), contexts=(1, 5), n_folds: int | None = None, l2: float = 1e-3, hidden: int = 64, rounds: int = 80, seed: int = 0,
                patches: DataFrame | None = None) -> Trained:
    """Train every candidate on all folds but each one, and on all samples. samples: slice keys, gy, gx, vec, target (share of
    the patch inside the label); patches: all patches with vec, if samples are only some (their neighbours count too).

    Rows above and below one half count equally in total, as estimated without the held-out fold. n_folds as in folds(); with
    a single slice there is nothing to hold out. Null targets and vectors are left out."""
    clean = samples.where(F.col("target").isNotNull() & F.col("vec").isNotNull())
    x = featured(patches if patches is not None else clean, dim, tuple(contexts))
    rows = clean.select(*SLICE, "gy", "gx", F.col("target").cast("double").alias("target")).join(x, [*SLICE, "gy", "gx"])
    rows = materialize(rows.join(folds(clean, n_folds), SLICE))
    share = {r["fold"]: (r["n"], r["t"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("target").alias("t")).collect()}
    total, inside = sum(n for n, _ in share.values()), sum(t for _, t in share.values())
    held = [ALL, *sorted(share)] if len(share) > 1 else [ALL]
    nets = [Net(k, c, dim * (2 if c > 1 else 1), hidden) for k in kinds for c in contexts]
    jobs = [(net, fold) for net in nets for fold in held]
    balance = {}
    for fold in held:
        n, t = (total - share[fold][0], inside - share[fold][1]) if fold != ALL else (total, inside)
        s = min(max(t / n, 1e-3), 1 - 1e-3) if n else 0.5
        balance[fold] = (0.5 / s / max(n, 1), 0.5 / (1 - s) / max(n, 1))
    descents = [Descent(net.start(seed)) for net, _ in jobs]
    done = 0
    if total:
        for done in range(1, rounds + 1):
            asked = [d.asked for d in descents]
            for d, (value, grad), (net, _), p in zip(descents, _pass(rows, jobs, asked, balance), jobs, asked):
                d.told(value + 0.5 * l2 * float(p[:-1] @ p[:-1]), grad + l2 * np.append(p[:-1], 0.0))
            if all(d.done for d in descents):
                break
    return Trained(nets, {(net.name, fold): d.at for (net, fold), d in zip(jobs, descents)}, rows, done)


def _pass(rows: DataFrame, jobs, asked, balance) -> list[tuple[float, np.ndarray]]:
    """Loss and gradient of every model at the point asked for, over all samples it does not hold out."""
    sizes = [1 + len(p) for p in asked]
    shared = rows.sparkSession.sparkContext.broadcast(asked)   # Parameters of all models: bounded by their shapes

    def partial(batches):
        from pyspark import TaskContext
        total = np.zeros(sum(sizes))
        for b in batches:
            if not len(b):
                continue
            t, fold = b.column("target").to_numpy(), b.column("fold").to_numpy()
            x = {c: _matrix(b.column(f"x{c}")) for c in {net.context for net, _ in jobs}}
            at = 0
            for (net, out), p, size in zip(jobs, shared.value, sizes):
                w = np.where(t > 0.5, *balance[out]) * (fold != out)
                value, grad = net.sums(p, x[net.context], t, w)
                total[at] += value
                total[at + 1:at + size] += grad
                at += size
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py()) for v in table.column("sums"))
        return pa.Table.from_arrays([table.column("slot").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])

    cols = rows.select("target", "fold", *[c for c in rows.columns if c[0] == "x" and c[1:].isdigit()])
    found = cols.mapInArrow(partial, "slot int, sums binary").groupBy("slot").applyInArrow(added, "slot int, sums binary").collect()
    total = sum(np.frombuffer(r["sums"]) for r in sorted(found, key=lambda r: r["slot"]))
    shared.destroy()
    out, at = [], 0
    for size in sizes:
        out.append((float(total[at]), total[at + 1:at + size]))
        at += size
    return out


def held_out(trained: Trained) -> DataFrame:
    """candidate, slice keys, gy, gx, value: the probability of every sample by the models that did not see its fold."""
    models = [(net, fold, trained.params[net.name, fold]) for net in trained.nets for fold in sorted({f for n, f in trained.params if n == net.name and f != ALL})]
    head = trained.samples.select(*SLICE, "gy", "gx").schema.simpleString()[7:-1].replace(":", " ")

    def run(batches):
        for b in batches:
            fold = b.column("fold").to_numpy()
            for net, out, p in models:
                on = np.nonzero(fold == out)[0]
                if len(on):
                    part = b.take(pa.array(on))
                    z = net.logits(p, _matrix(part.column(f"x{net.context}")))
                    yield pa.RecordBatch.from_arrays([pa.array([net.name] * len(on)), *[part.column(c) for c in (*SLICE, "gy", "gx")], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["candidate", *SLICE, "gy", "gx", "value"])

    return trained.samples.mapInArrow(run, f"candidate string, {head}, value double")


def select_candidate(trained: Trained, truth: DataFrame, grid: tuple[int, int], out_size: tuple[int, int], valid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Mean held-out Dice per candidate at image resolution (cut at one half), and the model of the best one with its
    probability threshold from the same held-out maps.

    truth: slice keys, y, x of the labels' pixels; valid: pixels the labels speak for. The second table is what a profile
    stores: candidate, kind, context, width, hidden, threshold, dice_at_half, dice_at_threshold, params."""
    by = ["candidate", *SLICE]
    up = G.upsample(held_out(trained), grid, out_size, by)
    pixels = up.join(truth.select(*SLICE, "y", "x", F.lit(True).alias("truth")), [*SLICE, "y", "x"], "left").withColumn("truth", F.coalesce("truth", F.lit(False)))
    if valid is not None:
        pixels = pixels.join(valid.select(*SLICE, "y", "x"), [*SLICE, "y", "x"], "left_semi")
    pixels = materialize(pixels)
    scores = materialize(mean_dice(pixels, 0.5, ["candidate"]).groupBy("candidate").agg(F.avg("dice").alias("mean_dice"), F.count("*").alias("n_slices")))
    ranked = sorted(scores.collect(), key=lambda r: (-round(r["mean_dice"], 12), [n.name for n in trained.nets].index(r["candidate"])))
    name = ranked[0]["candidate"] if ranked else trained.nets[0].name
    best = calibrate(pixels.where(F.col("candidate") == name)).first() if ranked else None
    net = trained.net(name)
    row = (name, net.kind, net.context, net.width, net.hidden, best["threshold"] if best else 0.5, ranked[0]["mean_dice"] if ranked else None, best["dice"] if best else None, trained.params[name, ALL].tolist())
    schema = "candidate string, kind string, context int, width int, hidden int, threshold double, dice_at_half double, dice_at_threshold double, params array<double>"
    return scores, scores.sparkSession.createDataFrame([row], schema)


def predict(model: DataFrame, patches: DataFrame, dim: int) -> DataFrame:
    """Slice keys, gy, gx, value: probability of every patch by a stored model (the first row of the table)."""
    m = model.first()
    net, p = Net(m["kind"], m["context"], m["width"], m["hidden"]), np.array(m["params"])
    x = featured(patches, dim, (net.context,))
    head = x.select(*SLICE, "gy", "gx").schema.simpleString()[7:-1].replace(":", " ")

    def run(batches):
        for b in batches:
            if len(b):
                z = net.logits(p, _matrix(b.column(f"x{net.context}")))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*SLICE, "gy", "gx")], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*SLICE, "gy", "gx", "value"])

    return x.mapInArrow(run, f"{head}, value double")
