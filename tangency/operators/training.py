"""Training of the scoring network over executors: gradients in tasks, small steps on the driver.

A step sends the weights to the tasks. Each adds up the gradient and the loss
of its rows, batch by batch; the sums meet in a second stage, and the driver
gets a few vectors as long as the weights, however many rows there are, and
makes one AdamW update. Rows are never collected.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangency.operators.inference import FEATURES, Network
from tangency.sources.views import checkpointed, shared_folder

HEADS = {"interval": 8, "family": 8, "priority": 1, "cost": 1, "uncertainty": 1}
TARGETS = ("interval_targets", "family_targets", "priority_target", "cost_target", "uncertainty_target")


@dataclass(frozen=True)
class Plan:
    """How to train. ``batches``: rows are dealt by hash to so many parts, of which a step reads one."""

    epochs: int = 20
    batches: int = 1
    rate: float = 1.0e-2
    decay: float = 1.0e-4
    beta1: float = 0.9
    beta2: float = 0.999
    cost_aware: float = 0.25
    uncertainty_work: float = 0.25


def flattened(network: Network) -> np.ndarray:
    parts = [*network.trunk, *[network.heads[h] for h in HEADS]]
    return np.concatenate([x.ravel() for pair in parts for x in pair])


def unflattened(values: np.ndarray, like: Network) -> Network:
    at = 0

    def take(x: np.ndarray) -> np.ndarray:
        nonlocal at
        out = values[at : at + x.size].reshape(x.shape)
        at += x.size
        return out

    trunk = tuple((take(w), take(b)) for w, b in like.trunk)
    return Network(trunk, {h: (take(like.heads[h][0]), take(like.heads[h][1])) for h in HEADS})


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _smooth(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smooth absolute value and its slope: half the square within one of zero."""
    near = np.abs(d) < 1
    return np.where(near, 0.5 * d * d, np.abs(d) - 0.5), np.where(near, d, np.sign(d))


def gradient(network: Network, x: np.ndarray, targets: dict[str, np.ndarray], plan: Plan = Plan()) -> tuple[float, np.ndarray]:
    """Sum over rows of the loss, and of its gradient in the order of ``flattened``.

    Per row: cross entropy of the interval of largest target, mean binary
    cross entropy of the families, squares for priority, cost and uncertainty,
    and ``cost_aware`` times the smooth absolute errors of the reduction of
    work (priority times the log of cost) and of the work at risk (cost, more
    by uncertainty).
    """
    layers = network.hidden(x)
    top = layers[-1]
    raw = {h: top @ w + b for h, (w, b) in network.heads.items()}
    soft = np.exp(raw["interval"] - raw["interval"].max(1, keepdims=True))
    soft /= soft.sum(1, keepdims=True)
    best = targets["interval_targets"].argmax(1)
    rows = np.arange(len(x))
    loss = -np.log(np.maximum(soft[rows, best], 1e-300)).sum()
    back = {"interval": soft.copy()}
    back["interval"][rows, best] -= 1

    z, y = np.clip(raw["family"], -60, 60), targets["family_targets"]
    loss += (np.logaddexp(0, z) - y * z).mean(1).sum()
    back["family"] = (_sigmoid(z) - y) / z.shape[1]

    p, u = _sigmoid(raw["priority"][:, 0]), _sigmoid(raw["uncertainty"][:, 0])
    slope = _sigmoid(raw["cost"][:, 0])
    c = np.logaddexp(0, np.clip(raw["cost"][:, 0], -60, 60))
    tp, tc, tu = (targets[t] for t in TARGETS[2:])
    loss += ((p - tp) ** 2 + (c - tc) ** 2 + (u - tu) ** 2).sum()
    dp, dc, du = 2 * (p - tp), 2 * (c - tc), 2 * (u - tu)
    if plan.cost_aware > 0:
        saved, down = _smooth(p * np.log1p(c) - tp * np.log1p(np.maximum(tc, 0)))
        work, load = _smooth(c * (1 + plan.uncertainty_work * u) - tc * (1 + plan.uncertainty_work * tu))
        loss += plan.cost_aware * (saved + work).sum()
        dp = dp + plan.cost_aware * down * np.log1p(c)
        dc = dc + plan.cost_aware * (down * p / (1 + c) + load * (1 + plan.uncertainty_work * u))
        du = du + plan.cost_aware * load * plan.uncertainty_work * c
    back |= {"priority": (dp * p * (1 - p))[:, None], "cost": (dc * slope)[:, None], "uncertainty": (du * u * (1 - u))[:, None]}

    heads = [part for h in HEADS for part in (top.T @ back[h], back[h].sum(0))]
    down = sum(back[h] @ network.heads[h][0].T for h in HEADS)
    trunk: list[np.ndarray] = []
    for i in range(len(network.trunk) - 1, -1, -1):
        down = down * (layers[i + 1] > 0)
        trunk = [layers[i].T @ down, down.sum(0), *trunk]
        down = down @ network.trunk[i][0].T
    return float(loss), np.concatenate([g.ravel() for g in (*trunk, *heads)])


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _summed(rows: DataFrame, network: Network, plan: Plan, parts: int = 8) -> tuple[int, float, np.ndarray]:
    """(rows, loss, gradient) over all rows, added in tasks and again in at most ``parts`` more."""
    shared = rows.sparkSession.sparkContext.broadcast(network)
    size = flattened(network).size
    schema = "n long, loss double, grad array<double>"

    def out(n: int, loss: float, grad: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([grad])], ["n", "loss", "grad"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, grad = 0, 0.0, np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                targets = {t: _lists(batch.column(t), HEADS[t.split("_")[0]]) for t in TARGETS[:2]}
                targets |= {t: batch.column(t).to_numpy(zero_copy_only=False).astype(float) for t in TARGETS[2:]}
                own, slope = gradient(shared.value, _lists(batch.column("features"), FEATURES), targets, plan)
                n, loss, grad = n + batch.num_rows, loss + own, grad + slope
        if n:
            yield out(n, loss, grad)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, grad = 0, 0.0, np.zeros(size)
        for batch in batches:
            for i in range(batch.num_rows):
                n, loss, grad = n + batch.column(0)[i].as_py(), loss + batch.column(1)[i].as_py(), grad + batch.column(2)[i].values.to_numpy()
        if n:
            yield out(n, loss, grad)

    found = rows.mapInArrow(run, schema).repartition(parts).mapInArrow(add, schema).collect()
    shared.unpersist()
    return sum(r.n for r in found), sum(r.loss for r in found), sum((np.array(r.grad) for r in found), np.zeros(size))


def train(rows: DataFrame, network: Network | None = None, plan: Plan = Plan()) -> tuple[Network, list[tuple[int, int, float]]]:
    """The network trained on rows (features, and the five targets), and the history (epoch, batch, mean loss before the step).

    Rows with a null or a feature that is not usual take no part. Which rows a
    step sees depends on the rows alone, so the result is the same, but for
    the order of sums, however they are dealt. Rows are written once to the
    shared folder, one folder a batch, and a step reads only its own.
    """
    network = network or Network.seeded()
    whole = F.lit(True)
    for c in ("features", *TARGETS):
        whole = whole & F.col(c).isNotNull()
    usual = ~F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > 1.0e5))
    columns = ("features", *TARGETS)
    folder = f"{shared_folder(rows.sparkSession)}/training-{uuid.uuid4().hex}"
    # Written before they are looked at, so that what makes the features is worked out once.
    rows = checkpointed(rows.select(*columns))
    dealt = rows.where(whole).where(usual).select(*columns, F.pmod(F.xxhash64(*columns), F.lit(plan.batches)).cast("int").alias("batch"))
    dealt.write.partitionBy("batch").parquet(folder)
    values = flattened(network)
    first, second, step, history = np.zeros_like(values), np.zeros_like(values), 0, []
    schema = dealt.schema
    for epoch in range(plan.epochs):
        for batch in range(plan.batches):
            part = rows.sparkSession.read.schema(schema).parquet(folder).where(F.col("batch") == batch)
            n, loss, grad = _summed(part, unflattened(values, network), plan)
            if not n:
                continue
            step, grad = step + 1, grad / n
            first = plan.beta1 * first + (1 - plan.beta1) * grad
            second = plan.beta2 * second + (1 - plan.beta2) * grad * grad
            move = first / (1 - plan.beta1**step) / (np.sqrt(second / (1 - plan.beta2**step)) + 1e-8)
            values = values - plan.rate * (move + plan.decay * values)
            history.append((epoch, batch, loss / n))
    return unflattened(values, network), history
