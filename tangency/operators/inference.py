"""Candidate features and scoring by a small multi-head network, with fallback for unusual rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 32
LIMIT = 1.0e5


@dataclass(frozen=True)
class Network:
    """Two hidden layers and heads for eight intervals, eight families, priority, cost and uncertainty."""

    trunk: tuple[tuple[np.ndarray, np.ndarray], ...]
    heads: dict[str, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def seeded(cls, width: int = 32, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        layer = lambda a, b: (rng.normal(0, 1 / np.sqrt(a), (a, b)), np.zeros(b))
        heads = {"interval": 8, "family": 8, "priority": 1, "cost": 1, "uncertainty": 1}
        return cls((layer(FEATURES, width), layer(width, width)), {k: layer(width, n) for k, n in heads.items()})

    def hidden(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for w, b in self.trunk:
            out.append(np.maximum(out[-1] @ w + b, 0))
        return out

    def predict(self, x: np.ndarray) -> dict[str, np.ndarray]:
        top = self.hidden(x)[-1]
        raw = {k: top @ w + b for k, (w, b) in self.heads.items()}
        soft = np.exp(raw["interval"] - raw["interval"].max(1, keepdims=True, initial=-np.inf)) if len(x) else raw["interval"]
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        return {
            "interval_scores": soft / soft.sum(1, keepdims=True) if len(x) else soft,
            "family_scores": sigmoid(raw["family"]),
            "priority": sigmoid(raw["priority"])[:, 0],
            "cost": np.log1p(np.exp(np.clip(raw["cost"], -60, 60)))[:, 0],
            "uncertainty": sigmoid(raw["uncertainty"])[:, 0],
        }


def fit(network: Network, x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.05) -> Network:
    """Full-batch gradient steps of the priority head and trunk on a bounded training table."""
    trunk = [(w.copy(), b.copy()) for w, b in network.trunk]
    w, b = (v.copy() for v in network.heads["priority"])
    for _ in range(steps):
        layers = Network(tuple(trunk), network.heads).hidden(x)
        p = 1 / (1 + np.exp(-np.clip((layers[-1] @ w + b)[:, 0], -60, 60)))
        back = ((p - y) / max(1, len(y)))[:, None]
        grad_w, grad_b, down = layers[-1].T @ back, back.sum(0), back @ w.T
        w -= rate * grad_w
        b -= rate * grad_b
        for i in range(len(trunk) - 1, -1, -1):
            down = down * (layers[i + 1] > 0)
            gw, gb, down = layers[i].T @ down, down.sum(0), down @ trunk[i][0].T
            trunk[i] = (trunk[i][0] - rate * gw, trunk[i][1] - rate * gb)
    return Network(tuple(trunk), network.heads | {"priority": (w, b)})


def unusual(features: str = "features"):
    return F.exists(features, lambda x: F.isnan(x) | (F.abs(x) > LIMIT))


def scored(rows: DataFrame, network: Network, keys: list[str]) -> DataFrame:
    """Keys, the five heads and ``ood`` of rows with an array ``features``; unusual rows skip the network and score 0, uncertainty 1."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", priority double, cost double, uncertainty double, interval_scores array<double>, family_scores array<double>, ood boolean"
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.stack(part["features"].to_numpy()).astype(float) if len(part) else np.zeros((0, FEATURES))
            bad = part["ood"].to_numpy(bool)
            found = shared.value.predict(np.where(bad[:, None], 0.0, x))
            out = part[keys].copy()
            for k in ("priority", "cost"):
                out[k] = np.where(bad, 0.0, found[k])
            out["uncertainty"] = np.where(bad, 1.0, found["uncertainty"])
            out["interval_scores"] = list(found["interval_scores"])
            out["family_scores"] = list(found["family_scores"])
            out["ood"] = bad
            yield out

    return rows.select(*keys, "features", unusual().alias("ood")).mapInPandas(run, schema)
