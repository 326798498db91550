"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of 64 words. Each passage is encoded from its make-up (kinds of characters, repetition, word
lengths), gated attention weighs the passages, and the weighted representation is scored. Everything is learned from
document labels on a bounded sample (sample_rows, sample_chars); every passage of every whole text is scored.

Defined cases: a null or empty text is one passage of zeros. Without labels of both classes every score is 1, so nothing
is rejected. Repeated rows score alike; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import ship_package
from .labelled import held_out, training_sample

PASSAGE = 64
_KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?", "|", "#", "*", "$", "%", "&", "<>", "@/:_-+", "\"'()[]{};=~^`\\"]
_CLASS = np.full(256, len(_KINDS), dtype=np.int64)
for _k, _chars in enumerate(_KINDS):
    _CLASS[list(_chars.encode())] = _k
_CLASS[:33] = len(_KINDS) + 1
N_FEATURES = len(_KINDS) + 2 + 4


def passages(text: str | None) -> np.ndarray:
    """One row of features for each passage."""
    words = (text or "").split()
    out = np.zeros((max(1, -(-len(words) // PASSAGE)), N_FEATURES))
    for k in range(0, len(words), PASSAGE):
        part = words[k : k + PASSAGE]
        raw = np.frombuffer(" ".join(part).encode("utf-8", "replace"), dtype=np.uint8)
        row = out[k // PASSAGE]
        row[: len(_KINDS) + 2] = np.bincount(_CLASS[raw], minlength=len(_KINDS) + 2) / len(raw)
        row[-4] = len(set(part)) / len(part)
        row[-3] = sum(map(str.__eq__, part, part[1:])) / len(part)
        row[-2] = len(raw) / len(part) / 10
        row[-1] = len(part) / PASSAGE
    return out


@dataclass
class AttentionModel:
    """w, b: passage encoder; v, u, a: gated attention; c, d: score. mean, scale: of the passages learned from."""

    p: dict[str, np.ndarray] | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.p, np.repeat(np.arange(len(sizes)), sizes)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["b"])
        tv, gu = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (tv * gu) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        att = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(att[:, None] * h, starts, axis=0)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "tv": tv, "gu": gu, "att": att, "z": z, "s": s, "bag": bag}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.p is None or not texts:
            return np.ones(len(texts))
        bags = [passages(t) for t in texts]
        sizes = np.array([len(b) for b in bags])
        return self.forward(np.concatenate(bags), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)["s"]


def train(sample: list[tuple[str, int, float]], hidden: int = 16, gate: int = 8, steps: int = 300, rate: float = 0.02, ridge: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Full-batch Adam on the log loss."""
    if len({x[1] for x in sample}) < 2:
        return AttentionModel()
    bags = [passages(x[0]) for x in sample]
    y, share = (np.array([x[k] for x in sample], dtype=np.float64) for k in (1, 2))
    share /= share.sum()
    sizes = np.array([len(b) for b in bags])
    starts, x = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.concatenate(bags)
    rng = np.random.default_rng(seed)
    shape = {"w": (N_FEATURES, hidden), "b": (hidden,), "v": (hidden, gate), "u": (hidden, gate), "a": (gate,), "c": (hidden,), "d": (1,)}
    model = AttentionModel({k: rng.normal(0, 0.3, s) if len(s) == 2 or k in "ac" else np.zeros(s) for k, s in shape.items()}, x.mean(0), x.std(0) + 0.02)
    m, v = ({k: np.zeros(s) for k, s in shape.items()} for _ in range(2))
    for t in range(1, steps + 1):
        f, p = model.forward(x, starts, sizes), model.p
        ds = (f["s"] - y) * share
        dz = ds[:, None] * p["c"]
        dz_each = dz[f["bag"]]
        datt = (dz_each * f["h"]).sum(1)
        de = f["att"] * (datt - np.add.reduceat(f["att"] * datt, starts)[f["bag"]])
        dg = de[:, None] * p["a"]
        dv, du = dg * f["gu"] * (1 - f["tv"] ** 2), dg * f["tv"] * f["gu"] * (1 - f["gu"])
        dh = (f["att"][:, None] * dz_each + dv @ p["v"].T + du @ p["u"].T) * (1 - f["h"] ** 2)
        g = {"c": f["z"].T @ ds, "d": np.array([ds.sum()]), "a": (f["tv"] * f["gu"]).T @ de, "v": f["h"].T @ dv, "u": f["h"].T @ du, "w": f["x"].T @ dh, "b": dh.sum(0)}
        for k in p:
            g[k] = g[k] + ridge * p[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, sample_chars: int = 20_000, modulus: int = 3, remainder: int = 1) -> AttentionModel:
    return train(training_sample(docs, labels, "quality", sample_rows, sample_chars, modulus, remainder))


def score_batches(model: AttentionModel, threshold: float = 0.5):
    """A mapInPandas function that adds score and predicted; a batch is scored in runs of bounded length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            scores = np.concatenate([model.score(texts[k : k + 500]) for k in range(0, len(texts), 500)] or [np.zeros(0)])
            yield batch.assign(score=scores, predicted=(scores >= threshold).astype("int32"))

    return run


def score_rows(docs: DataFrame, model: AttentionModel, threshold: float = 0.5, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    run = score_batches(model, threshold)

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in run(batches):
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))[["doc_id", "held_out", "score", "predicted"]]

    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text", held_out(modulus, remainder).alias("held_out")).mapInPandas(narrow, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, modulus: int = 3, remainder: int = 1, **options) -> DataFrame:
    """The scores of every document by a model fitted on those that aren't held out."""
    return score_rows(docs, fit(docs, labels, modulus=modulus, remainder=remainder, **options), threshold, modulus, remainder)
