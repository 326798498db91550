"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A document is toxic unless none of its sentences is: score = 1 - (1 - leak) * prod(1 - s). Sentences are scored by logistic
regression over words and word beginnings. The leak, one chance for all documents, takes up labels that no sentence
explains, so that long documents don't become toxic by their length. Learned from are features whose share of documents
differs between the labels by more than chance. The model is fitted on a bounded sample (sample_rows, sample_chars); every
whole text is scored in tasks that hold one Arrow batch.

Defined cases: a null or empty text has no sentence and scores the leak alone. Without labels of both classes every score
is 0. Repeated rows score alike; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import ship_package
from .labelled import held_out, training_sample

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Standard errors by which a feature's share of documents must differ between the labels to be learned from.
TELLING = 3.0
#: Prior logit of a sentence.
HARMLESS = -12.0


def features(word: str) -> list[str]:
    return [word] + [f"^{word[:n]}" for n in (4, 5) if len(word) > n]


@dataclass
class NoisyOr:
    """bias and feature weights of a sentence (a feature counts once in it, as in training); leak: the document's own logit."""

    bias: float = -np.inf
    leak: float = -np.inf
    weights: dict[str, float] = field(default_factory=dict)
    _seen: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def telling(self, word: str) -> tuple[str, ...]:
        """The word's features that have a weight."""
        found = self._seen.get(word)
        if found is None:
            if len(self._seen) > 200_000:
                self._seen.clear()
            found = self._seen[word] = tuple(f for f in features(word) if f in self.weights)
        return found

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, logit) of every sentence with a word."""
        out, seen, telling, weights = [], self._seen, self.telling, self.weights
        for m in _SENTENCE.finditer(text or ""):
            words = _WORD.findall(m[0].lower())
            if words:
                met = set()
                for w in words:
                    found = seen.get(w)
                    met.update(telling(w) if found is None else found)
                out.append((m.start(), m.end(), self.bias + sum(weights[f] for f in sorted(met))))
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Leaky noisy-or of all sentences, and the offending ones (start, end, score)."""
        spans = self.sentences(text)
        z = np.array([x[2] for x in spans])
        s = 1 / (1 + np.exp(-z))
        return float(-np.expm1(-np.logaddexp(0, z).sum() - np.logaddexp(0, self.leak))), [(a, b, float(p)) for (a, b, _), p in zip(spans, s) if p >= 0.5]


def _descend(y: np.ndarray, share: np.ndarray, columns: np.ndarray, sentence: np.ndarray, document: np.ndarray, features: int, steps: int, rate: float, ridge: float) -> tuple[np.ndarray, float, float]:
    """Full-batch Adam on the leaky noisy-or likelihood: feature weights, the sentences' bias, the documents' leak (a logit)."""
    n = len(document)
    # The ridge draws weights to 0 and the bias to its start: sentences are harmless unless something in them tells.
    centre = np.concatenate([np.zeros(features), [HARMLESS, -4.0]])
    p, ridge = centre.copy(), np.concatenate([np.full(features, ridge), [100 * ridge, 0.0]])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        z = p[-2] + np.bincount(sentence, p[columns], minlength=n)
        clean = np.exp(np.bincount(document, -np.logaddexp(0, z), minlength=len(y)) - np.logaddexp(0, p[-1]))
        clean = np.clip(clean, 0, 1 - 1e-6)
        pull = np.where(y > 0, -clean / (1 - clean), 1.0) * share
        dz = pull[document] / (1 + np.exp(-z))
        g = np.concatenate([np.bincount(columns, dz[sentence], minlength=features), [dz.sum(), pull.sum() / (1 + np.exp(-p[-1]))]]) + ridge * (p - centre)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:-2], float(p[-2]), float(p[-1])


def train(sample: list[tuple[str, int, float]], steps: int = 500, rate: float = 0.3, ridge: float = 1e-4, least_documents: int = 4) -> NoisyOr:
    """The model of a sample of (text, label, weight): features that tell the labels apart, weighed by sentence."""
    if len({x[1] for x in sample}) < 2:
        return NoisyOr()
    seen, parsed = (Counter(), Counter()), []
    for text, label, _ in sample:
        sentences = [{f for w in _WORD.findall(m[0].lower()) for f in features(w)} for m in _SENTENCE.finditer(text)]
        parsed.append([words for words in sentences if words])
        seen[int(label)].update(set().union(*parsed[-1]))
    names = sorted(f for f in seen[0].keys() | seen[1].keys() if seen[0][f] + seen[1][f] >= least_documents)
    size = [sum(x[1] == label for x in sample) for label in (0, 1)]
    share_of = [np.array([seen[label][f] for f in names]) / size[label] for label in (0, 1)]
    pooled = np.array([seen[0][f] + seen[1][f] for f in names]) / len(sample)
    apart = np.abs(share_of[1] - share_of[0]) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / size[0] + 1 / size[1]))
    index = {f: k for k, f in enumerate(f for f, x in zip(names, apart) if x >= TELLING)}
    columns, sentence, document, n = [], [], [], 0
    for d, sentences in enumerate(parsed):
        for words in sentences:
            ids = [index[f] for f in words if f in index]
            columns += ids
            sentence += [n] * len(ids)
            document.append(d)
            n += 1
    columns, sentence, document = np.array(columns, dtype=np.int64), np.array(sentence, dtype=np.int64), np.array(document, dtype=np.int64)
    y, share = (np.array([x[k] for x in sample], dtype=np.float64) for k in (1, 2))
    share /= share.sum()
    w, b, leak = _descend(y, share, columns, sentence, document, len(index), steps, rate, ridge)
    return NoisyOr(b, leak, {f: float(w[k]) for f, k in index.items()})


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, sample_chars: int = 20_000, modulus: int = 4, remainder: int = 2) -> NoisyOr:
    return train(training_sample(docs, labels, "toxic", sample_rows, sample_chars, modulus, remainder))


def score(docs: DataFrame, model: NoisyOr, threshold: float = 0.3, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences (spans in code points)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.score(t if isinstance(t, str) else None) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "held_out": batch["held_out"],
                    "score": [x[0] for x in found],
                    "predicted": [int(x[0] >= threshold) for x in found],
                    "sentences": [[{"start": a, "end": b, "score": s} for a, b, s in x[1]] for x in found],
                }
            )

    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text", held_out(modulus, remainder).alias("held_out")).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, sentences array<struct<start:int,end:int,score:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, fit(docs, labels, **options))
