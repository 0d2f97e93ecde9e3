"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a sum of binned text features. Pairs of one good and one bad labelled document are preferences; the
logistic loss on the difference of their features gives the weights. The score is a logistic curve through the strength at
which the training sample's strengths reach the share of bad labels (a quantile): there it is `cut`, so score >= cut
keeps that share.

Training reads at most `sample_rows` labelled documents (documented bound), chosen by a hash of the id among those outside
the held-out fold; only their feature rows reach the driver. Scoring is one pass over all whole texts without a shuffle.

Cases: null and empty texts get a score like any other text (all counts zero). No labels, or labels of one kind: every score
is 0.5. Labels that are null are left out; a document with several labels counts as often. Extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import fold
from larkspur.session import ship

HELD_OUT = 5
#: Byte classes: space, newline, lower, upper, digit, non-ASCII, and two of punctuation (sentence marks, others).
CLASSES = np.full(256, 7, dtype=np.uint8)
for _cls, _bytes in enumerate((b" \t", b"\n\r\x0b\x0c", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", bytes(range(128, 256)), b".,;:'?-")):
    CLASSES[list(_bytes)] = _cls
MARKS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    n = max(1, len(b))
    counts = np.bincount(b, minlength=256)
    cls = CLASSES[b]
    pairs = np.bincount(cls[:-1] * np.uint8(8) + cls[1:], minlength=64) if len(b) > 1 else np.zeros(64)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m, k = max(1, len(words)), max(1, len(lines))
    same = sum(x == y for x, y in zip(words, words[1:], strict=False))
    shape = [np.log1p(len(b)), np.log1p(len(words)), n / m, len(set(words)) / m, same / m, len(set(lines)) / k, np.log1p(n / k), len(words) / k]
    return np.concatenate([shape, np.bincount(cls, minlength=8) / n, pairs / n, counts[MARKS] / n]).astype(np.float32)


N_FEATURES = len(features(""))


def bin_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Quantiles of each feature's column, (features, bins - 1)."""
    return np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T.copy()


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Column numbers of the bins that the rows fall in, (rows, features); a value equal to an edge lies above it."""
    width = edges.shape[1] + 1
    return np.stack([np.searchsorted(e, v, side="right") + i * width for i, (e, v) in enumerate(zip(edges, x.T, strict=True))], axis=1)


def fit_pairs(cols: np.ndarray, good: np.ndarray, bad: np.ndarray, width: int, pairs: int, rounds: int, seed: int, decay: float = 1e-4) -> np.ndarray:
    """Weights that minimise the mean logistic loss of strength(bad) - strength(good) over sampled pairs, by Adagrad."""
    rng = np.random.default_rng(seed)
    w, g2 = np.zeros(width), np.full(width, 1e-8)
    for _ in range(rounds):
        i, j = rng.choice(good, pairs), rng.choice(bad, pairs)
        margin = w[cols[i]].sum(1) - w[cols[j]].sum(1)
        pull = 1 / (1 + np.exp(np.clip(margin, -50, 50))) / pairs
        grad = decay * w
        grad -= np.bincount(cols[i].ravel(), np.repeat(pull, cols.shape[1]), width)
        grad += np.bincount(cols[j].ravel(), np.repeat(pull, cols.shape[1]), width)
        g2 += grad**2
        w -= 0.1 * grad / np.sqrt(g2)
    return w


class Ranker:
    """edges, weights, and the logistic curve through `cut` at the chosen quantile of strength."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cut: float, bins: int = 8, pairs: int = 4096, rounds: int = 150, seed: int = 7):
        self.cut, self.edges = cut, None
        good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
        if not len(good) or not len(bad):
            return
        self.edges = bin_edges(x, bins)
        cols = binned(x, self.edges)
        self.weights = fit_pairs(cols, good, bad, self.edges.size + len(self.edges), pairs, rounds, seed)
        strength = self.weights[cols].sum(1)
        # midway between the strengths on both sides of the quantile, so that a gap there is cut in its middle
        ordered, at = np.sort(strength), min(max(1, len(bad)), len(y) - 1)
        self.middle = float((ordered[at - 1] + ordered[at]) / 2)
        self.spread = float(max(1e-9, np.quantile(strength[good], 0.5) - np.quantile(strength[bad], 0.5)) / 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.edges is None:
            return np.full(len(x), 0.5)
        z = (self.weights[binned(x, self.edges)].sum(1) - self.middle) / self.spread + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality", cut=0.3, sample_rows=20000) -> Ranker:
    ship(docs.sparkSession)
    chosen = (
        labels.filter((fold(F.col(id_col), HELD_OUT) != 0) & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id", "y")
        .limit(sample_rows)
    )

    def rows(batches):
        for pdf in batches:
            yield pd.DataFrame({"y": pdf.y, "x": [features(t) for t in pdf[text_col]]})

    # at most sample_rows small rows are broadcast
    part = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select("y", text_col)
    got = part.mapInPandas(rows, "y int, x array<float>").toPandas()
    x = np.stack(got.x) if len(got) else np.zeros((0, N_FEATURES), np.float32)
    order = np.lexsort((*x.T[:8], got.y.to_numpy()))  # the same model whatever the order in which rows came
    return Ranker(x[order].astype(np.float64), got.y.to_numpy()[order], cut)


def score(docs: DataFrame, model: Ranker, *, text_col="text", keep: list[str] | None = None, own: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns `keep` of docs (default all) with score and predicted (or the names `own`, which replace columns so named)."""
    ship(docs.sparkSession)
    shared, keep = docs.sparkSession.sparkContext.broadcast(model), [c for c in keep or docs.columns if c not in own]
    names = list(dict.fromkeys([*keep, text_col]))

    def rows(batches):
        for pdf in batches:
            s = shared.value.score(np.stack([features(t) for t in pdf[text_col]]).astype(np.float64)) if len(pdf) else np.zeros(0)
            yield pdf[keep].assign(**{own[0]: s, own[1]: (s >= shared.value.cut).astype("int32")})

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*names).mapInPandas(rows, f"{schema}, {own[0]} double, {own[1]} int")
