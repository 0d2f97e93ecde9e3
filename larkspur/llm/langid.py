"""Language identification by a linear-chain conditional random field over words.

A word's emission is a sum of learned weights of its features: affixes, character trigrams and its entry in the lexicon (the
word itself). Transitions between languages are learned too, from training sequences that join segments of several
documents, as code-switched text does. Forward-backward gives each word's language distribution; a document's language is
the one with the largest mean over its words.

Training reads at most `docs_per_lang` documents of each language (documented bound), chosen by a hash of the id among those
outside the held-out fold, each whole, cut into runs of `segment_words` words; only these reach the driver. Prediction is one
pass over whole texts without a shuffle.

Cases: null text or text without a letter: `und`, score 0. Null languages do not train. Nothing to train on: `und`, score 0
everywhere. Texts of any length are labelled whole, in one run of the recursions."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import fold
from larkspur.session import ship

HELD_OUT = 3
LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 15
CACHE_ROWS = 400_000
BATCH_WORDS = 1 << 20
RUN_CHARS = 8_000_000


def words_of(text: str | None) -> list[str]:
    found = LETTERS.findall((text or "").lower())
    return found if any(c.isalpha() for w in found for c in w) else []


def feature_ids(word: str) -> list[int]:
    p = f"^{word}$".encode("utf-8", "surrogatepass").decode("utf-8", "surrogatepass")
    parts = [p[:2], p[:3], p[:4], "~" + p[-2:], "~" + p[-3:], "~" + p[-4:], "=" + word]
    parts += ["#" + p[i : i + 3] for i in range(len(p) - 2)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for x in parts]


def ragged(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of all words, flat, and where each word's begin."""
    ids = [feature_ids(w) for w in words]
    starts = np.cumsum([0] + [len(x) for x in ids[:-1]])
    return np.fromiter((i for x in ids for i in x), dtype=np.int64), starts


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    if not words:
        return np.zeros((0, weights.shape[1]))
    flat, starts = ragged(words)
    return np.add.reduceat(weights[flat], starts, axis=0)


def by_time(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences laid end to end, longest first: an order by position, and how many sequences reach each position."""
    starts = np.cumsum(sizes) - sizes
    t = np.arange(sizes.sum()) - np.repeat(starts, sizes)
    return np.argsort(t, kind="stable"), np.bincount(t)


def forward_backward(scores: np.ndarray, sizes: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of every word, expected transitions and starts. Sequences lie end to end, longest first, none empty."""
    order, active = by_time(sizes)
    at = np.concatenate([[0], np.cumsum(active)])
    e = np.exp(scores[order] - scores[order].max(1, keepdims=True))
    move, alpha, beta = np.exp(trans - trans.max()), np.empty_like(e), np.empty_like(e)
    first = e[: active[0]] * np.exp(start - start.max())
    alpha[: active[0]] = first / first.sum(1, keepdims=True)
    for t in range(1, len(active)):
        x = (alpha[at[t - 1] : at[t - 1] + active[t]] @ move) * e[at[t] : at[t + 1]]
        alpha[at[t] : at[t + 1]] = x / x.sum(1, keepdims=True)
    beta[:] = 1.0
    expected = np.zeros_like(move)
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        ahead = e[at[t + 1] : at[t + 2]] * beta[at[t + 1] : at[t + 2]]
        x = ahead @ move.T
        beta[at[t] : at[t] + n] = x / x.sum(1, keepdims=True)
        now = alpha[at[t] : at[t] + n]
        # divided by each sequence's own total, so that one word's transitions sum to one
        expected += (now / (now * x).sum(1, keepdims=True)).T @ ahead * move
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    out = np.empty_like(p)
    out[order] = p
    return out, expected, p[: active[0]].sum(0)


class Crf:
    def __init__(self, langs: list[str], sequences: list[tuple[list[str], list[int]]], rounds: int = 8, batch: int = 256, rate: float = 0.2, decay: float = 1e-5, seed: int = 3):
        k = len(langs)
        self.langs, self.weights, self.trans, self.start = langs, np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)
        state = [np.full_like(x, 1e-6) for x in (self.weights, self.trans, self.start)]
        rng = np.random.default_rng(seed)
        for _ in range(rounds if k > 1 else 0):
            for part in np.array_split(rng.permutation(len(sequences)), max(1, len(sequences) // batch)):
                own = sorted((sequences[i] for i in part), key=lambda s: -len(s[0]))
                sizes = np.array([len(s[0]) for s in own])
                kinds: dict[str, int] = {}
                which = np.array([kinds.setdefault(w, len(kinds)) for s in own for w in s[0]])
                flat, begin = ragged(list(kinds))
                score = np.add.reduceat(self.weights[flat], begin, axis=0)
                gold = np.concatenate([s[1] for s in own])
                p, moves, starts = forward_backward(score[which], sizes, self.trans, self.start)
                p[np.arange(len(gold)), gold] -= 1
                ends = np.cumsum(sizes) - 1
                inner = np.setdiff1d(np.arange(len(gold)), ends)
                np.subtract.at(moves, (gold[inner], gold[inner + 1]), 1)
                starts -= np.bincount(gold[ends - sizes + 1], minlength=k)
                by_word = np.stack([np.bincount(which, p[:, c], len(kinds)) for c in range(k)], axis=1)
                lengths = np.diff(np.append(begin, len(flat)))
                spread = np.repeat(by_word, lengths, axis=0)
                grad = np.stack([np.bincount(flat, spread[:, c], BUCKETS) for c in range(k)], axis=1)
                for x, g, h in zip((self.weights, self.trans, self.start), (grad, moves, starts), state, strict=True):
                    g = g / len(gold) + decay * x
                    h += g**2
                    x -= rate * g / np.sqrt(h)

    def label(self, texts: list, cache: dict, rows: list) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. cache, rows: words seen by this worker, and their emissions."""
        found = [words_of(t) for t in texts]
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        todo = sorted((i for i, w in enumerate(found) if w), key=lambda i: -len(found[i])) if self.langs else []
        at = 0
        while at < len(todo):
            size, upto = 0, at
            while upto < len(todo) and (upto == at or size + len(found[todo[upto]]) <= BATCH_WORDS):
                size += len(found[todo[upto]])
                upto += 1
            own, at = todo[at:upto], upto
            if len(cache) > CACHE_ROWS:
                cache.clear()
                rows.clear()
            missing = [w for w in dict.fromkeys(w for i in own for w in found[i]) if w not in cache]
            if missing:
                cache.update(zip(missing, range(len(cache), len(cache) + len(missing)), strict=True))
                rows.append(emissions(missing, self.weights))
            if len(rows) > 1:
                rows[:] = [np.concatenate(rows)]
            sizes = np.array([len(found[i]) for i in own])
            which = np.fromiter((cache[w] for i in own for w in found[i]), dtype=np.int64, count=sizes.sum())
            p, _, _ = forward_backward(rows[0][which], sizes, self.trans, self.start)
            mean = np.add.reduceat(p, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            for i, m in zip(own, mean, strict=True):
                best = int(m.argmax())
                lang[i], score[i] = self.langs[best], min(1.0, float(m[best]))
        return lang, score


def train(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", docs_per_lang=200, segment_words=40, seed=5) -> Crf:
    ship(docs.sparkSession)
    order = Window.partitionBy(lang_col).orderBy(F.pmod(F.xxhash64(id_col), F.lit(1 << 31)), id_col)
    usable = docs.filter(F.col(lang_col).isNotNull() & F.coalesce(fold(F.col(id_col), HELD_OUT) != 1, F.lit(False)))
    counts = usable.groupBy(lang_col).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(lang_col, "_lang")
    # a hash lets through about twice the rows wanted of a language, all of a rare one: few rows are left to be ranked
    share = F.pmod(F.xxhash64(id_col), F.lit(1 << 31)) / float(1 << 31)
    few = usable.select(id_col, lang_col).join(F.broadcast(counts), F.col(lang_col) == F.col("_lang")).filter(share < 2.0 * docs_per_lang / F.col("_n"))
    chosen = few.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= docs_per_lang).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("y")).distinct()

    def rows(batches):
        for pdf in batches:
            out = []
            for key, y, text in zip(pdf["_id"], pdf["y"], pdf[text_col], strict=True):
                words = words_of(text)
                out += [(key, y, words[begin : begin + segment_words]) for begin in range(0, len(words), segment_words)]
            yield pd.DataFrame(out, columns=["id", "y", "words"])

    # docs_per_lang rows a language are broadcast
    part = usable.select(id_col, lang_col, text_col).join(F.broadcast(chosen), (F.col(id_col) == F.col("_id")) & (F.col(lang_col) == F.col("y")))
    got = part.select("_id", "y", text_col).mapInPandas(rows, f"id {docs.schema[id_col].dataType.simpleString()}, y string, words array<string>").toPandas()
    items = sorted((str(k), y, tuple(w)) for k, y, w in zip(got["id"], got["y"], got["words"], strict=True))
    langs = sorted({y for _, y, _ in items})
    number, rng, sequences = {y: i for i, y in enumerate(langs)}, np.random.default_rng(seed), []
    turn = list(rng.permutation(len(items)))
    while turn:  # one to three segments in a row: code-switched text
        own = [items[turn.pop()] for _ in range(min(len(turn), int(rng.integers(1, 4))))]
        sequences.append(([w for _, _, ws in own for w in ws], [number[y] for _, y, ws in own for _ in ws]))
    return Crf(langs, sequences)


def identify(docs: DataFrame, model: Crf, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, lang_pred, score) of every document."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        cache: dict = {}
        seen: list = []
        for whole in batches:
            # runs of texts of RUN_CHARS characters, so that a batch's words are not all in memory; a longer text is its own run
            run = whole[text_col].str.len().fillna(0).cumsum() // RUN_CHARS
            for _, pdf in whole.groupby(run):
                lang, score = shared.value.label(list(pdf[text_col]), cache, seen)
                yield pd.DataFrame({id_col: pdf[id_col], "lang_pred": lang, "score": score})

    return docs.select(id_col, text_col).mapInPandas(rows, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
