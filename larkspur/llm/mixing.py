"""Mixing sources to target weights by blocks.

Every source's words are packed into fixed-length blocks (within buckets of documents, so that no task holds a source).
Multinomial draws deal the sources' slots to output shards; a slot's block comes from a pseudorandom permutation of the
source's block indices, one permutation a pass; slots and blocks are joined by index.

Scale: texts are read once, for their word counts. A source that holds a third of all rows is spread over buckets of about
`bucket_docs` documents, and over its blocks in the join. The driver holds one row a source (their number is taken to be
that of a catalogue) and no document.

Cases: null or empty texts have size 0 and are never taken. The null source is a source, last in order. No words at all:
targets 0. Repeated rows are rows of their own. An empty table gives an empty result. Reruns agree: draws are seeded, and
order follows a hash of the row. A source's block is taken at most twice, as its target is at most twice its size."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import n_words
from larkspur.session import cut, ship, unused

WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Water-filling: shares by weight, each at most `most` times its size, what is above dealt again to the others."""
    total, out = share * sum(sizes), [0.0] * len(sizes)
    active = list(range(len(sizes)))
    while active:
        unit = total / sum(weights[i] for i in active)
        over = [i for i in active if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in active:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            total -= out[i]
        active = [i for i in active if i not in set(over)]
    return out


def deal(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) counts: for each shard a multinomial draw over what the sources have left; the sums are `slots`."""
    rng, left, out = np.random.default_rng(seed), slots.astype(np.int64).copy(), []
    for shard in range(shards):
        n = int(left.sum()) // (shards - shard)
        got = np.minimum(rng.multinomial(n, left / left.sum()), left) if n else np.zeros_like(left)
        if shard == shards - 1:
            got = left.copy()
        for i in np.argsort(-(left - got), kind="stable"):
            more = min(n - int(got.sum()), int(left[i] - got[i]))
            if more <= 0:
                break
            got[i] += more
        out.append(got)
        left = left - got
    return np.array(out)


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The image of indices x under a pseudorandom permutation of range(n): a Feistel network, walked until inside."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def turn(v):
        left, right = v >> np.uint64(half), v & mask
        for r in range(4):
            h = (right + np.uint64((key * 2654435761 + r * 40503 + 1) % 2**64)) * np.uint64(0x9E3779B97F4A7C15)
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) & mask
        return (left << np.uint64(half)) | right

    out = turn(x.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = turn(out[far])
    return out.astype(np.int64)


class Mix:
    """The plan of a mix: rows (one a document, without text), the sources' table, and the placed pieces."""

    def __init__(self, docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=1.5, block_words=256, shards=16, bucket_docs=2000, seed=11):
        ship(docs.sparkSession)
        spark, self.id_col = docs.sparkSession, id_col
        text = F.coalesce(F.col(text_col), F.lit(""))
        slim = cut(docs.select(F.col(id_col), F.col(source_col).alias("source"), n_words(text).alias("size"), F.xxhash64(F.col(id_col), text, F.col(source_col)).alias("key")))
        got = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()
        got.sort(key=lambda r: (r.source is None, r.source or ""))
        sizes = [r["size"] for r in got]
        aims = targets(sizes, [weights[i % len(weights)] for i in range(len(got))], share)
        self.sources = [(i, r.source, r["size"], float(t), -(-r.docs // bucket_docs)) for i, (r, t) in enumerate(zip(got, aims, strict=True))]
        names = spark.createDataFrame(self.sources, "sid int, source string, source_size long, target double, buckets int")
        # one row a source
        placed = slim.join(F.broadcast(names.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        placed = placed.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("buckets")))
        order = Window.partitionBy("sid", "bucket").orderBy(F.xxhash64("key"), "key")
        placed = placed.withColumn("rn", F.row_number().over(order)).withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        self.rows = cut(placed.drop("buckets"))
        per = self.rows.groupBy("sid", "bucket").agg(F.ceil(F.max("end") / block_words).alias("blocks"))
        base = per.withColumn("base", F.sum("blocks").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("blocks"))
        blocks = {r.sid: int(r.n) for r in per.groupBy("sid").agg(F.sum("blocks").alias("n")).collect()}
        n = np.array([blocks.get(s[0], 0) for s in self.sources], dtype=np.int64)
        slots = np.array([min(2 * b, round(b * s[3] / s[2])) if s[2] else 0 for b, s in zip(n, self.sources, strict=True)], dtype=np.int64)
        first, last = F.floor((F.col("end") - F.col("size")) / block_words), F.floor((F.col("end") - 1) / block_words)
        piece = self.rows.filter("size > 0").join(base.drop("blocks"), ["sid", "bucket"]).withColumn("b", F.explode(F.sequence(first, last)))
        begin = F.greatest(F.col("b") * block_words, F.col("end") - F.col("size"))
        self.blocks = piece.select("sid", (F.col("base") + F.col("b")).alias("block"), "bucket", "rn", (begin - (F.col("end") - F.col("size"))).alias("start"), (F.least((F.col("b") + 1) * block_words, "end") - begin).alias("words"))
        self.slots = self._slots(spark, n, slots, shards, seed)
        self.pieces = self.blocks.join(self.slots, ["sid", "block"])

    @staticmethod
    def _slots(spark, n: np.ndarray, slots: np.ndarray, shards: int, seed: int) -> DataFrame:
        """(sid, block, pass, shard, slot): every slot of the mix and the block that it takes."""
        counts = deal(slots, shards, seed)
        ends, by_shard, total = np.cumsum(slots), np.cumsum(counts, axis=0), int(slots.sum())
        start = np.cumsum(counts, axis=1) - counts  # of a source among its shard's slots
        plan = spark.sparkContext.broadcast((n, ends, by_shard, start, counts.sum(1)))

        def rows(batches):
            n, ends, by_shard, start, per_shard = plan.value
            for pdf in batches:
                g = pdf.id.to_numpy()
                sid = np.searchsorted(ends, g, side="right")
                j = g - np.where(sid > 0, ends[sid - 1], 0)
                block, shard, slot = np.empty_like(j), np.empty_like(j), np.empty_like(j)
                turn = j // n[sid]
                for s in np.unique(sid):
                    for t in np.unique(turn[sid == s]):
                        own = (sid == s) & (turn == t)
                        block[own] = permuted(j[own] % n[s], int(n[s]), seed + 1000003 * int(s) + int(t))
                    own = sid == s
                    shard[own] = np.searchsorted(by_shard[:, s], j[own], side="right")
                    place = j[own] - np.where(shard[own] > 0, by_shard[shard[own] - 1, s], 0)
                    slot[own] = start[shard[own], s] + place
                for h in np.unique(shard):
                    own = shard == h
                    slot[own] = permuted(slot[own], int(per_shard[h]), seed + 7919 * int(h))
                yield pd.DataFrame({"sid": sid.astype(np.int32), "block": block, "turn": turn.astype(np.int32), "shard": shard.astype(np.int32), "slot": slot})

        return spark.range(total).mapInPandas(rows, "sid int, block long, turn int, shard int, slot long")

    def taken(self) -> DataFrame:
        """Every row of the documents with the words that the mix takes of it."""
        sums = self.pieces.groupBy("sid", "bucket", "rn").agg(F.sum("words").alias("taken"))
        return self.rows.join(sums, ["sid", "bucket", "rn"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))

    def texts(self, docs: DataFrame, *, text_col="text", source_col="source", count_col: str | None = "n_chars") -> DataFrame:
        """The mix as documents: one row for each document and pass that takes any of its words. A pass that takes all of them
        keeps the text as it is; else its runs of words are cut out whole and joined by a newline.

        Texts are shuffled once, to what is taken of them. Only rows that repeat (id, text and source alike) go again, numbered
        so that each takes a share of its own."""
        columns, word = docs.columns, re.compile(r"[^\x20\x09-\x0D]+")
        key, size, turns, at = unused(columns, "key", "size", "turns", "at")
        place = ["sid", "bucket", "rn"]
        runs = self.pieces.groupBy(*place, "turn").agg(F.collect_list(F.struct("start", "words")).alias("runs"))
        passes = runs.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("turn", "runs"))).alias("turns"))
        alike = Window.partitionBy("key")
        each = self.rows.withColumns({"n": F.count(F.lit(1)).over(alike), "twin": F.row_number().over(alike.orderBy(*place))})
        each = cut(each.join(passes, place, "left").filter("n > 1 OR turns IS NOT NULL").select(F.col("key").alias(key), "n", F.col("twin").alias(at), F.col("size").alias(size), F.col("turns").alias(turns)))
        own = docs.withColumn(key, F.xxhash64(F.col(self.id_col), F.coalesce(F.col(text_col), F.lit("")), F.col(source_col)))
        told = own.join(each.filter("n = 1").drop("n", at), key).select(*columns, size, turns)
        again = each.filter("n > 1").drop("n")
        if not again.isEmpty():
            twins = own.join(again.select(key).distinct(), key, "left_semi").withColumn(at, F.row_number().over(Window.partitionBy(key).orderBy(key)))
            told = told.unionByName(twins.join(again.filter(F.col(turns).isNotNull()), [key, at]).select(*columns, size, turns))

        def cut_out(text, size, runs):
            runs = sorted((int(r["start"]), int(r["start"]) + int(r["words"])) for r in runs)
            if sum(b - a for a, b in runs) == size:
                return text
            at, parts = [m.span() for m in word.finditer(text)], []
            for a, b in runs:
                if parts and parts[-1][1] == a:
                    parts[-1][1] = b
                else:
                    parts.append([a, b])
            return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in parts)

        def rows(batches):
            for pdf in batches:
                out = pdf.iloc[np.repeat(np.arange(len(pdf)), [len(t) for t in pdf[turns]])].copy()
                out[text_col] = [cut_out(t, s, r) for t, s, passes in zip(pdf[text_col], pdf[size], pdf[turns], strict=True) for r in (p["runs"] for p in passes)]
                if count_col in columns:
                    out[count_col] = out[text_col].str.len()
                yield out[columns]

        return told.mapInPandas(rows, docs.schema)
