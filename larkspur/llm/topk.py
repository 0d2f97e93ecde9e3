"""Exact top-k inner-product search through a pivot-distance index.

Integer vectors are lifted onto a sphere (one more coordinate makes every norm the largest one), where a larger inner
product with a query is a smaller distance. Each vector is keyed by its nearest pivot and its distance to it; a cell's
vectors, sorted by that distance, form annuli of at most `block_rows` rows. Blocks of queries meet only the annuli that
the triangle inequality cannot rule out, nearest first, and stop when no later annulus can hold a better vector.

Scale: pivots and first bounds come from a sample of at most `sample_rows` vectors (documented bound; it only sets how
much is pruned, never what is found). Every row is indexed. Nothing but the sample and four statistics reaches the
driver; a task holds one block of queries, one annulus and k results a query. An annulus is cut by rows, so a cell that
holds a third of all rows, or one vector repeated, is many blocks; these are dealt over stripes of about `stripe_rows` rows.
Vectors are quantized and written once, and travel as the narrowest integers that hold them.

Cases: vectors that are null or hold null, NaN or infinite components take no part, nor do null ids. An id that repeats
counts once, with its smallest vector. Shorter vectors count as padded with zeros; an empty one is all zeros. Ties go to
the smaller id. Fewer than k other rows: all of them. An empty table gives an empty result. Sums are 64-bit integers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import cut, ship

STRIPES = 8
#: (largest component, SQL type, numpy type)
KINDS = [(2**15 - 1, "smallint", "<i2"), (2**31 - 1, "int", "<i4"), (2**63 - 1, "bigint", "<i8")]
LOW = np.iinfo(np.int64).min
SCHEMA = "query_id long, rank int, vec_id long, score long"


def quantize(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(id long, v array<long>): floor(scale * x) of every usable vector."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(x.isNotNull() & finite & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * float(scale))).alias("v"))


def matrix(vs, dim: int) -> np.ndarray:
    out = np.zeros((len(vs), dim), dtype=np.int64)
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out


def choose_pivots(sample: np.ndarray, lifted: np.ndarray, n: int) -> np.ndarray:
    """Rows of `sample` that lie far from each other: each next one is the farthest from those chosen."""
    full = np.column_stack([sample.astype(float), lifted])
    picks, best = [0], np.full(len(full), np.inf)
    while len(picks) < min(n, len(full)):
        best = np.minimum(best, ((full - full[picks[-1]]) ** 2).sum(1))
        if best.max() <= 0:
            break
        picks.append(int(best.argmax()))
    return np.array(picks)


def product(a: np.ndarray, b: np.ndarray, small: bool) -> np.ndarray:
    """a @ b.T, exactly. small: every sum fits in a double's 53 bits."""
    return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64) if small else a.astype(np.int64) @ b.astype(np.int64).T


class Geometry:
    """What tasks need to know of the space; a few hundred rows, made on the driver from the sample."""

    def __init__(self, sample_ids, sample, top_norm: float, dim: int, pivots: int, small: bool, kind: str):
        self.norm, self.dim, self.small, self.kind = float(top_norm), dim, small, kind
        self.sample_ids, self.sample = sample_ids, sample
        lifted = np.sqrt(np.maximum(self.norm - (sample.astype(float) ** 2).sum(1), 0))
        picks = choose_pivots(sample, lifted, pivots)
        self.pivots, self.pivot_lift = sample[picks], lifted[picks]

    def from_vectors(self, x: np.ndarray) -> np.ndarray:
        """Distances of indexed vectors to the pivots; both lie on the sphere."""
        lift = np.sqrt(np.maximum(self.norm - (x.astype(float) ** 2).sum(1), 0))
        near = x.astype(float) @ self.pivots.astype(float).T + np.outer(lift, self.pivot_lift)
        return np.sqrt(np.maximum(2 * self.norm - 2 * near, 0))

    def from_queries(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries, whose further coordinate is zero."""
        own = (q.astype(float) ** 2).sum(1)[:, None]
        return np.sqrt(np.maximum(own + self.norm - 2 * (q.astype(float) @ self.pivots.astype(float).T), 0))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a vector has `score`; infinite where there is none yet."""
        own = (q.astype(float) ** 2).sum(1)
        return np.where(score == LOW, np.inf, np.sqrt(np.maximum(own + self.norm - 2 * score.astype(float), 0)))

    def vectors(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind).reshape(-1, self.dim)

    @property
    def slack(self) -> float:
        return 1e-6 * (1 + np.sqrt(self.norm))


def assigner(geometry):
    def assign(batches):
        g = geometry.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = matrix(pdf.v, g.dim)
            d = g.from_vectors(x)
            cell = d.argmin(1)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "r": d[np.arange(len(x)), cell], "id": pdf.id, "vec": [row.tobytes() for row in x.astype(g.kind)]})

    return assign


def annuli(geometry, block_rows: int):
    def pack(batches):
        held: list[pd.DataFrame] = []

        def emit(pdf):
            for at in range(0, len(pdf), block_rows):
                part = pdf.iloc[at : at + block_rows]
                yield (int(part.cell.iloc[0]), float(part.r.iloc[0]), float(part.r.iloc[-1]), int(part.id.iloc[0]), part.id.to_numpy(np.int64).tobytes(), b"".join(part.vec))

        def rows(done: bool):
            pdf = pd.concat(held, ignore_index=True)
            held.clear()
            for _, own in pdf.groupby("cell", sort=True):
                keep = 0 if done or own.cell.iloc[0] != pdf.cell.iloc[-1] else len(own) % block_rows
                if keep:
                    held.append(own.iloc[len(own) - keep :])
                    own = own.iloc[: len(own) - keep]
                yield from emit(own)

        columns = ["cell", "r_lo", "r_hi", "block", "ids", "vecs"]
        for pdf in batches:
            if len(pdf):
                held.append(pdf)
                if sum(map(len, held)) >= block_rows and (out := list(rows(False))):
                    yield pd.DataFrame(out, columns=columns)
        if held and (out := list(rows(True))):
            yield pd.DataFrame(out, columns=columns)

    return pack


def query_blocks(geometry, block_rows: int, k: int):
    """Blocks of queries with, for each cell, the range of distances to its pivot and the range within which a result can lie."""

    def one(part, g):
        ids, x = part.id.to_numpy(np.int64), g.vectors(b"".join(part.vec))
        s = product(x, g.sample, g.small)
        s[ids[:, None] == g.sample_ids[None, :]] = LOW
        first = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(x), LOW)
        d, reach = g.from_queries(x), (g.reach(x, first) + g.slack)[:, None]
        return {"qb": int(ids[0]), "ids": ids.tobytes(), "vecs": x.tobytes(), "first": first.tobytes(), "d_lo": d.min(0), "d_hi": d.max(0), "lo": (d - reach).min(0), "hi": (d + reach).max(0)}

    def pack(batches):
        g, held = geometry.value, []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= block_rows:
                pdf = pd.concat(held, ignore_index=True)
                full = len(pdf) // block_rows * block_rows
                held = [pdf.iloc[full:]]
                yield pd.DataFrame([one(pdf.iloc[at : at + block_rows], g) for at in range(0, full, block_rows)])
        if sum(map(len, held)):
            yield pd.DataFrame([one(pd.concat(held, ignore_index=True), g)])

    return pack


class Best:
    """The k best of each query in a block, by (score, smaller id)."""

    def __init__(self, ids, first, k):
        self.ids, self.k = ids, k
        self.score, self.id = np.full((len(ids), k), LOW), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.bound = first.copy()  # the k-th score so far, or a bound on it from the sample

    def add(self, rows, ids, scores):
        """rows: of this block's queries; scores: one row for each of them."""
        bound, last = self.bound[rows][:, None], self.id[rows, -1][:, None]
        full = (self.score[rows, -1] == self.bound[rows])[:, None]
        ok = (scores > bound) | ((scores == bound) & (~full | (ids[None, :] < last)))
        ok &= self.ids[rows][:, None] != ids[None, :]
        at, col = np.nonzero(ok)
        if not len(at):
            return
        touched = np.unique(at)
        own = rows[touched]
        who = np.concatenate([rows[at], np.repeat(own, self.k)])
        what = np.concatenate([ids[col], self.id[own].ravel()])
        score = np.concatenate([scores[at, col], self.score[own].ravel()])
        order = np.lexsort((what, -np.maximum(score, LOW + 1), who))
        who, what, score = who[order], what[order], score[order]
        start = np.searchsorted(who, own)
        pick = start[:, None] + np.arange(self.k)[None, :]
        self.score[own], self.id[own] = score[pick], what[pick]
        self.bound[own] = np.maximum(self.bound[own], self.score[own, -1])

    def rows(self):
        at, col = np.nonzero(self.score != LOW)
        return pd.DataFrame({"query_id": self.ids[at], "vec_id": self.id[at, col], "score": self.score[at, col]})


def searcher(geometry, k: int):
    def search(batches):
        g, best, key = geometry.value, None, None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.gap < 0:  # a block of queries, before its annuli
                    if best is not None:
                        yield best.rows()
                    ids = np.frombuffer(r.ids, np.int64)
                    q = g.vectors(r.vecs)
                    best, key, d = Best(ids, np.frombuffer(r.first, np.int64), k), (r.qb, r.stripe), g.from_queries(q)
                    continue
                assert key == (r.qb, r.stripe)
                reach = g.reach(q, best.bound) + g.slack
                if r.gap > reach.max():
                    continue  # sorted by gap: no later annulus of this block is nearer
                own = d[:, r.cell]
                rows = np.nonzero(np.maximum(r.r_lo - own, own - r.r_hi) <= reach)[0]
                if len(rows):
                    ids = np.frombuffer(r.ids, np.int64)
                    best.add(rows, ids, product(q[rows], g.vectors(r.vecs), g.small))
        if best is not None:
            yield best.rows()

    return search


def top_k(vectors: DataFrame, queries, k: int = 20, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, pivots: int = 64, sample_rows: int = 4096, block_rows: int = 1024, query_rows: int = 1024, stripe_rows: int = 1 << 20) -> DataFrame:
    """The k best rows of `vectors` for each row that the condition `queries` (on the column `id`) selects, itself excluded."""
    spark = vectors.sparkSession
    ship(spark)
    usable = quantize(vectors, id_col, vec_col, scale)
    # the largest norm and component over all usable rows; of rows that share an id too, as a larger sphere does no harm
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, size, top_norm, top = usable.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    dim, top, stripes_n = max(1, size), top or 0, max(STRIPES, -(-n // stripe_rows))
    sql, kind = next((sql, kind) for most, sql, kind in KINDS if top <= most)
    space = cut(usable.select("id", F.col("v").cast(f"array<{sql}>").alias("v")).groupBy("id").agg(F.min("v").alias("v")))
    sample = space.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    geometry = spark.sparkContext.broadcast(Geometry(sample.id.to_numpy(np.int64), matrix(sample.v, dim), top_norm, dim, pivots, dim * float(top) ** 2 < 2**52, kind))

    def keyed(rows):
        return rows.mapInPandas(assigner(geometry), "cell int, r double, id long, vec binary").repartitionByRange("cell", "r", "id").sortWithinPartitions("cell", "r", "id")

    index = keyed(space).mapInPandas(annuli(geometry, block_rows), "cell int, r_lo double, r_hi double, block long, ids binary, vecs binary")
    index = index.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes_n)).cast("int"))
    asked = cut(keyed(space.filter(queries)).mapInPandas(query_blocks(geometry, query_rows, k), "qb long, ids binary, vecs binary, first binary, d_lo array<double>, d_hi array<double>, lo array<double>, hi array<double>"))
    stripes = F.explode(F.sequence(F.lit(0), F.lit(stripes_n - 1))).alias("stripe")
    bounds = asked.select("qb", F.posexplode(F.arrays_zip("d_lo", "d_hi", "lo", "hi")).alias("cell", "b")).select("qb", "cell", "b.*", stripes)
    near = (
        index.join(bounds, ["cell", "stripe"])
        .filter((F.col("r_hi") >= F.col("lo")) & (F.col("r_lo") <= F.col("hi")))
        .select("qb", "stripe", F.greatest(F.lit(0.0), F.col("r_lo") - F.col("d_hi"), F.col("d_lo") - F.col("r_hi")).alias("gap"), "block", "cell", "r_lo", "r_hi", "ids", "vecs", F.lit(None).cast("binary").alias("first"))
    )
    heads = asked.select("qb", stripes, F.lit(-1.0).alias("gap"), F.col("qb").alias("block"), F.lit(-1).alias("cell"), F.lit(0.0).alias("r_lo"), F.lit(0.0).alias("r_hi"), "ids", "vecs", "first")
    found = near.unionByName(heads).repartition("qb", "stripe").sortWithinPartitions("qb", "stripe", "gap", "block").mapInPandas(searcher(geometry, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
