"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Distinct 64-bit fingerprints form a binary trie. Pairs of nodes are walked together: differing bits add up, and a pair is
dropped once they exceed the budget. The upper levels are walked by the cluster, several bits a round: a fingerprint sends
itself to the nodes that its budget still reaches, and nodes that are still heavy go another round. Below, a task walks one
node against itself and against what reached it. A task returns a spanning forest of its links, so a ball of near copies
costs its rows, not its pairs; connected components then run over the forests.

Cases: null or empty texts have fingerprint zero and link like any other. Equal fingerprints collapse before the join and
are linked by definition, whatever their number. Null ids take part; a component's id is its smallest non-null id. An
empty table gives an empty result. Whole texts count. Fingerprints that a thousandth of all rows share are fewer than HOT, so
their rows find their component by a broadcast; the rest meet theirs by a shuffle that no fingerprint weighs down."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import cut, ship, unused

BITS = 64
SEED = 42
HOT = 1024


def fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    parts = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
    h = np.array([hash_of(p, SEED) for p in parts], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, mark: Column | None = None) -> DataFrame:
    """(id, fp long, and `mark` as _mark where given) of every document."""
    ship(docs.sparkSession)
    marks = [] if mark is None else ["_mark"]

    def run(batches):
        for pdf in batches:
            yield pdf[[id_col, *marks]].assign(fp=[fingerprint(t, width) for t in pdf[text_col]])

    rows = docs.select(id_col, text_col, *[mark.alias(m) for m in marks])
    return rows.mapInPandas(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, " + "_mark string, " * len(marks) + "fp long")


def masks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(mask, its number of ones) of every mask of at most `budget` ones among `bits`."""
    return [(sum(1 << i for i in c), n) for n in range(budget + 1) for c in combinations(range(bits), n)]


def walk(a: np.ndarray, b: np.ndarray | None, budget: int, leaf: int = 32, room: int = 1 << 17):
    """Yield (i, j) arrays of positions in the sorted arrays a and b (None: a itself, i < j) that differ in at most `budget`
    bits, by walking both tries together. At most `room` node pairs are open in a chunk; the rest waits on a stack."""
    same, b = b is None, a if b is None else b
    if not len(a) or not len(b):
        return
    stack = [(0, np.array([[0, len(a), 0, len(b), 0]], dtype=np.int64))]
    while stack:
        level, pairs = stack.pop()
        if len(pairs) > room:
            stack.append((level, pairs[room:]))
            pairs = pairs[:room]
        small = ((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= leaf) if level < BITS else np.ones(len(pairs), dtype=bool)
        for at in range(0, small.sum(), room // leaf):
            done = pairs[small][at : at + room // leaf]
            if level < BITS or (done[:, 1] - done[:, 0] == 1).all():
                na, nb = done[:, 1] - done[:, 0], done[:, 3] - done[:, 2]
                n = na * nb
                which = np.repeat(np.arange(len(done)), n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i, j = done[which, 0] + k // nb[which], done[which, 2] + k % nb[which]
                ok = np.bitwise_count(a[i] ^ b[j]) <= budget
                if same:
                    ok &= i < j
                if ok.any():
                    yield i[ok], j[ok]
        pairs = pairs[~small]
        if not len(pairs):
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - level)
        mid_a, mid_b = split(a, pairs[:, 0], pairs[:, 1], bit, level), split(b, pairs[:, 2], pairs[:, 3], bit, level)
        d, out = pairs[:, 4], []
        for x0, x1, y0, y1, more in ((pairs[:, 0], mid_a, pairs[:, 2], mid_b, 0), (mid_a, pairs[:, 1], mid_b, pairs[:, 3], 0), (pairs[:, 0], mid_a, mid_b, pairs[:, 3], 1), (mid_a, pairs[:, 1], pairs[:, 2], mid_b, 1)):
            keep = (x1 > x0) & (y1 > y0) & (d + more <= budget)
            if same:
                keep &= x0 <= y0  # the other half of a node met with itself
            out.append(np.column_stack([x0, x1, y0, y1, d + more])[keep])
        stack.append((level + 1, np.concatenate(out)))


def split(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64, level: int) -> np.ndarray:
    """Where bit turns to one inside each range [lo, hi) of the sorted array a; a range shares all higher bits."""
    keep = ~((bit << np.uint64(1)) - np.uint64(1)) if level else np.uint64(0)
    return np.clip(np.searchsorted(a, (a[lo] & keep) | bit), lo, hi)


class Forest:
    """Union of positions; keeps the smallest position of each class."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.up[i], self.up[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while (self.up != self.up[self.up]).any():
                self.up = self.up[self.up]


def node_links(budget: int):
    """For one node: links within it, and from what reached it. Fingerprints come and go as signed longs."""

    def links(pdf):
        values = np.unique(pdf.fp.to_numpy(np.int64).view(np.uint64))
        inside = np.unique(pdf.fp.to_numpy(np.int64)[pdf.d.to_numpy() < 0].view(np.uint64))
        reached = np.unique(pdf.fp.to_numpy(np.int64)[pdf.d.to_numpy() >= 0].view(np.uint64))
        forest, at, other = Forest(len(values)), np.searchsorted(values, inside), np.searchsorted(values, reached)
        for i, j in walk(inside, None, budget):
            forest.join(at[i], at[j])
        for i, j in walk(reached, inside, budget):
            forest.join(other[i], at[j])
        leaf = np.nonzero(forest.up != np.arange(len(values)))[0]
        return pd.DataFrame({"a": values[leaf].view(np.int64), "b": values[forest.up[leaf]].view(np.int64)})

    return links


def links(distinct: DataFrame, n: int, budget: int = 2, heavy: int = 65536) -> DataFrame:
    """(a, b): links whose closure joins every two fingerprints of `distinct` (column fp) that differ in at most `budget` bits."""

    def spread(rows, upto: int, step: int):
        """Each row's next nodes: `step` more bits; d is -1 for a node's own rows, else the bits in which a visitor differs."""
        part = F.shiftrightunsigned("fp", BITS - upto - step).bitwiseAND(F.lit((1 << step) - 1)) if upto + step else F.lit(0)
        moves = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(c).alias("c")) for m, c in masks(step, budget)])
        out = rows.withColumn("part", part).withColumn("move", F.explode(moves))
        to, own = F.col("part").bitwiseXOR(F.col("move.mask")), F.col("d") < 0
        # a node's own rows visit only the sisters above them, so that each two meet once
        out = out.filter(F.when(own, to >= F.col("part")).otherwise(F.col("d") + F.col("move.c") <= budget))
        d = F.when(own & (F.col("move.c") == 0), F.lit(-1)).otherwise(F.greatest("d", F.lit(0)) + F.col("move.c")).cast("int")
        return out.select((F.shiftleft("node", step) + to).alias("node"), d.alias("d"), "fp")

    found = None
    bits = min(24, max(8, math.ceil(math.log2(max(1, n / 16384)))))
    upto, rows = bits, spread(distinct.select(F.lit(0).cast("long").alias("node"), F.lit(-1).alias("d"), "fp"), 0, bits)
    while True:
        crowded = rows.groupBy("node").count().filter(F.col("count") > heavy).select("node") if upto + 6 <= 60 else None
        over = cut(crowded) if crowded is not None else None
        again = over is not None and not over.isEmpty()
        here = rows.join(over, "node", "left_anti") if again else rows
        part = here.groupBy("node").applyInPandas(node_links(budget), "a long, b long")
        found = part if found is None else found.unionByName(part)
        if not again:
            return found
        rows = cut(spread(rows.join(over, "node", "left_semi"), upto, 6))
        upto += 6


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the least node of its component.

    Alternating large-star and small-star: every round a node's neighbours hang on its least neighbour. Rounds grow with the
    logarithm of the nodes; a hub is aggregated before it is shuffled and its rows meet its minimum in a join."""

    def star(e, both: bool):
        """e: (a > b). Hang the neighbours of each node on the least of them."""
        ends = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if both:
            ends = ends.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        met = ends.join(least, "u")
        if both:
            new = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            new = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return new.filter(F.col("a") != F.col("b")).distinct()

    def state(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    before = state(e)
    while before[0]:
        e = cut(star(star(e, True), False))
        now = state(e)
        if tuple(now) == tuple(before):
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2, mark: Column | None = None) -> DataFrame:
    """(id, fp, component_id, root, and `mark` as _mark where given) of every document; root is a fingerprint of the component
    that no other one has."""
    marked = cut(fingerprints(docs, id_col, text_col, width, mark))
    distinct = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("rows")))
    n, rows = distinct.agg(F.count(F.lit(1)), F.sum("rows")).first()
    joined = cut(components(links(distinct.select("fp"), n, budget)))
    classed = joined.join(distinct, joined.node == distinct.fp).select("fp", "root", "least")
    lowest = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = classed.join(lowest, "root").select("fp", "root", F.col("component_id").alias("linked"))
    ids = cut(distinct.join(linked, "fp", "left").select("fp", F.coalesce("linked", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"), (F.col("rows") * HOT > (rows or 0)).alias("hot")))
    hot = ids.filter("hot").select("fp", F.struct("component_id", "root").alias("_at"))  # fewer than HOT rows
    met = marked.join(F.broadcast(hot), "fp", "left")
    direct = met.filter("_at IS NOT NULL").select(*marked.columns, "_at.component_id", "_at.root")
    return direct.unionByName(met.filter("_at IS NULL").drop("_at").join(ids.drop("hot"), "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2) -> DataFrame:
    """(id, fingerprint hex, component_id): documents whose fingerprints are chained by at most `budget` differing bits."""
    return members(docs, id_col, text_col, width, budget).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component: that of the smallest id, or one without an id where no document has any.
    Of a component's rows that share this id, one stays; components that share it keep a row each. A row is known by 128 bits
    of hashes of its id and text: texts are shuffled by these once, for the join and for the choice among repeated rows."""
    key, at, one = unused(docs.columns, "key", "at", "one")
    mark = F.concat_ws(":", F.xxhash64(id_col, text_col), F.xxhash64(text_col, F.lit(1), id_col))
    first = F.min(F.struct(F.col(id_col).isNull(), id_col, "_mark"))["_mark"].alias(key)
    kept = members(docs, id_col, text_col, mark=mark).groupBy("root").agg(first).select(key)
    rows = docs.withColumn(at, mark)
    rows = rows.join(kept, F.col(at) == F.col(key), "left_semi")
    return rows.withColumn(one, F.row_number().over(Window.partitionBy(at).orderBy(at))).filter(F.col(one) == 1).select(docs.columns)
