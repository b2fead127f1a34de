"""Embedding near-duplicates by sorted projection passes.

Equal vectors are collapsed first and count by their number. A pass orders all classes lexicographically by concatenated random hashes and compares each
with its neighbours within about WINDOW places (cosine at least the threshold, in double precision). The first hashes are the turns of a
random projection tree: at each node the difference of two random vectors there, cut at the node's median, from a sample of bounded size; the
others are signs of random projections, taken from the centre of the vector's part of the tree. So a crowded region is cut as finely as the rest: in
a cone of vectors signs around the origin would all be equal. A task sends a spanning forest of the links it sees, never pairs.

PASSES passes are a round. Rounds go on while the last one united more than SETTLED of all unions so far; how many they are follows from how crowded the
vectors are. If rounds have compared as many pairs as there are before that, all pairs are compared, in blocks of about BLOCK bytes, so that
small or very dense tables are exact. Links are counted exactly within a component, in the same blocks: work that grows with the square of a component.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own component;
vectors of different lengths never link; equal rows are linked copies; a null id takes its component's least id and is never kept;
an empty table gives an empty table; the result has the id and the columns below, whatever other columns there are (an id column named as one of
them is returned as <name>_in).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm.common import Workspace, batches
from trackweave.llm.components import components

THRESHOLD, BLOCK, TILE = 0.9, 16 << 20, 1024
WINDOW, PASSES, SETTLED = 256, 8, 0.001
SAMPLE, SAMPLE_BYTES, DEPTH, SIGNS = 4096, 16 << 20, 10, 40


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Hashes:
    """The hashes of a pass, for vectors of one length: a tree of projections from a sample (maybe empty), then signs of projections."""

    def __init__(self, sample: np.ndarray, d: int, seed: int):
        rng = np.random.default_rng([seed, d])
        self.depth = min(DEPTH, max(0, int(np.log2(max(1, len(sample) / 4)))))
        self.high = min(self.depth, 6)
        self.turns, self.cuts = rng.standard_normal(((1 << self.depth) - 1, d)), np.zeros((1 << self.depth) - 1)
        self.centre, node = np.zeros((1 << self.high, d)), np.zeros(len(sample), np.int64)
        for level in range(self.depth + 1):
            parts = [np.flatnonzero(node == k) for k in range(1 << level)]
            if level == self.high:
                for k, own in enumerate(parts):
                    self.centre[k] = sample[own].mean(0) if len(own) else 0
            if level == self.depth:
                break
            for k, own in enumerate(parts):
                at = (1 << level) - 1 + k
                if len(own) > 1:
                    i, j = rng.choice(own, 2, replace=False)
                    if (sample[i] != sample[j]).any():
                        self.turns[at] = sample[i] - sample[j]
                    side = sample[own] @ self.turns[at]
                    self.cuts[at] = np.median(side)
                    node[own] = 2 * k + (side > self.cuts[at])
                else:
                    node[own] = 2 * k
        self.planes = rng.standard_normal((d, SIGNS))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for lo in range(0, len(x), 4096):
            part, node = x[lo : lo + 4096], np.zeros(len(x[lo : lo + 4096]), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (np.einsum("nd,nd->n", part, self.turns[at]) > self.cuts[at])
            signs = ((part - self.centre[node >> (self.depth - self.high)]) @ self.planes > 0) @ (1 << np.arange(SIGNS)[::-1])
            out.append(node << SIGNS | signs)
        return np.concatenate(out)


def united(near: np.ndarray, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what links in a tile (rows a, columns b); root names each row's tree and is brought up to date."""
    edges = []
    while True:
        near = near & (root[a][:, None] != root[b][None, :])
        rows = np.flatnonzero(near.any(axis=1))
        if not len(rows):
            return edges
        for i, j in zip(a[rows].tolist(), b[near[rows].argmax(axis=1)].tolist(), strict=True):
            x, y = i, j
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                edges.append((i, j))
                root[y] = x
        while (root[root] != root).any():
            root[:] = root[root]


def windowed(x: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows at most WINDOW places apart (and some a little further)."""
    root, edges = np.arange(len(x)), []
    for lo in range(0, len(x), WINDOW):
        a, b = np.arange(lo, min(lo + WINDOW, len(x))), np.arange(lo, min(lo + 2 * WINDOW, len(x)))
        near = x[a] @ x[b].T >= threshold
        near[:, : len(a)] &= np.tri(len(a), k=-1, dtype=bool)
        if near.any():
            edges += united(near, a, b, root)
    return edges


def met(x: np.ndarray, m: np.ndarray, first: int, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each row, and a spanning forest of them; the first `first` rows meet the others, or, where there are no others, each other."""
    links, root, edges = np.zeros(len(x), np.int64), np.arange(len(x)), []
    for lo in range(0, first, TILE):
        a = np.arange(lo, min(lo + TILE, first))
        for start in range(first if first < len(x) else lo, len(x), TILE):
            b = np.arange(start, min(start + TILE, len(x)))
            near = x[a] @ x[b].T >= threshold
            if start == lo:
                near = np.tri(len(a), k=-1, dtype=bool) & near
            if near.any():
                links[a] += near @ m[b]
                links[b] += near.T @ m[a]
                edges += united(near, a, b, root)
    return links, edges


def compared(table: pa.Table, threshold: float) -> pa.Table:
    """Two blocks (own, lo, hi) of classes, or one with itself: links by class, and a spanning forest of them."""
    table = table.combine_chunks()
    own, lo, c, m, d = (table[x].to_numpy() for x in ("own", "lo", "c", "m", "d"))
    order = np.argsort(own != lo, kind="stable")
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d[0])
    return forest(c[order], *met(unit(flat[order]), m[order], int((own == lo).sum()), threshold))


def forest(c: np.ndarray, links: np.ndarray, edges: list[tuple[int, int]]) -> pa.Table:
    found, pairs = np.flatnonzero(links), np.array(edges, np.int64).reshape(-1, 2)
    none = lambda k: pa.nulls(k, pa.int64())
    return pa.table({
        "a": pa.concat_arrays([pa.array(c[found]), pa.array(c[pairs[:, 0]])]),
        "b": pa.concat_arrays([none(len(found)), pa.array(c[pairs[:, 1]])]),
        "links": pa.concat_arrays([pa.array(links[found]), none(len(pairs))]),
    })


def blocked(rows: DataFrame, size: str, group: list[str]) -> DataFrame:
    """rows (c, m, d, v) once for each pair of blocks that its own block is in; size: how many rows its group has."""
    each = rows.withColumn("blocks", F.ceil(F.col(size) * 8.0 * F.col("d") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return each.select(*(g for g in group if g != "d"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "c", "m", "d", "v")


def passed(spark: SparkSession, classes: DataFrame, sample: dict[int, np.ndarray], seeds: list[int], blocks: int, threshold: float) -> DataFrame:
    """Edges (a, b) of a round: passes with these seeds."""
    spread = min(blocks, max(1, max(map(len, sample.values()), default=1) // 8))
    more = max(0, int(np.ceil(np.log2(max(1, blocks / spread)))))  # beyond the sample's resolution, blocks are cut by the next signs
    sent = spark.sparkContext.broadcast(sample)

    def keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple, tuple] = {}
        for batch in parts:
            dims = batch.column("d").to_numpy()
            for d in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == d))
                x = unit(own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                for seed in seeds:
                    if (seed, d) not in made:
                        base = sent.value.get(d, np.zeros((0, d)))
                        hashes = Hashes(base, d, seed)
                        keys = np.sort(hashes(base))
                        made[seed, d] = hashes, keys[len(keys) * np.arange(1, spread) // spread] if len(keys) else keys
                    hashes, cuts = made[seed, d]
                    key = hashes(x)
                    block = np.searchsorted(cuts, key, "right") << more | (key & ((1 << SIGNS) - 1)) >> (SIGNS - more)
                    told = [np.full(len(key), seed, np.int32), block.astype(np.int64), key]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, told), own.column("c"), own.column("d"), own.column("v")], names=["pass", "block", "key", "c", "d", "v"])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        d, order = table["d"][0].as_py(), np.lexsort((table["c"].to_numpy(), table["key"].to_numpy()))
        x = unit(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)[order])
        pairs, c = np.array(windowed(x, threshold), np.int64).reshape(-1, 2), table["c"].to_numpy()[order]
        return pa.table({"a": c[pairs[:, 0]], "b": c[pairs[:, 1]]})

    rows = classes.select("c", "d", "v").mapInArrow(keyed, "pass int, block long, key long, c long, d int, v array<double>")
    return rows.groupBy("d", "pass", "block").applyInArrow(run, "a long, b long")


def counted(rows: DataFrame, threshold: float, small: int) -> DataFrame:
    """(c, links) of classes that have links: rows (root, k: classes of it, c, m, d, v), all pairs of each component.

    Components of at most `small` bytes are dealt to tasks by hash, several to one; larger ones by pairs of blocks.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(parts)).combine_chunks()
        root, c, m, d = (table[x].to_numpy() for x in ("root", "c", "m", "d"))
        at, flat = np.concatenate([[0], np.cumsum(d)]), table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(root, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(root[order]) != 0, [True]]))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own = order[lo:hi]
            x = unit(np.stack([flat[at[i] : at[i + 1]] for i in own]))
            links = np.zeros(len(own), np.int64)
            for k in range(0, len(own), TILE):
                links[k : k + TILE] = (x[k : k + TILE] @ x.T >= threshold) @ m[own] - m[own][k : k + TILE]
            yield pa.RecordBatch.from_arrays([pa.array(c[own]), pa.array(links)], names=["c", "links"])

    few = rows.where(F.col("k") * F.col("d") * 8 <= small)
    total = F.pmod(F.xxhash64("root"), F.lit(1 << 16))
    one = few.withColumn("task", total).groupBy("task").applyInArrow(run, "c long, links long")
    many = blocked(rows.where(F.col("k") * F.col("d") * 8 > small), "k", ["root"]).groupBy("root", "lo", "hi").applyInArrow(lambda t: compared(t, threshold), "a long, b long, links long")
    return one.unionAll(many.where("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links")))


def near_duplicates(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component, kept) for each row."""
    batches(spark)
    work = Workspace(spark, "neardup")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", sound).withColumn("c", F.when(F.col("sound"), F.xxhash64("v")))
    good = rows.where("sound")
    classes = work.write(good.groupBy("c").agg(F.count("*").alias("m"), F.min("id").alias("rep"), F.first("v").alias("v")).withColumn("d", F.size("v")), "classes")
    n, size = classes.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0)) * 8).first()
    some = classes.orderBy(F.xxhash64("c", F.lit(7)), "c").limit(max(64, min(SAMPLE, SAMPLE_BYTES * n // max(1, size)))).select("d", "v").toPandas()
    sample = {int(d): unit(np.stack(list(own["v"]))) for d, own in some.groupby("d")}
    edges, done, unions = None, 0, 0
    while True:
        found = work.write(passed(spark, classes, sample, list(range(done, done + PASSES)), max(1, -(-int(size) // BLOCK)), threshold), f"passes{done}")
        done += PASSES
        named = components(work, found if edges is None else edges.unionAll(found), f"c{done}")
        edges = named.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        now = edges.count()
        settled, unions = now - unions <= SETTLED * now, now
        if settled or n <= WINDOW:
            break
        if 3 * WINDOW * done >= n:  # a pass compares a class with one and a half windows
            pairs = blocked(classes.withColumn("n", F.lit(n)), "n", ["d"]).groupBy("d", "lo", "hi").applyInArrow(lambda t: compared(t, threshold), "a long, b long, links long")
            named = components(work, edges.unionAll(work.write(pairs.where("b is not null").select("a", "b"), "all")), "call")
            break
    members = work.write(classes.join(named, F.col("c") == F.col("node")).select("c", "rep", "m", "v", "d", "root"), "members")
    sizes = work.write(members.groupBy(F.col("root").alias("root2")).agg(F.min("rep").alias("component"), F.count("*").alias("k")), "sizes")
    told = members.join(sizes, F.col("root") == F.col("root2"))
    links = counted(told.select("root", "k", "c", "m", "d", "v"), threshold, BLOCK)
    told = told.select(F.col("c").alias("c2"), "component").join(links.withColumnRenamed("c", "c3"), F.col("c2") == F.col("c3")).select("c2", "component", "links")
    full = work.write(classes.join(told, F.col("c") == F.col("c2"), "left").select(F.col("c").alias("c4"), "m", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "full")
    work.drop(*(f"passes{k}" for k in range(0, done, PASSES)), "members", "sizes", "classes", "all")
    linked = good.select("id", "c").join(full, F.col("c") == F.col("c4")).select("id", (F.col("m") - 1 + F.col("links")).cast("long").alias("n_links"), "component")
    out = linked.unionAll(rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    out = out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
    return out.withColumnRenamed("id", id_col if id_col.lower() not in ("n_links", "component", "kept") else id_col + "_in")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("component", "component_id")
