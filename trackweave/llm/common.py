"""Shared parts: the folder all machines see, materialised tables, and vectorised word hashing.

A word's hash is a polynomial over random 64-bit codes of its bytes, taken for all words of a buffer
at once from one wrapping prefix sum, then mixed. A-Z carry the codes of a-z, so lower-casing is free.
Two different words share a hash with a probability of about 2**-60.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 17

_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where that is unset, a folder of our own."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _made:
        _made[key] = "file://" + tempfile.mkdtemp(prefix="trackweave-")
    return _made[key]


class Workspace:
    """Tables written once to the shared folder: they cut lineage and survive lost executors.

    An operator drops the tables that its result does not read. Those that the result reads lazily stay, under <name>-<id>, until whoever
    owns the folder removes them after the result is written; nothing else refers to them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{tag}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{tag}")

    def drop(self, *tags: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for tag in tags:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tag}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def aside(docs: DataFrame, added: list[str], *names: str) -> tuple[DataFrame, list[str]]:
    """docs, and the columns `names` in it, with room for the columns `added`.

    A column of docs that bears the name of an added one (in any case) stays, as <name>_in, or with more _in where that is taken as well.
    """
    taken, moved = {c.lower() for c in [*docs.columns, *added]}, {}
    for c in docs.columns:
        if c.lower() in {a.lower() for a in added}:
            new = c + "_in"
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
            moved[c] = new
    return docs.toDF(*[moved.get(c, c) for c in docs.columns]), [moved.get(n, n) for n in names]


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, step, zero: Column, kind: str, block: int = 128) -> Column:  # noqa: ANN001
    """For each element of an array the fold of those before it, block by block: an array that grows by one element costs its length each time."""

    def scan(part: Column, start: Column) -> Column:
        first = F.struct(start.cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(part, first, lambda s, x: F.struct(step(s["at"], x).cast(kind).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    def whole(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda k: F.slice(v, k * block + 1, F.lit(block)))
        fold = lambda b: F.transform(b, lambda x: F.aggregate(x, zero.cast(kind), lambda a, y: step(a, y).cast(kind)))
        return let(cut, lambda b: F.flatten(F.zip_with(b, scan(fold(b), zero), scan)))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast(f"array<{kind}>")))


def spliced(text: Column, spans: Column, mask, block: int = 128) -> Column:  # noqa: ANN001
    """text with spans (start, end; sorted by start, code points, maybe overlapping) replaced; mask(length, fresh) of what a span adds to those before it.

    fresh: text stands between the span and those before it, or it is the first. Spans are taken in blocks, and a block's part of the text once.
    """

    def whole(own: Column) -> Column:
        items = F.zip_with(own, running(F.transform(own, lambda s: s["end"]), F.greatest, F.lit(0), "int"), lambda s, at: F.struct(s["start"].alias("start"), F.greatest(s["end"], at).alias("end"), at.alias("at")))

        def each(b: Column) -> Column:
            first = b[0]["at"]
            part = F.substring(text, first + 1, F.element_at(b, -1)["end"] - first)

            def piece(local: Column, x: Column) -> Column:
                kept = F.substring(local, x["at"] - first + 1, F.greatest(x["start"] - x["at"], F.lit(0)))
                return F.concat(kept, mask(x["end"] - F.greatest(x["start"], x["at"]), (x["start"] > x["at"]) | (x["at"] == 0)))

            return let(part, lambda local: F.array_join(F.transform(b, lambda x: piece(local, x)), ""))

        cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda k: F.slice(v, k * block + 1, F.lit(block)))
        return let(items, lambda v: F.concat(F.array_join(F.transform(cut(v), each), ""), F.substring(text, F.element_at(v, -1)["end"] + 1, F.length(text))))

    return let(spans, lambda own: F.when(F.size(own) > 0, whole(own)).otherwise(text))


def batches(spark: SparkSession) -> None:
    """Small Arrow batches: long texts make rows large. The two settings stay changed in the session, as plans read them when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def held_out(column: str, folds: int, fold: int):
    """True where crc32 of the id as text falls on the fold; a null id counts as crc32 of ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(folds)) == fold


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    code = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    code[65:91] = code[97:123]
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return code, space


BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class WordHasher:
    """Words `[^\\x20\\x09-\\x0D]+` of lower-cased (A-Z) texts, as 64-bit hashes; or, plain, words of ASCII letters, digits and non-ASCII bytes.

    After a call, data, starts and stops are the bytes of all texts and the bounds of each word in them.
    """

    def __init__(self, plain: bool = False) -> None:
        self.code, self.space = _code_tables()
        if plain:
            self.space[:128] = [not chr(b).isalnum() for b in range(128)]
        self.words = bytes((~self.space).astype(np.uint8))
        self.up = self.down = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up, self.down = (np.full(n, x, dtype=np.uint64) for x in (BASE, BASE_INVERSE))
                self.up[0] = self.down[0] = 1
                np.multiply.accumulate(self.up, out=self.up)
                np.multiply.accumulate(self.down, out=self.down)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Bounds of chunks of about CHUNK bytes that cut no word."""
        at, end = 0, len(data)
        while at < end:
            to = min(at + CHUNK, end)
            if to < end:
                edge = int(offsets[np.searchsorted(offsets, to, "right") - 1])
                gaps = np.flatnonzero(self.space[data[max(at, to - 4096) : to]])
                cut = max(edge, max(at, to - 4096) + int(gaps[-1]) + 1 if len(gaps) else 0)
                if cut <= at:
                    after = np.flatnonzero(self.space[data[to:]][: 1 << 26])
                    cut = min(int(offsets[np.searchsorted(offsets, to)]), to + int(after[0]) if len(after) else end)
                to = cut
            yield at, to
            at = to

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and n + 1 offsets into them by text."""
        data, offsets = text_buffer(column)
        hashes, firsts, lasts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in self.pieces(data, offsets):
            part = data[a:b]
            word = np.frombuffer(part.tobytes().translate(self.words), dtype=bool)
            edge = np.zeros(b - a + 1, dtype=bool)
            inner = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)]
            edge[inner - a] = True
            edge[0] = edge[-1] = True
            before = np.concatenate([[False], word[:-1]])
            after = np.concatenate([word[1:], [False]])
            start = np.flatnonzero(word & (~before | edge[:-1]))
            stop = np.flatnonzero(word & (~after | edge[1:])) + 1
            self._powers(b - a + 1)
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.code[part] * self.up[: b - a])])
                hashes.append(mix((total[stop] - total[start]) * self.down[start] + (stop - start).astype(np.uint64)))
            firsts.append(start + a)
            lasts.append(stop + a)
        self.data, self.starts, self.stops = data, np.concatenate(firsts), np.concatenate(lasts)
        return np.concatenate(hashes), np.searchsorted(self.starts, offsets)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, label: str, per_class: dict[int, int], folds: int, fold: int) -> DataFrame:
    """Rows of docs, and tw_label, for a bounded sample of labelled ids off the fold: per class the first ids by hash.

    An id with several labels counts with its greatest, an id with several rows with its least text (and, of these, least other columns).
    """
    own = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(id_col, folds, fold))
    own = own.groupBy(F.col(id_col).alias("tw_id")).agg(F.max(label).alias("tw_label"))
    first = None
    for value, most in per_class.items():
        part = own.where(F.col("tw_label") == value).orderBy(F.xxhash64("tw_id"), "tw_id").limit(most)
        first = part if first is None else first.unionAll(part)
    met = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).join(F.broadcast(first), F.col(f"c{docs.columns.index(id_col)}") == F.col("tw_id"))
    one = met.groupBy("tw_id", "tw_label").agg(F.min(F.struct(*[f"c{i}" for i in range(len(docs.columns))])).alias("one"))
    return one.select("one.*", "tw_label").toDF(*docs.columns, "tw_label")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights and, last, the bias of a ridge logistic regression, by damped Newton steps."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, weight = np.zeros(x1.shape[1]), np.ones(len(x)) if weight is None else weight
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (weight * (p - y)) + pull * w
        hess = (x1 * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 10 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
