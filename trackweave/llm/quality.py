"""Quality classifier by co-training of two views: a text's content, and its page metadata.

Content view: shares of byte values, and how long, varied and repetitive words, lines and shingles are. Metadata view: hashed source and language,
the stated length, and pairs of these. Each view has a logistic regression, calibrated on labelled rows that neither learns from. In each of ROUNDS rounds
each view looks through all documents for those it is surest of, by class: the ADDED first by how far their calibrated probability lies from the
labels' share, at least MARGIN in logits. The other view learns from them, with the calibrated probability as a soft label: a view that tells
little says little. At last the two calibrated views are combined on the rows kept for calibration.

The pool of pseudo-labels is the whole table: the content features of all documents are written once (in half precision, about 0.6 kB each) and read in
every round, where a task keeps its best ADDED rows of a view and class. Only labelled rows are a bounded sample: at most SAMPLE of each label. Documents of
equal features count once, and never if a labelled row of the sample has the same.

Defined cases: a null or empty text has the content of an empty one; null metadata is a value of its own; equal rows get equal scores; without
both labels every score is the labels' share (1 without labels: nothing is rejected); ties go by a hash of the features; an id with several labels has its
greatest, one with several rows is learnt from its least row; an empty table gives an empty table; other columns pass through (see `aside` for names that clash).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import Workspace, WordHasher, aside, batches, held_out, logistic, mix, sampled, sigmoid

SAMPLE, ROUNDS, ADDED, MARGIN = {0: 2000, 1: 3000}, 4, 200, 0.5
SOURCES, LANGS, PAIRS, REJECT = 64, 16, 64, 0.5


def text_view(hasher: WordHasher, column: pa.Array) -> np.ndarray:
    """A row of content features for each text."""
    hashes, at = hasher(column)
    n, data = len(column), hasher.data
    size = np.zeros(n)
    words = np.diff(at)
    filled = column.fill_null("").cast(pa.large_binary())
    size = np.array([len(x) for x in filled.to_pylist()], dtype=float) if n else size
    edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    counts = np.stack([np.bincount(data[edge[i] : edge[i + 1]], minlength=256) for i in range(n)]) if n else np.zeros((0, 256))
    share = counts / np.maximum(size, 1)[:, None]
    more = np.zeros((n, 8))
    for i in range(n):
        own, text = hashes[at[i] : at[i + 1]], data[edge[i] : edge[i + 1]].tobytes()
        lines = [x for x in text.split(b"\n") if x]
        more[i, 0] = len(np.unique(own)) / max(1, len(own))
        if len(own) >= 5:
            with np.errstate(over="ignore"):
                five = mix(sum(own[j : len(own) - 4 + j] * np.uint64(2 * j + 3) for j in range(5)))
            more[i, 1] = len(np.unique(five)) / len(five)
        else:
            more[i, 1] = 1
        more[i, 2] = len(set(lines)) / max(1, len(lines))
        more[i, 3] = max(map(len, lines), default=0) / max(1, len(text))
        more[i, 4] = np.log1p(len(lines))
    length = np.where(words > 0, (size - words) / np.maximum(words, 1), 0)
    more[:, 5], more[:, 6], more[:, 7] = np.log1p(words), length, np.log1p(size)
    groups = [share[:, 65:91].sum(1), share[:, 97:123].sum(1), share[:, 48:58].sum(1), share[:, 128:].sum(1), share[:, 33:48].sum(1) + share[:, 58:65].sum(1) + share[:, 91:97].sum(1) + share[:, 123:127].sum(1)]
    return np.concatenate([np.sqrt(share), more, more**2, np.stack(groups, 1), np.sqrt(np.stack(groups, 1))], axis=1)


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """A row of metadata features for each text."""
    out = np.zeros((len(source), SOURCES + LANGS + PAIRS + 14))
    known: dict[tuple, tuple] = {}
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        x = np.log10(1 + max(0, n)) if n is not None else 0
        size = min(11, int(2 * x))
        if (s, g, size) not in known:
            told = ["" if v is None else "=" + str(v) for v in (s, g)]
            place = lambda text, many: zlib.crc32(text.encode()) % many
            pairs = [place(f"{k} {a} {b}", PAIRS) for k, a, b in ((0, *told), (1, told[0], size), (2, told[1], size))]
            known[s, g, size] = (place(told[0], SOURCES), SOURCES + place(told[1], LANGS), SOURCES + LANGS + size, *(SOURCES + LANGS + 14 + p for p in pairs))
        out[i, known[s, g, size]] = 1
        out[i, SOURCES + LANGS + 12 : SOURCES + LANGS + 14] = (n is None, x / 3)
    return out


class Scaled:
    """A logistic regression on scaled features, with a calibration of its logits."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.dev = x.mean(0), np.maximum(x.std(0), 1e-3)
        weight = y * 0.5 / max(1e-9, y.mean()) + (1 - y) * 0.5 / max(1e-9, 1 - y.mean())
        self.w, self.calibration = logistic(self.scale(x), y, weight, ridge=5.0), np.array([1.0, 0.0])

    def scale(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.dev, -6, 6)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (self.scale(x) @ self.w[:-1] + self.w[-1]) * self.calibration[0] + self.calibration[1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.calibration = logistic(self.logit(x)[:, None], y, ridge=0.1)


class CoTrained:
    """Both views, and how they combine. told: of each round and view, how many rows of class 1 and 0 it labelled for the other."""

    def __init__(self, views: list[Scaled], mix_: np.ndarray, told: list[tuple[int, int, int, int]]):
        self.views, self.mix, self.told = views, mix_, told

    def __call__(self, xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined probability of quality, and each view's."""
        logits = [v.logit(x) for v, x in zip(self.views, xs, strict=True)]
        return sigmoid(np.stack(logits, 1) @ self.mix[:-1] + self.mix[-1]), sigmoid(logits[0]), sigmoid(logits[1])


def surest(views: list[Scaled], share: float, xs: list[np.ndarray], key: np.ndarray, added: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(view, class, rows, lifts): rows of distinct keys, at most `added` of each, by lift, then key."""
    out = []
    for k, view in enumerate(views):
        lift = view.logit(xs[k]) - np.log(share / (1 - share))
        for label, far in ((1, lift), (0, -lift)):
            own = np.flatnonzero(far >= MARGIN)
            own = own[np.lexsort((key[own], -far[own]))]
            own = own[np.sort(np.unique(key[own], return_index=True)[1])][:added]
            out.append((k, label, own, far[own]))
    return out


def co_train(labelled: list[np.ndarray], y: np.ndarray, draw, rounds: int = ROUNDS) -> CoTrained | float:  # noqa: ANN001
    """labelled: the two views' features. draw(views, share): for each (view, class) the pool's surest rows, as (view, class, both features).

    A plain share if there are not both labels.
    """
    fit, check = np.arange(len(y)) % 4 != 3, np.arange(len(y)) % 4 == 3
    if min(len(set(y[fit].tolist())), len(set(y[check].tolist()))) < 2:
        return float(y.mean()) if len(y) else 1.0
    learnt, told, share = [([x[fit]], [y[fit]]) for x in labelled], [], float(y[check].mean())
    for done in range(rounds + 1):
        views = [Scaled(np.concatenate(x), np.concatenate(t)) for x, t in learnt]
        for v, x in zip(views, labelled, strict=True):
            v.calibrate(x[check], y[check])
        if done == rounds:
            break
        count = {}
        for k, label, xs in draw(views, share):
            count[k, label] = len(xs[0])
            learnt[1 - k][0].append(xs[1 - k])
            learnt[1 - k][1].append(sigmoid(views[k].logit(xs[k])))
        told += [(done, k, count.get((k, 1), 0), count.get((k, 0), 0)) for k in (0, 1)]
        if not any(count.values()):
            break
    logits = np.stack([v.logit(x[check]) for v, x in zip(views, labelled, strict=True)], 1)
    return CoTrained(views, logistic(logits, y[check], ridge=0.5), told)


META = ["source", "lang", "n_chars"]


def features(docs: DataFrame) -> DataFrame:
    """docs (id, text, the metadata): id, content (features as bytes), the metadata, key (a hash of all features)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in parts:
            for lo in range(0, len(batch), 500):
                b = batch.slice(lo, 500)
                x = text_view(hasher, b.column(1)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), *b.columns[2:]], names=["id", "content", *META])

    schema = T.StructType([T.StructField("id", docs.schema[0].dataType), T.StructField("content", T.BinaryType()), *(T.StructField(c, docs.schema[c].dataType) for c in META)])
    return docs.mapInArrow(run, schema).withColumn("key", F.xxhash64("content", *META))


def unpacked(content: list, *meta: list) -> list[np.ndarray]:
    """Both views of written features."""
    rows = np.stack([np.frombuffer(x, np.float16) for x in content]).astype(float) if len(content) else np.zeros((0, 1))
    return [rows, meta_view(*meta)]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", folds: int = 5, fold: int = 0, sample: dict[int, int] = SAMPLE, added: int = ADDED, rounds: int = ROUNDS) -> CoTrained | float:  # noqa: B006
    batches(spark)
    work = Workspace(spark, "quality")
    pool = work.write(features(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *META)), "features")
    told = sampled(pool, labels.select(F.col(id_col).alias("id"), label), "id", label, sample, folds, fold).toPandas().sort_values(["key", "tw_label"], kind="stable")
    taken, listed = set(told["key"].tolist()), lambda d: [d[c].tolist() for c in ("content", *META)]
    names = ["view", "label", "lift", "key", "content", *META]
    schema = T.StructType([T.StructField("view", T.IntegerType()), T.StructField("label", T.IntegerType()), T.StructField("lift", T.DoubleType()), *(pool.schema[c] for c in names[3:])])

    def draw(views: list[Scaled], share: float) -> Iterator[tuple]:
        sent = spark.sparkContext.broadcast((views, share, np.sort(np.array(sorted(taken), np.int64))))

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, share, gone = sent.value
            best: dict[tuple, pa.Table] = {}
            for b in parts:
                key = b.column("key").to_numpy()
                for k, label, rows, far in surest(own, share, unpacked(*(b.column(c).to_pylist() for c in ("content", *META))), key, added + len(gone)):
                    keep = ~np.isin(key[rows], gone)
                    found = pa.table({"lift": far[keep], **{c: b.column(c).take(pa.array(rows[keep])) for c in names[3:]}})
                    met = pa.concat_tables([best[k, label], found]) if (k, label) in best else found
                    order = np.lexsort((met["key"].to_numpy(), -met["lift"].to_numpy()))
                    order = order[np.sort(np.unique(met["key"].to_numpy()[order], return_index=True)[1])][:added]
                    best[k, label] = met.take(pa.array(order))
            for (k, label), met in best.items():
                met = pa.table([pa.array([k] * len(met), pa.int32()), pa.array([label] * len(met), pa.int32()), *met.columns], names=names)
                yield from met.combine_chunks().to_batches()

        found = work.write(pool.mapInArrow(run, schema).dropDuplicates(["view", "label", "key"]), f"round{len(taken)}")
        for k in (0, 1):
            for label in (1, 0):
                rows = found.where((F.col("view") == k) & (F.col("label") == label)).orderBy(F.desc("lift"), "key").limit(added).toPandas()
                taken.update(rows["key"].tolist())
                yield k, label, unpacked(*listed(rows)) if len(rows) else [np.zeros((0, x)) for x in widths]

    first = unpacked(*listed(told))
    widths = [x.shape[1] for x in first]
    model = co_train(first, told["tw_label"].to_numpy(float), draw, rounds)
    work.drop(".")
    return model


def scored(spark: SparkSession, docs: DataFrame, model: CoTrained | float, text_col: str = "text") -> DataFrame:
    """All columns of docs, and tw_quality, tw_content, tw_meta: probabilities of quality, combined and by view."""
    batches(spark)
    extra = ["quality", "content", "meta"]
    docs, (text_col, *meta) = aside(docs, [f"tw_{x}" for x in extra], text_col, *META)
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)), *(T.StructField(x, T.DoubleType()) for x in extra)])
    text, meta, sent = docs.columns.index(text_col), [docs.columns.index(c) for c in meta], spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own = WordHasher(), sent.value
        for batch in parts:
            for lo in range(0, len(batch), 500):
                b = batch.slice(lo, 500)
                if isinstance(own, float):
                    out = [np.full(len(b), own)] * 3
                else:
                    xs = [text_view(hasher, b.column(text)), meta_view(*(b.column(i).to_pylist() for i in meta))]
                    out = own([xs[0].astype(np.float16).astype(float), xs[1]])
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out)], names=schema.names)

    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema).toDF(*docs.columns, *(f"tw_{x}" for x in extra))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *META)
    model = fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = scored(spark, docs, model)
    return found.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("tw_quality").alias("score"), F.col("tw_content").alias("content_score"), F.col("tw_meta").alias("meta_score"),
        (F.col("tw_quality") >= REJECT).cast("int").alias("predicted"),
    )
