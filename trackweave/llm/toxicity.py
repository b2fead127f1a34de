"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy; every overlapping window of a text is scored.

A word's input is its embedding (a bounded vocabulary of training words) beside the mean embedding of its hashed character trigrams. Two
gated recurrent passes read a window of WINDOW words; attention pools their states into a logit. A text's evidence is its highest window;
a calibration on training texts turns that and the number of windows into a probability.

Windows of WINDOW words begin every STRIDE words: a run of WINDOW - STRIDE words or fewer is whole in some window. Training sees a bounded sample: at
most SAMPLE texts of each label; of a text over LONG characters, passages of PASSAGE characters spread evenly over all of it, LONG together. Labels mark texts, so that each round
takes the highest window of a toxic text, and the highest and a random one of a clean text. Word embeddings begin at the log-odds of
the words. The score uses the text alone.

Defined cases: a null or empty text has one empty window; equal texts get equal scores; without both labels every score is the labels' share
(0 without labels); a null text is learnt from as an empty one; texts are scored whole, whatever their length; an empty table gives an empty table; other columns pass through
(see `aside` for names that clash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import WordHasher, aside, batches, held_out, logistic, mix, sampled, sigmoid

WINDOW, STRIDE = 32, 16
WORD, CHAR, HIDDEN, ATTEND = 8, 6, 8, 8
VOCABULARY, TRIGRAMS = 8192, 4096
SAMPLE, LONG, PASSAGE, ROUNDS, STEPS, BATCH, RATE = {1: 1500, 0: 2500}, 40_000, 2_000, 5, 200, 128, 0.01


def trigrams(hasher: WordHasher, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of words at..to (after a call of the hasher), and where each word's begin: a word of b bytes has b of them."""
    starts, stops = hasher.starts[at:to], hasher.stops[at:to]
    size = stops - starts
    first = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(first[-1]) + np.repeat(starts - first[:-1], size)
    low = LOWER[hasher.data[place]].astype(np.uint64) if len(place) else np.zeros(0, np.uint64)
    before, after = np.concatenate([[0], low[:-1]]).astype(np.uint64), np.concatenate([low[1:], [0]]).astype(np.uint64)
    if len(place):
        before[first[:-1]] = 32
        after[first[1:] - 1] = 32
    with np.errstate(over="ignore"):
        code = mix(before << np.uint64(16) | low[: len(before)] << np.uint64(8) | after) if len(place) else low
    return (code % np.uint64(TRIGRAMS)).astype(np.int64), first


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def window_rows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of every window."""
    n = np.diff(at)
    many = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return at[:-1][text] + k * STRIDE, np.minimum(WINDOW, n[text] - k * STRIDE), text


class Network:
    """Parameters, and the passes through them. Directions f and b share code: b reads windows backwards."""

    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray):
        r = np.random.default_rng(11)
        d = WORD + CHAR
        new = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"E": new(len(vocabulary) + 1, WORD) * np.float32(0.3), "C": new(TRIGRAMS, CHAR), "A": new(2 * HIDDEN, ATTEND), "u": new(ATTEND), "o": new(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        self.p["E"][1:, 0] = np.clip(odds, -3, 3)
        self.p["E"][0] = 0
        for k in "fb":
            self.p |= {f"W{k}": new(d, 3 * HIDDEN), f"U{k}": new(HIDDEN, 3 * HIDDEN), f"B{k}": np.zeros(3 * HIDDEN, np.float32)}
        self.calibration = np.zeros(3)

    def words(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        spot = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[spot] == hashes, spot + 1, 0)

    def inputs(self, ids: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        char = np.add.reduceat(self.p["C"][buckets], first[:-1], axis=0) / np.diff(first)[:, None] if len(ids) else np.zeros((0, CHAR))
        return np.concatenate([self.p["E"][ids], char.astype(np.float32)], axis=1)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: windows x words x inputs. Logits; what the way back needs, if keep."""
        p, h_ = self.p, HIDDEN
        states, trace = {}, {}
        for k in "fb":
            gates = x @ p[f"W{k}"] + p[f"B{k}"]
            h, own, steps = np.zeros((len(x), h_), np.float32), np.zeros((len(x), WINDOW, h_), np.float32), []
            for t in range(WINDOW) if k == "f" else range(WINDOW - 1, -1, -1):
                g, m = h @ p[f"U{k}"], mask[:, t, None]
                zr = np.tanh((gates[:, t, : 2 * h_] + g[:, : 2 * h_]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
                z, r = zr[:, :h_], zr[:, h_:]
                n = np.tanh(gates[:, t, 2 * h_ :] + r * g[:, 2 * h_ :])
                new = n + z * (h - n)
                if keep:
                    steps.append((t, h, z, r, n, g[:, 2 * h_ :], m))
                h = h + m * (new - h)
                own[:, t] = h
            states[k], trace[k] = own, steps
        both = np.concatenate([states["f"], states["b"]], axis=2)
        a = np.tanh(both @ p["A"])
        s = a @ p["u"] + np.where(mask > 0, 0, -1e4).astype(np.float32)
        e = np.exp(s - s.max(axis=1, keepdims=True)) * mask
        alpha = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
        v = np.einsum("bt,bth->bh", alpha, both)
        logit = v @ p["o"] + p["c"][0]
        return (logit, (x, trace, both, a, alpha, v)) if keep else logit

    def backward(self, d: np.ndarray, kept: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of the inputs, from d: of the logits."""
        x, trace, both, a, alpha, v = kept
        p, h_, grad = self.p, HIDDEN, {}
        grad["o"], grad["c"] = v.T @ d, np.array([d.sum()])
        dv = d[:, None] * p["o"]
        dalpha = np.einsum("bh,bth->bt", dv, both)
        ds = alpha * (dalpha - (alpha * dalpha).sum(axis=1, keepdims=True))
        grad["u"] = np.einsum("bt,bta->a", ds, a)
        da = ds[:, :, None] * p["u"] * (1 - a * a)
        grad["A"] = np.einsum("bth,bta->ha", both, da)
        dboth = alpha[:, :, None] * dv[:, None, :] + da @ p["A"].T
        dx = np.zeros_like(x)
        for i, k in enumerate("fb"):
            dh, dgates = np.zeros((len(x), h_), np.float32), np.zeros((len(x), WINDOW, 3 * h_), np.float32)
            du = np.zeros_like(p[f"U{k}"])
            for t, h, z, r, n, gn, m in reversed(trace[k]):
                dh = dh + dboth[:, t, i * h_ : (i + 1) * h_]
                dnew = dh * m
                dn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (h - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                dgates[:, t] = np.concatenate([dz, dr, dn], axis=1)
                du += h.T @ dg
                dh = dh * (1 - m) + dnew * z + dg @ p[f"U{k}"].T
            grad[f"U{k}"], grad[f"B{k}"] = du, dgates.sum(axis=(0, 1))
            grad[f"W{k}"] = np.einsum("btd,btg->dg", x, dgates)
            dx += dgates @ p[f"W{k}"].T
        return grad, dx

    def logits(self, hasher: WordHasher, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of all windows, and their first words and texts."""
        first, size, text = window_rows(at)
        ids, out = self.words(hashes), np.zeros(len(first), np.float32)
        for lo in range(0, len(first), 2048):
            a, n = first[lo : lo + 2048], size[lo : lo + 2048]
            from_, to = int(a.min()), int((a + n).max())
            x = self.inputs(ids[from_:to], *trigrams(hasher, from_, to))
            x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
            mask = np.arange(WINDOW) < n[:, None]
            place = np.where(mask, a[:, None] - from_ + np.arange(WINDOW), len(x) - 1)
            out[lo : lo + 2048] = self.forward(x[place], mask.astype(np.float32))
        return out, first, text

    def probability(self, top: np.ndarray, many: np.ndarray) -> np.ndarray:
        return sigmoid(top * self.calibration[0] + np.log(many) * self.calibration[1] + self.calibration[2])


def tops(logit: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's highest logit and number of windows."""
    edges = np.searchsorted(text, np.arange(n))
    return (np.maximum.reduceat(logit, edges) if n else np.zeros(0)), np.bincount(text, minlength=n)


def train(texts: list[str], y: np.ndarray) -> Network | float:
    """A network; a plain share if there are not both labels."""
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.0
    y = y.astype(np.float32)
    hasher, rng = WordHasher(plain=True), np.random.default_rng(5)
    hashes, at = hasher(pa.array(texts, pa.string()))
    owner = np.repeat(np.arange(len(y)), np.diff(at))
    word, where = np.unique(hashes, return_inverse=True)
    seen = np.unique(where.astype(np.int64) * len(y) + owner)  # (word, text)
    has = np.bincount(seen // len(y), minlength=len(word))
    bad = np.bincount(seen // len(y), weights=y[seen % len(y)], minlength=len(word))
    odds = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((has - bad + 0.5) / (len(y) - y.sum() + 1))
    often = np.flatnonzero(has >= 3)
    often = often[np.argsort(-np.abs(odds[often]) * np.sqrt(has[often]), kind="stable")[:VOCABULARY]]
    often = often[np.argsort(word[often])]
    net = Network(word[often], odds[often])
    ids = net.words(hashes)
    # by pieces, in 16 bits: the whole sample's trigrams are many
    buckets = np.concatenate([np.zeros(0, np.uint16), *(trigrams(hasher, k, min(k + 50_000, len(hashes)))[0].astype(np.uint16) for k in range(0, len(hashes), 50_000))])
    starts = np.concatenate([[0], np.cumsum(hasher.stops - hasher.starts)])
    first, size, text = window_rows(at)
    edges = np.concatenate([np.searchsorted(text, np.arange(len(y))), [len(text)]])
    lift = np.concatenate([[0], np.cumsum(np.maximum(net.p["E"][ids, 0], 0) ** 2)])
    value = (lift[first + size] - lift[first]).astype(np.float32)  # the first choice of windows
    mean, var = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    step, a_round = 0, -(-(len(y) + int((y == 0).sum())) // BATCH)
    rounds = max(ROUNDS, -(-STEPS // a_round))  # few texts are read more often
    for _ in range(rounds):
        best = np.array([edges[i] + int(np.argmax(value[edges[i] : edges[i + 1]])) for i in range(len(y))])
        clean = np.flatnonzero(y == 0)
        other = edges[clean] + (rng.random(len(clean)) * (edges[clean + 1] - edges[clean])).astype(np.int64)
        rows, target = np.concatenate([best, other]), np.concatenate([y, np.zeros(len(clean), np.float32)])
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            own, want = rows[order[lo : lo + BATCH]], target[order[lo : lo + BATCH]]
            mask = np.arange(WINDOW) < size[own][:, None]
            place = (first[own][:, None] + np.arange(WINDOW))[mask]
            lens = (starts[1:] - starts[:-1])[place]
            spots = np.repeat(starts[place] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
            part = np.concatenate([[0], np.cumsum(lens)])
            x = np.zeros((len(own), WINDOW, WORD + CHAR), np.float32)
            x[mask] = net.inputs(ids[place], buckets[spots], part)
            logit, kept = net.forward(x, mask.astype(np.float32), keep=True)
            grad, dx = net.backward(((sigmoid(logit) - want) / len(own)).astype(np.float32), kept)
            dx = dx[mask]
            grad["E"], grad["C"] = np.zeros_like(net.p["E"]), np.zeros_like(net.p["C"])
            np.add.at(grad["E"], ids[place], dx[:, :WORD])
            grad["E"][0] = 0
            np.add.at(grad["C"], buckets[spots], np.repeat(dx[:, WORD:] / np.maximum(1, lens)[:, None], lens, axis=0))
            step += 1
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.99 * var[k] + 0.01 * g * g
                net.p[k] = (net.p[k] - RATE / (1 + ROUNDS * step / (rounds * a_round)) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        value = net.logits(hasher, hashes, at)[0]
    top, many = tops(value, text, len(y))
    net.calibration = logistic(np.stack([top, np.log(many)], 1).astype(float), y.astype(float), ridge=0.1)
    return net


def passages(text: Column) -> Column:
    """A text for training: the whole, or, of a long one, passages spread evenly over it."""
    many = LONG // PASSAGE
    starts = F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda k: (k * ((F.length(text) - PASSAGE) / (many - 1))).cast("int") + 1)
    return F.when(F.length(text) > LONG, F.array_join(F.transform(starts, lambda at: F.substring(text, at, F.lit(PASSAGE))), " ")).otherwise(F.coalesce(text, F.lit("")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: dict[int, int] = SAMPLE, folds: int = 5, fold: int = 0) -> Network | float:  # noqa: B006
    own = docs.select(F.col(id_col).alias("id"), passages(F.col(text_col)).alias("text"))
    rows = sampled(own, labels.select(F.col(id_col).alias("id"), label), "id", label, sample, folds, fold).select("text", "tw_label").toPandas()
    rows = rows.sort_values(["text", "tw_label"])
    texts, y = rows["text"].tolist(), rows["tw_label"].to_numpy(float)
    del rows
    return train(texts, y)


def scored(spark: SparkSession, docs: DataFrame, model: Network | float, text_col: str = "text") -> DataFrame:
    """All columns of docs, and tw_score."""
    batches(spark)
    docs, (text_col,) = aside(docs, ["tw_score"], text_col)
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)), T.StructField("score", T.DoubleType())])
    at_col, sent = docs.columns.index(text_col), spark.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hasher = sent.value, WordHasher(plain=True)
        for batch in rows:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                if isinstance(own, float):
                    score = np.full(len(part), own)
                else:
                    hashes, at = hasher(part.column(at_col))
                    logit, _, text = own.logits(hasher, hashes, at)
                    score = own.probability(*tops(logit, text, len(part)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score.astype(float))], names=schema.names)

    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema).toDF(*docs.columns, "tw_score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = scored(spark, docs, model)
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("tw_score").alias("score"), (F.col("tw_score") >= 0.5).cast("int").alias("predicted"))
