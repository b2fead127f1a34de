"""N-gram language model in sharded Elias-Fano tries, and its score of every text.

Counting: each task packs the distinct n-grams of its training tokens, with counts, by shard of the first word; words so common that a
shard would be uneven are spread by their second word. One task for each shard sorts and adds them up and writes its words, pointers and counts to the
shared folder; when the counts of counts of all shards are known, another writes the probabilities beside them. These levels make the shard's trie:

* level 1: sorted 64-bit word hashes and exact counts;
* level d > 1: each node's word (32 bits), sorted within its context, and its smoothed probability in 8 bits;
* between levels: Elias-Fano coded monotone pointers to a node's successors, and the node's back-off weight in 8 bits.

Scoring maps those files into memory. A query finds its context's range by two selects on the pointers and its word by successor search
within that range. Probabilities interpolate absolute discounting: p(w | context) = max(c - D, 0) / c(context) + D * successors / c(context) *
p(w | shorter context), down to the add-half estimate of single words. D comes from the counts of counts of the whole corpus, one for each level, and
a common word's count and back-off weight from all its shards, so that a score does not depend on how many shards or partitions there are.

Tokens: lower-cased (A-Z) words, then one end. Words are known by 64-bit hashes (by 32 bits below a context).

What is gathered grows with the corpus: counts are shuffled whole, none is dropped (`least_count` may prune longer n-grams; the query does not).
What reaches the driver: a row for each shard, and the common words (at most 4 for each shard). The tries stay in the shared folder as long as the
result may be computed; a file that is missing then raises. The folder must be mounted by all machines (it raises if it has another scheme).

Defined cases: a null or empty text is one end token; equal rows get equal scores; without training tokens N = V = 0 and every token
has probability 1 (0.5 / 0.5); an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import Workspace, WordHasher, aside, batches, held_out, mix, signed

ORDER, SHARD_TOKENS, BLOCK = 3, 2_000_000, 2_000_000
END, PAD = 1, 0
BITS_A_STEP = 8  # a quantised probability is 2 ** (-q / BITS_A_STEP)


# --- Elias-Fano -------------------------------------------------------------


def ef_build(values: np.ndarray) -> dict[str, np.ndarray]:
    """A monotone sequence: low bits packed, high bits in unary, and the number of ones before each word of them."""
    values = values.astype(np.uint64)
    n, top = len(values), int(values[-1]) + 1
    low = max(0, int(np.log2(max(1, top / n))))
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    words = np.zeros((int(high[-1]) >> 6) + 2, np.uint64)
    np.bitwise_or.at(words, high >> 6, np.uint64(1) << (high & 63).astype(np.uint64))
    packed = np.zeros((n * low >> 6) + 2, np.uint64)
    if low:
        at = np.arange(n, dtype=np.int64) * low
        part = values & np.uint64((1 << low) - 1)
        off = (at & 63).astype(np.uint64)
        np.bitwise_or.at(packed, at >> 6, part << off)
        over = np.flatnonzero(off + np.uint64(low) > 64)
        np.bitwise_or.at(packed, (at[over] >> 6) + 1, part[over] >> (np.uint64(64) - off[over]))
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.uint32)
    return {"words": words, "ranks": ranks, "packed": packed, "low": np.array([low], np.int64)}


def select_in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) of each word, by halving."""
    at = np.zeros(len(x), np.uint64)
    k = k.astype(np.uint64)
    for half in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count((x >> at) & np.uint64((1 << half) - 1)).astype(np.uint64)
        up = k >= below
        k = k - np.where(up, below, np.uint64(0))
        at = at + np.where(up, np.uint64(half), np.uint64(0))
    return at.astype(np.int64)


def ef_get(ef: dict[str, np.ndarray], i: np.ndarray) -> np.ndarray:
    """values[i]: a select on the high bits, and the low bits."""
    word = np.searchsorted(ef["ranks"], i.astype(np.uint32), "right") - 1
    high = (word << 6) + select_in_word(ef["words"][word], i - ef["ranks"][word]) - i
    low = int(ef["low"][0])
    if not low:
        return high
    at = i * low
    off = (at & 63).astype(np.uint64)
    part = ef["packed"][at >> 6] >> off
    part |= np.where(off > 0, ef["packed"][(at >> 6) + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
    return (high << low) | (part & np.uint64((1 << low) - 1)).astype(np.int64)


def successor(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of x in keys[lo:hi], sorted there; -1 if it is not there."""
    lo, end = lo.copy(), hi
    hi = hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        a, b = lo[open_], hi[open_]
        mid = (a + b) >> 1
        less = keys[mid] < x[open_]
        lo[open_] = np.where(less, mid + 1, a)
        hi[open_] = np.where(less, b, mid)
        open_ = open_[lo[open_] < hi[open_]]
    there = lo < end
    there[there] = keys[lo[there]] == x[there]
    return np.where(there, lo, -1)


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log2(np.maximum(p, 2.0**-31)) * BITS_A_STEP), 0, 255).astype(np.uint8)


LEVELS_OF_Q = 2.0 ** (-np.arange(256) / BITS_A_STEP)


# --- the trie of a shard ----------------------------------------------------


def packed(name: str, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each; 255 stands for those listed beside them."""
    big = np.flatnonzero(counts >= 255)
    return {f"{name}.low": np.minimum(counts, 255).astype(np.uint8), f"{name}.at": big, f"{name}.n": counts[big]}


def unpacked(counts: dict[str, np.ndarray]) -> np.ndarray:
    out = counts["low"].astype(np.int64)
    out[counts["at"]] = counts["n"]
    return out


def trie(columns: list[np.ndarray], counts: np.ndarray, least_count: int) -> dict[str, np.ndarray]:
    """Levels of a shard from n-grams (first word: 64 bits, the others: 32) in any order, with repeats."""
    order = np.lexsort(columns[::-1])
    columns, counts = [c[order] for c in columns], counts[order].astype(np.int64)
    new = np.zeros(len(counts), bool)
    firsts, levels = [], {}
    for c in columns:  # new[i]: row i begins another node of this level
        new = new | np.concatenate([[True], c[1:] != c[:-1]])
        firsts.append(np.flatnonzero(new))
    totals = [np.add.reduceat(counts, f) for f in firsts]
    kept = [np.ones(len(firsts[0]), bool)]
    for d in range(1, len(columns)):
        up = np.searchsorted(firsts[d - 1], firsts[d], "right") - 1
        kept.append(kept[d - 1][up] & (totals[d] >= least_count))
    for d in range(len(columns)):
        keep = kept[d]
        levels[f"key{d}"] = columns[d][firsts[d]][keep]
        if d == 0:
            levels["total0"] = totals[0][keep]
        if d:
            levels |= packed(f"total{d}", totals[d][keep])
            levels[f"once{d}"] = np.array([(totals[d] == 1).sum(), (totals[d] == 2).sum()])
            own = (np.cumsum(kept[d - 1]) - 1)[(np.searchsorted(firsts[d - 1], firsts[d], "right") - 1)[keep]]
            for k, v in ef_build(np.concatenate([[0], np.cumsum(np.bincount(own, minlength=int(kept[d - 1].sum())))])).items():
                levels[f"ptr{d - 1}.{k}"] = v
    return levels


def smoothed(levels: dict, discounts: np.ndarray, common: np.ndarray, common_totals: np.ndarray, common_backs: np.ndarray) -> dict[str, np.ndarray]:
    """Probabilities and back-off weights of a shard's levels: what they are follows from counts over the whole corpus.

    Of a common word, spread over shards, the count and the back-off weight are given: those of all shards.
    """
    order = sum(k.startswith("key") for k in levels)
    out = {"count": levels["total0"].copy()}
    spot = np.flatnonzero(np.isin(levels["key0"], common))
    given = np.searchsorted(common, levels["key0"][spot])
    out["count"][spot] = common_totals[given]
    above = out["count"]
    for d in range(1, order):
        edges = ef_get(levels[f"ptr{d - 1}"], np.arange(len(levels[f"key{d - 1}"]) + 1))
        own, totals = np.repeat(np.arange(len(edges) - 1), np.diff(edges)), unpacked(levels[f"total{d}"])
        rest = totals - discounts[d]
        out[f"prob{d}"] = quantised(rest / above[own])
        out[f"back{d - 1}"] = quantised(1 - np.bincount(own, weights=rest, minlength=len(above)) / above)
        if d == 1:
            out["back0"][spot] = common_backs[given]
        above = totals
    return out


def write_levels(path: str, levels: dict[str, np.ndarray]) -> None:
    """One file; it takes its name when it is whole, so that a repeated task is harmless."""
    at, head, parts = 0, {}, []
    for name, x in levels.items():
        data = np.ascontiguousarray(x).tobytes()
        head[name] = (at, len(x), x.dtype.str)
        parts.append(data + b"\0" * (-len(data) % 8))
        at += len(parts[-1])
    told = json.dumps(head).encode()
    told += b" " * (-len(told) % 8)
    with open(own := f"{path}.{os.getpid()}.{np.random.default_rng().integers(1 << 60)}", "wb") as f:
        f.write(len(told).to_bytes(8, "little") + told)
        f.writelines(parts)
    os.replace(own, path)


def map_levels(path: str) -> dict[str, np.ndarray]:
    """The levels of a file, mapped into memory."""
    data = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + n].tobytes())
    out: dict = {}
    for name, (at, count, kind) in head.items():
        x = np.frombuffer(data, np.dtype(kind), count, 8 + n + at)
        level, _, part = name.partition(".")
        if part:
            out.setdefault(level, {})[part] = x
        else:
            out[name] = x
    return out


def look_up(shard: dict, words: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For rows of words: the first word's count, then for each next level its probability, and its context's back-off weight."""
    node = np.searchsorted(shard["key0"], words[0])
    there = node < len(shard["key0"])
    there[there] = shard["key0"][node[there]] == words[0][there]
    node = np.where(there, node, -1)
    count = np.where(there, shard["count"][np.where(there, node, 0)] if len(shard["count"]) else 0, 0)
    probs, backs = [], []
    for d in range(1, len(words)):
        prob, back = np.zeros(len(node)), np.ones(len(node))
        seen = np.flatnonzero(node >= 0)
        own = node[seen]
        back[seen] = LEVELS_OF_Q[shard[f"back{d - 1}"][own]]
        lo, hi = ef_get(shard[f"ptr{d - 1}"], own), ef_get(shard[f"ptr{d - 1}"], own + 1)
        found = successor(shard[f"key{d}"], lo, hi, words[d][seen])
        prob[seen] = np.where(found >= 0, LEVELS_OF_Q[shard[f"prob{d}"][np.maximum(found, 0)]] if len(shard[f"prob{d}"]) else 0, 0)
        node = np.full(len(node), -1)
        node[seen] = found
        probs.append(prob)
        backs.append(back)
    return count, probs, backs


# --- Spark ------------------------------------------------------------------


def tokens(hasher: WordHasher, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each text followed by END; n + 1 offsets."""
    words, at = hasher(column)
    n = len(at) - 1
    out = np.full(len(words) + n, END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(at))] = words
    return out, at + np.arange(n + 1)


def grams(words: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """At each token: the word itself, and 32 bits of the next ones; PAD beyond the text's end."""
    out, left = [words], np.repeat(at[1:], np.diff(at)) - np.arange(len(words))
    for d in range(1, order):
        x = np.zeros(len(words), np.uint32)
        x[: len(words) - d] = np.maximum(words[d:] >> np.uint64(32), np.uint64(1)).astype(np.uint32) if len(words) > d else 0
        out.append(np.where(left > d, x, np.uint32(PAD)))
    return out


def shard_of(columns: list[np.ndarray], common: np.ndarray, shards: int) -> np.ndarray:
    at = mix(columns[0])
    if len(common):
        spot = np.minimum(np.searchsorted(common, columns[0]), len(common) - 1)
        at = at + np.where(common[spot] == columns[0], columns[1].astype(np.uint64) >> np.uint64(4), np.uint64(0))
    return (at % np.uint64(shards)).astype(np.int64)


class Model:
    """Where the shards are, which of them hold anything, the common words with counts and quantised back-off weights, and the totals."""

    def __init__(self, folder: str, shards: int, filled: np.ndarray, common: np.ndarray, common_counts: np.ndarray, common_backs: np.ndarray, n: int, v: int, order: int):
        self.folder, self.shards, self.filled = folder, shards, set(filled.tolist())
        self.common, self.common_counts, self.common_backs, self.n, self.v, self.order = common, common_counts, common_backs, n, v, order

    def shard(self, s: int) -> dict | None:
        """The levels of a shard; None if no n-gram fell there. A file that was written and is gone is an error, not an empty shard."""
        if s not in self.filled:
            return None
        try:
            return map_levels(f"{self.folder}/{s}") | map_levels(f"{self.folder}/{s}.p")
        except FileNotFoundError as e:
            raise FileNotFoundError(f"shard {s} of the language model is missing in {self.folder}: fit the model again") from e


def fit(spark: SparkSession, docs: DataFrame, text_col: str = "text", order: int = ORDER, least_count: int = 1) -> Model:
    """Trains on all rows of docs."""
    batches(spark)
    work = Workspace(spark, "lm")
    if not work.root.startswith(("file:", "/")):
        raise ValueError("the tries are mapped into memory: spark.checkpoint.dir must be a folder that all machines mount")
    folder = "/" + work.root.removeprefix("file:").lstrip("/")
    texts = docs.select(text_col)

    def census(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in rows:
            words, _ = tokens(hasher, batch.column(0))
            found, times = np.unique(words, return_counts=True)
            often = times >= max(2, len(words) // 4000)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[0], signed(found[often])])), pa.array(np.concatenate([[len(words)], times[often]]))], names=["w", "n"])

    counted = work.write(texts.mapInArrow(census, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "census")
    total = int((counted.where("w = 0").agg(F.sum("n")).first()[0]) or 0)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_TOKENS))
    common = np.sort(counted.where((F.col("w") != 0) & (F.col("n") >= max(1, total // (4 * shards)))).select("w").toPandas()["w"].to_numpy(np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast(common)

    def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = WordHasher(), [], 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            rest = columns[1].astype(np.uint64) << np.uint64(32) | columns[2] if order == 3 else None
            by = np.lexsort((rest, columns[0]) if order == 3 else columns[::-1])
            columns = [c[by] for c in columns]
            new = np.zeros(len(by), bool)
            for c in columns:
                new |= np.concatenate([[True], c[1:] != c[:-1]])
            start = np.flatnonzero(new)
            columns, counts = [c[start] for c in columns], np.diff(np.concatenate([start, [len(by)]])).astype(np.uint32)
            shard = shard_of(columns, sent.value, shards)
            by = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[by], np.arange(shards + 1))
            full = np.flatnonzero(np.diff(edges))
            blobs: list[list[bytes]] = [[] for _ in range(order + 2)]
            for s in full:
                own = by[edges[s] : edges[s + 1]]
                first = columns[0][own]
                run = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
                blobs[0].append(first[run].tobytes())
                blobs[1].append(np.diff(np.concatenate([run, [len(first)]])).astype(np.uint32).tobytes())
                for d in range(1, order):
                    blobs[d + 1].append(columns[d][own].tobytes())
                blobs[-1].append(counts[own].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array(b, pa.binary()) for b in blobs)], names=names)

        for batch in rows:
            words, at = tokens(hasher, batch.column(0))
            held.append(grams(words, at, order))
            size += len(words)
            if size >= BLOCK:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    names = ["shard", "first", "runs", *(f"w{d}" for d in range(1, order)), "counts"]
    schema = "shard int, " + ", ".join(f"{x} binary" for x in names[1:])

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in parts if len(b)]
        get = lambda i, kind: np.concatenate([np.frombuffer(x, kind) for b in parts for x in b.column(i).to_pylist()])
        shard = parts[0].column(0)[0].as_py()
        levels = trie([np.repeat(get(1, np.uint64), get(2, np.uint32)), *(get(d + 2, np.uint32) for d in range(1, order))], get(order + 2, np.uint32), least_count)
        os.makedirs(f"{folder}/trie", exist_ok=True)
        write_levels(f"{folder}/trie/{shard}", levels)
        kept = np.flatnonzero(np.isin(levels["key0"], sent.value))
        ptr = {k.partition(".")[2]: v for k, v in levels.items() if k.startswith("ptr0.")}
        lo, hi = ef_get(ptr, kept), ef_get(ptr, kept + 1)
        mass = np.concatenate([[0], np.cumsum(unpacked({k.partition(".")[2]: v for k, v in levels.items() if k.startswith("total1.")}))])
        rows = [("shard", shard, len(levels["key0"]) - len(kept), int(levels["total0"].sum()))]
        rows += [("once", d, *map(int, levels[f"once{d}"])) for d in range(1, order)]
        rows += [("common", w, int(hi[i] - lo[i]), int(mass[hi[i]] - mass[lo[i]])) for i, w in enumerate(signed(levels["key0"][kept]).tolist())]
        rows += [("total", w, int(t), 0) for w, t in zip(signed(levels["key0"][kept]).tolist(), levels["total0"][kept], strict=True)]
        yield pa.RecordBatch.from_pylist([dict(zip(("kind", "w", "n", "x"), r, strict=True)) for r in rows], schema=pa.schema([("kind", pa.string()), ("w", pa.int64()), ("n", pa.int64()), ("x", pa.int64())]))

    told = work.write(texts.mapInArrow(packed, schema).groupBy("shard").applyInArrow(build, "kind string, w long, n long, x long"), "told")
    facts = told.groupBy("kind", "w").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toPandas()
    part = lambda kind: facts[facts["kind"] == kind].sort_values("w", key=lambda c: c.to_numpy(np.int64).view(np.uint64))
    own, filled = part("common"), part("shard")["w"].to_numpy(np.int64)
    n, v = int(part("shard")["x"].sum()), int(part("shard")["n"].sum()) + len(own)
    discounts = np.full(order, 0.75)
    for d, one, two in part("once")[["w", "n", "x"]].itertuples(index=False):
        if one and two:
            discounts[d] = one / (one + 2 * two)
    words, totals = own["w"].to_numpy(np.int64).view(np.uint64), part("total")["n"].to_numpy(np.int64)
    backs = quantised(1 - (own["x"].to_numpy(float) - discounts[1] * own["n"].to_numpy(float)) / np.maximum(1, totals))

    def smooth(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for s in b.column(0).to_pylist():
                write_levels(f"{folder}/trie/{s}.p", smoothed(map_levels(f"{folder}/trie/{s}"), discounts, words, totals, backs))
            yield b

    if len(filled):
        work.write(told.where("kind = 'shard'").select("w").repartition(len(filled), "w").mapInArrow(smooth, "w long"), "smoothed")
    work.drop("census")
    return Model(f"{folder}/trie", shards, filled, words, totals, LEVELS_OF_Q[backs], n, v, order)


def scores(model: Model, shards: dict, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: known tokens, base score, score (sums of log10)."""
    columns = grams(words, at, model.order)
    shard = shard_of(columns, model.common, model.shards)
    count, prob, back = np.zeros(len(words), np.int64), np.zeros((model.order, len(words))), np.ones((model.order, len(words)))
    by = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[by], np.arange(model.shards + 1))
    for s in np.flatnonzero(np.diff(edges)):
        if s not in shards:
            shards[s] = model.shard(int(s))
        if shards[s] is None:
            continue
        own = by[edges[s] : edges[s + 1]]
        count[own], probs, backs = look_up(shards[s], [c[own] for c in columns])
        for d in range(1, model.order):
            prob[d, own], back[d, own] = probs[d - 1], backs[d - 1]
    if len(model.common):
        spot = np.minimum(np.searchsorted(model.common, words), len(model.common) - 1)
        often = np.flatnonzero(model.common[spot] == words)
        back[1, often] = model.common_backs[spot[often]]  # this shard may hold none of a common word's successors
        count[often] = model.common_counts[spot[often]]
    base = (count + 0.5) / (model.n + 0.5 * (model.v + 1))
    p, place = base.copy(), np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
    for d in range(1, model.order):
        inside = np.flatnonzero(place >= d)
        p[inside] = prob[d, inside - d] + back[d, inside - d] * p[inside]
    add = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else np.zeros(0)
    return add((count > 0).astype(np.int64)).astype(np.int64), add(np.log10(base)), add(np.log10(np.minimum(p, 1.0)))


def scored(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs, and tw_n_tokens, tw_n_known, tw_base, tw_score (see `aside` for names that clash)."""
    batches(spark)
    fields = [("tw_n_tokens", T.LongType()), ("tw_n_known", T.LongType()), ("tw_base", T.DoubleType()), ("tw_score", T.DoubleType())]
    docs, (text_col,) = aside(docs, [n for n, _ in fields], text_col)
    schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate([*(f.dataType for f in docs.schema), *(t for _, t in fields)])])
    at_col, sent = docs.columns.index(text_col), spark.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, shards, own = WordHasher(), {}, sent.value
        for batch in rows:
            words, at = tokens(hasher, batch.column(at_col))
            known, base, score = scores(own, shards, words, at)
            extra = [pa.array(np.diff(at)), pa.array(known), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema).toDF(*docs.columns, *(n for n, _ in fields))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 5, 1))
    model = fit(spark, docs.where(~F.col("held_out")))
    found = scored(spark, docs, model)
    return found.select(
        "doc_id", "held_out", F.col("tw_n_tokens").alias("n_tokens"), F.col("tw_n_known").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        F.col("tw_base").alias("base_score"), F.col("tw_score").alias("score"),
    )
