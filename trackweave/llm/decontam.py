"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark items.

Texts are normalised to their words (runs of ASCII letters and digits, A-Z lower-cased, and non-ASCII characters), known by 64-bit hashes. A window is
`width` consecutive words of an item (a shorter item is one window). Windows overlap, so that an automaton of all of them would hold each
word `width` times; it holds anchors instead: blocks of half a window, spaced so that every window contains one, and short items whole. Its
alphabet is words' hashes, cut to 16 bits. Each text is scanned once; where an anchor ends, the windows around it are looked up in a sorted table of window hashes, which
confirms them and names their items. Only a text with a match pays for the map from words back to its characters.

The index is made of at most about `max_bytes` of item text: a larger benchmark is dealt into parts by hash, and texts are scanned once for each part,
the finds of the parts before written to the shared folder in between. Items of any length are cut into pieces that overlap by a window.

Defined cases: a null or empty text has no words and no hits; an item without words has no window; the same window in several items counts
for each of them, repeated items once; a null item id is the id ''; repeated rows are judged row by row; an empty benchmark hits nothing; an empty table
gives an empty table; other columns pass through (see `aside` for names that clash).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import Workspace, WordHasher, aside, batches, mix, text_buffer

PIECE, MAX_BYTES = 100_000, 16 << 20
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
ADDED = [T.StructField("tw_n_words", T.LongType()), T.StructField("tw_n_hit", T.LongType()), T.StructField("tw_items", T.ArrayType(T.StringType())), T.StructField("tw_spans", SPAN)]

_built: dict = {}


def pieces(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """(item, words: hashes as bytes), at most PIECE windows each."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(plain=True)
        for batch in rows:
            words, at = hasher(batch.column(1))
            cuts = [(i, a, min(a + PIECE + width - 1, int(at[i + 1]))) for i in range(len(batch)) for a in range(int(at[i]), max(int(at[i]) + 1, int(at[i + 1]) - width + 2), PIECE) if at[i + 1] > at[i]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([c[0] for c in cuts], pa.int64())), pa.array([words[a:b].tobytes() for _, a, b in cuts], pa.binary())], names=["item", "words"])

    return benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text_col).mapInArrow(run, "item string, words binary")


def window_hashes(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.full(len(starts), width, np.uint64)
        for j in range(width):
            total += words[starts + j] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    return mix(total)


class Index:
    """Windows of some items: anchors for the automaton, and by window length sorted hashes with their items."""

    def __init__(self, rows: list[tuple[str, bytes]], width: int):
        self.width, self.block = width, (width + 1) // 2
        self.names = sorted({r[0] for r in rows})
        number, found, anchors = {x: i for i, x in enumerate(self.names)}, {}, []
        for item, blob in rows:
            words = np.frombuffer(blob, np.uint64)
            n = min(width, len(words))
            starts = np.arange(len(words) - n + 1)
            key = window_hashes(words, starts, n)
            found.setdefault(n, []).append((key, np.full(len(key), number[item], np.int32)))
            small = self.small(words)
            if n < width:
                anchors.append((n, small[None]))
            else:
                spots = np.arange(0, len(words) - self.block + 1, width - self.block + 1)
                anchors.append((0, small[spots[:, None] + np.arange(self.block)]))
        self.anchors = {k: np.unique(np.concatenate([a for n, a in anchors if n == k]), axis=0) for k in sorted({n for n, _ in anchors})}
        self.tables = {}
        for n, parts in found.items():
            key, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.lexsort((item, key))
            key, item = key[by], item[by]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (item[1:] != item[:-1])])
            key, item = key[new], item[new]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            self.tables[n] = key[first], np.append(first, len(key)), item

    @staticmethod
    def small(words: np.ndarray) -> np.ndarray:
        return (words >> np.uint64(48)).astype(np.uint16)

    def automaton(self):
        """Over 16 bits of each word's hash, as two letters, so that no node has many edges.

        Values: 4 * words, and 2 for an anchor, 1 for a short item's only window, 3 for a sequence that is both.
        """
        import ahocorasick

        out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, rows in self.anchors.items():
            for row in rows:
                key = row.tobytes().decode("latin-1")
                if n:
                    out.add_word(key, 4 * n + 1 + (2 if out.exists(key) else 0))
                else:
                    out.add_word(key, 4 * len(row) + 2)
        if self.anchors:
            out.make_automaton()
        return out

    def hits(self, automaton, words: np.ndarray) -> tuple[list[tuple[int, int]], list[str]]:  # noqa: ANN001
        """Runs of words (start, end) inside windows that occur in a text, and the items of these windows."""
        text = self.small(words).tobytes().decode("latin-1")
        ends = [(at >> 1, value) for at, value in automaton.iter(text) if at & 1] if text and self.anchors else []
        if not ends:
            return [], []
        at, value = np.array(ends, np.int64).T
        spans, items = [], []
        late = at[value & 2 > 0]
        if len(late):
            starts = np.unique(late[:, None] - np.arange(self.block - 1, self.width))
            spans.append((self.width, starts[(starts >= 0) & (starts + self.width <= len(words))]))
        for n in np.unique(value[value & 1 > 0] >> 2).tolist():
            spans.append((n, at[(value & 1 > 0) & (value >> 2 == n)] - n + 1))
        cover = np.zeros(len(words) + 1, np.int64)
        for n, starts in spans:
            table, edges, owner = self.tables[n]
            key = window_hashes(words, starts, n)
            spot = np.minimum(np.searchsorted(table, key), len(table) - 1)
            good = table[spot] == key
            np.add.at(cover, starts[good], 1)
            np.add.at(cover, starts[good] + n, -1)
            items += [owner[edges[i] : edges[i + 1]] for i in np.unique(spot[good])]
        inside = np.diff(np.concatenate([[0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]]))
        runs = zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist(), strict=True)
        return list(runs), [self.names[i] for i in np.unique(np.concatenate(items))] if items else []


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of runs, as runs that do not touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def contaminated(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """All columns of docs, and tw_n_words, tw_n_hit, tw_items (sorted ids), tw_spans (hit passages in the original, code points)."""
    batches(spark)
    work = Workspace(spark, "decontamination")
    docs, (text_col,) = aside(docs, [f.name for f in ADDED], text_col)
    at, many = docs.columns.index(text_col), len(docs.columns)
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*docs.schema, *ADDED])])
    items = work.write(pieces(benchmark, item_col, item_text_col, width).distinct(), "pieces")
    size = items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    parts = max(1, -(-int(size) // max_bytes))  # 8 bytes of hash stand for a word, which takes about as many in the text

    def scan(rows: DataFrame, sent, first: bool, last: bool) -> DataFrame:  # noqa: ANN001
        name = uuid.uuid4().hex

        def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if name not in _built:  # a worker that is used again has it
                _built.clear()
                _built[name] = sent.value.automaton()
            hasher, index, found = WordHasher(plain=True), sent.value, _built[name]
            for whole in batches_:
                for lo in range(0, len(whole), 500):
                    batch = whole.slice(lo, 500)
                    words, edge = hasher(batch.column(at))
                    before = None if first else (batch.column(many + 2).to_pylist(), batch.column(many + 3).to_pylist())
                    hits, ids, spans = [], [], []
                    texts = text_buffer(batch.column(at))[1]  # where each text begins in the hasher's bytes
                    for k in range(len(batch)):
                        a, b = int(edge[k]), int(edge[k + 1])
                        runs, own = index.hits(found, words[a:b])
                        if before:
                            own, runs = sorted({*own, *before[0][k]}), merged([*runs, *((r["start"], r["end"]) for r in before[1][k])])
                        hits.append(sum(y - x for x, y in runs))
                        ids.append(own)
                        if last and runs:
                            lead = (hasher.data[texts[k] : texts[k + 1]] & 0xC0) != 0x80  # bytes that begin a code point
                            code = np.concatenate([[0], np.cumsum(lead)])
                            runs = [(int(code[hasher.starts[a + x] - texts[k]]), int(code[hasher.stops[a + y - 1] - texts[k]])) for x, y in runs]
                        spans.append([{"start": x, "end": y} for x, y in runs])
                    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                    told = [pa.array(np.diff(edge)), pa.array(hits, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, span)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:many], *told], names=schema.names)

        return rows.mapInArrow(run, schema)

    out = docs.toDF(*schema.names[:many])
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == k).collect()
        out = scan(out, spark.sparkContext.broadcast(Index([tuple(r) for r in own], width)), k == 0, k == parts - 1)
        if k < parts - 1:
            out = work.write(out, f"part{k}")
            if k:
                work.drop(f"part{k - 1}")
    work.drop("pieces")
    return out.toDF(*docs.columns, *(f.name for f in ADDED))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", F.col("tw_n_words").alias("n_words"), F.col("tw_n_hit").alias("n_hit"), F.size("tw_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("tw_items", ","), 256).alias("items_sha256"), (F.col("tw_n_hit") > 0).alias("contaminated"),
    )
