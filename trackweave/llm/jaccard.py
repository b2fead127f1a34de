"""Exact n-gram Jaccard join by grouped prefixes, and the components of its links.

A text's set holds 64-bit hashes of its distinct word shingles. One order of all shingles, common ones last, gives each set a
prefix so long that two sets which link share a prefix shingle. The steps:

1. Equal sets become one class, known by a 128-bit digest of the set (64 bits of it name the class).
2. Every shingle goes to its bucket with its class, and the number of classes that hold it is counted there, exactly; only shingles
   that two classes hold return to their classes. The order is by that count, so that shingles of one class alone, which meet nothing, fill prefixes
   first: most texts without a near copy have nothing else in theirs and drop out. What is left of the prefixes forms lists.
3. A first pass over lists is cheap: in each list the classes stand in an order of their own, by a hash of class and shingle, and only neighbours
   are tested. A group of near copies shares many lists, so that this joins most of it with a few tests for each member. It only saves later work: it
   links nothing that step 4 would not (a test leaves it out); but it does find most links first.
4. All pairs of a list: classes with the same prefix and size are one group; pairs of groups pass a size and a position filter; survivors expand
   to members, without pairs already joined; bitmaps of parities, which bound how far two sets differ, drop most pairs that do not
   link. Long lists are cut into blocks, and pairs of blocks are dealt to tasks.
5. The exact test: 100 * intersection >= threshold * union over whole sets.

Shingles so common that they would fill a bucket (the TOP most frequent of those in COMMON_LOCAL sets of a block of a task, a bounded table) are not sent
to buckets but go last in the order, by the sum of their local counts; any order gives the same links. Set rows are fetched for classes in some
pair, found by a bit table sized to their number within fixed bounds; its false positives cost work, not results.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; fewer words than the shingle
width make one shingle of all words; equal rows are copies; in `membership` documents that share an id count as linked through it, and a null id
is a document without id, whose component is the least id of its class's component; an empty table gives an empty table; other columns
pass through `representatives`, whatever their names, and do not reach `membership`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm.common import Workspace, WordHasher, batches, mix, signed
from trackweave.llm.components import components

WIDTH, PERCENT = 5, 80
COMMON_LOCAL, COMMON_LEAST, TOP, BLOCK = 3, 16, 200_000, 2_000_000
LIST, BITS, BITMAP, BUCKET = 2048, (20, 27), 8, 4_000_000
LATE = 1 << 30  # counts of common shingles stand above all others
MAP = [f"b{i}" for i in range(BITMAP)]


def shingle_sets(hasher: WordHasher, column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and n + 1 offsets."""
    words, at = hasher(column)
    n = np.diff(at)
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for j in range(width if len(total) else 0):
            total += words[j : j + len(total)] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
        total = mix(total)
        owner = np.repeat(np.arange(len(n)), n)
        inside = owner[: len(total)] == owner[width - 1 :][: len(total)] if len(total) else np.zeros(0, bool)
        few = np.flatnonzero((n > 0) & (n < width))
        short = [mix(np.array([sum(int(h) * pow(0xD6E8FEB86659FD93, j + 1, 1 << 64) for j, h in enumerate(words[at[i] : at[i + 1]])) + int(n[i]) & (1 << 64) - 1], np.uint64)) for i in few]
    who = np.concatenate([owner[: len(total)][inside], few]) if len(few) else owner[: len(total)][inside]
    what = np.concatenate([total[inside], *short]) if len(few) else total[inside]
    if len(few):
        order = np.argsort(who, kind="stable")
        who, what = who[order], what[order]
    edges = np.searchsorted(who, np.arange(len(n) + 1))
    sets = [np.unique(what[edges[i] : edges[i + 1]]) for i in range(len(n))]
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Wrapping sum of each run."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[at[1:]] - total[at[:-1]]


def digests(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return mix(sums(mix(sets ^ np.uint64(0xA0761D6478BD642F)), at)), mix(sums(mix(sets ^ np.uint64(0xE7037ED1A0B428DB)), at))


def required(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection with which sets of these sizes link."""
    return -(-percent * (na + nb) // (100 + percent))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """A set that links shares at least ceil(percent n / 100) shingles, so that this many first ones suffice."""
    return n - -(-percent * n // 100) + 1


SKETCH = "kind int, doc_id long, said long, n int, d1 long, d2 long, " + ", ".join(f"b{i} long" for i in range(BITMAP))


def bitmaps(sets: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of each set, 64 * BITMAP parities: two sets differ in at least as many shingles as their bitmaps differ in bits."""
    with np.errstate(over="ignore"):
        bit = (mix(sets ^ np.uint64(0x8EBC6AF09C88C6E3)) % np.uint64(64 * BITMAP)).astype(np.int64)
    n = len(at) - 1
    odd = np.bincount(np.repeat(np.arange(n), np.diff(at)) * 64 * BITMAP + bit, minlength=n * 64 * BITMAP).astype(np.uint8) & 1
    return list(np.packbits(odd.reshape(n, -1), axis=1).view(np.uint64).T.copy()) if n else [np.zeros(0, np.uint64)] * BITMAP


def sketches(spark: SparkSession, docs: DataFrame, width: int) -> DataFrame:
    """docs: doc_id, text, said. Kind 0: a row for each text with its set's size, digest and bitmap. Kind 1: shingles (d1) common in a block, with counts (n)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, block, held = WordHasher(), [], 0
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * (2 + BITMAP)]
        names = [x.split()[0] for x in SKETCH.split(", ")]

        def common() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(block), return_counts=True)
            found, times = found[times >= COMMON_LOCAL], times[times >= COMMON_LOCAL]
            none = pa.nulls(len(found), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(found), np.int32)), none, none, pa.array(times.astype(np.int32)), pa.array(signed(found)), *[none] * (1 + BITMAP)], names=names)

        for batch in rows:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                sets, at = shingle_sets(hasher, part.column(1), width)
                d1, d2 = digests(sets, at)
                values = [np.zeros(len(part), np.int32), part.column(0), part.column(2), np.diff(at).astype(np.int32), signed(d1), signed(d2), *map(signed, bitmaps(sets, at))]
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)
                block.append(sets)
                held += len(sets)
                if held >= BLOCK:
                    yield common()
                    block, held = [], 0
        if block:
            yield common()

    return docs.mapInArrow(run, SKETCH)


def bit_table(ids: DataFrame, column: str) -> np.ndarray:
    """A bit for each id, 16 times as many bits as ids within the powers of two BITS; so many bits / 64 rows reach the driver at most, whatever the input."""
    bits = min(max(BITS[0], (16 * max(1, ids.count())).bit_length()), BITS[1])
    word = F.expr(f"shiftrightunsigned(`{column}`, {64 - bits + 6})").alias("word")
    mask = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {64 - bits}) & 63 as int))").alias("mask")
    rows = ids.select(word, mask).groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return table


def in_table(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bit = ids >> np.uint64(64 - (len(table).bit_length() - 1 + 6))
    return (table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def set_rows(spark: SparkSession, docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(c, items: sorted hashes as bytes) for the classes in ids (column c), and some others; a class once for each task."""
    sent = spark.sparkContext.broadcast(bit_table(ids, "c"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, seen = WordHasher(), sent.value, np.zeros(0, np.uint64)
        for batch in rows:
            for lo in range(0, len(batch), 500):
                sets, at = shingle_sets(hasher, batch.column(1).slice(lo, 500), width)
                d1, _ = digests(sets, at)
                want = np.flatnonzero(in_table(table, d1) & (np.diff(at) > 0))
                want = want[np.unique(d1[want], return_index=True)[1]]
                want = want[~np.isin(d1[want], seen)]
                seen = np.concatenate([seen, d1[want]])[-200_000:]
                yield pa.RecordBatch.from_arrays([pa.array(signed(d1[want])), pa.array([sets[at[i] : at[i + 1]].tobytes() for i in want], pa.binary())], names=["c", "items"])

    return docs.mapInArrow(run, "c long, items binary")


def confirmed(spark: SparkSession, work: Workspace, docs: DataFrame, pairs: DataFrame, width: int, percent: int, tag: str) -> DataFrame:
    """The pairs (a, b) of classes whose sets link."""
    pairs = work.write(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-pairs")
    ids = work.write(pairs.select(F.col("a").alias("c")).unionAll(pairs.select(F.col("b").alias("c"))).distinct(), f"{tag}-ids")
    sets = set_rows(spark, docs, ids, width).join(ids.withColumnRenamed("c", "c2"), F.col("c") == F.col("c2"), "left_semi")
    sets = work.write(sets.dropDuplicates(["c"]), f"{tag}-sets")
    one, two = (sets.select(F.col("c").alias(f"c{x}"), F.col("items").alias(f"items{x}")) for x in "12")
    met = pairs.join(one, F.col("a") == F.col("c1")).join(two, F.col("b") == F.col("c2")).select("a", "b", "items1", "items2")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                place = np.searchsorted(y, x)
                both = int((y[np.minimum(place, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    out = work.write(met.mapInArrow(run, "a long, b long"), f"{tag}-links")
    work.drop(f"{tag}-pairs", f"{tag}-ids", f"{tag}-sets")
    return out


def shingle_rows(spark: SparkSession, docs: DataFrame, common: np.ndarray, counts: np.ndarray, width: int, buckets: int) -> DataFrame:
    """All shingles of a task's classes, packed by bucket of the shingle, and by class in it: 4 bytes each, and 12 for each class of a bucket.

    A shingle is named by its bucket and 32 bits. Common ones are not sent to their bucket, where one could fill it: they go by class, with the
    counts known for them; so does each class's size, in the high half of a name whose count is 0, beside the number of its names.
    """
    sent = spark.sparkContext.broadcast((common, counts))
    names = ["bucket", "classes", "runs", "tokens", "names", "times"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (known, count) = WordHasher(), sent.value
        held, size, seen = [], 0, np.zeros(0, np.uint64)

        def packed() -> pa.RecordBatch:
            owner, owners = np.concatenate([x[0] for x in held]), [len(x[0]) for x in held]
            token = np.concatenate([x[1] for x in held])
            own = np.concatenate([x[2] + shift for x, shift in zip(held, np.cumsum([0, *owners[:-1]]), strict=True)])
            name = (token % np.uint64(buckets)) << np.uint64(32) | token >> np.uint64(32)
            time = np.zeros(len(token), np.int64)
            if len(known):
                spot = np.minimum(np.searchsorted(known, token), len(known) - 1)
                time = np.where(known[spot] == token, LATE + np.minimum(count[spot], LATE), 0)
            n = np.bincount(own, minlength=len(owner))
            by = np.argsort((name >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
            name, own, time = name[by], own[by], time[by]
            blobs: dict[str, list] = {x: [] for x in names}
            plain = np.flatnonzero(time == 0)
            edges = np.searchsorted(name[plain] >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(edges)):
                x = plain[edges[b] : edges[b + 1]]
                start = np.flatnonzero(np.concatenate([[True], own[x][1:] != own[x][:-1]]))
                told = [owner[own[x][start]], np.diff(np.concatenate([start, [len(x)]])).astype(np.uint32), name[x].astype(np.uint32)]
                for k, v in zip(names, [b, *(t.tobytes() for t in told), b"", b""], strict=True):
                    blobs[k].append(v)
            late = np.flatnonzero(time)
            sizes = n.astype(np.uint64) << np.uint64(32) | distinct(own, name, len(owner)).astype(np.uint64)
            own, name, time = np.concatenate([own[late], np.arange(len(owner))]), np.concatenate([name[late], sizes]), np.concatenate([time[late], np.zeros(len(owner), np.int64)])
            to = (owner[own] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[by], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)):
                x = by[edges[b] : edges[b + 1]]
                for k, v in zip(names, [b, owner[own[x]].tobytes(), b"", b"", name[x].tobytes(), time[x].astype(np.uint32).tobytes()], strict=True):
                    blobs[k].append(v)
            return pa.RecordBatch.from_arrays([pa.array(blobs["bucket"], pa.int32()), *(pa.array(blobs[k], pa.binary()) for k in names[1:])], names=names)

        for batch in rows:
            for lo in range(0, len(batch), 500):
                sets, at = shingle_sets(hasher, batch.column(1).slice(lo, 500), width)
                d1, _ = digests(sets, at)
                first = np.zeros(len(d1), bool)
                first[np.unique(d1, return_index=True)[1]] = True
                first &= ~np.isin(d1, seen) & (np.diff(at) > 0)
                seen = np.concatenate([seen, d1[first]])[-200_000:]
                n = np.diff(at)
                held.append((d1[first], sets[np.repeat(first, n)], np.repeat(np.arange(first.sum()), n[first])))
                size += len(held[-1][1])
                if size >= BLOCK:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    return docs.mapInArrow(run, "bucket int, classes binary, runs binary, tokens binary, names binary, times binary")


def distinct(own: np.ndarray, name: np.ndarray, n: int) -> np.ndarray:
    """How many names each class has: fewer than shingles, where two of its shingles share a name."""
    key = np.sort(mix(own.astype(np.uint64) ^ mix(name)))  # 64 bits of (class, name): told apart as shingles are
    count = np.bincount(own, minlength=n)
    if (key[1:] == key[:-1]).any():
        by = np.lexsort((name, own))
        again = (own[by][1:] == own[by][:-1]) & (name[by][1:] == name[by][:-1])
        count -= np.bincount(own[by][1:][again], minlength=n)
    return count


def _joined(parts: list[pa.RecordBatch], column: str, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for b in parts for x in b.column(column).to_pylist())])


def counted(rows: DataFrame, buckets: int) -> DataFrame:
    """Shingles that two classes or more hold, with how many do, packed by bucket of the class; what was sent by class passes through."""
    names = ["bucket", "classes", "runs", "names", "times"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in parts if len(b)]
        bucket = np.uint64(parts[0].column("bucket")[0].as_py())
        passing = [pc.equal(pc.binary_length(b.column("tokens")), 0) for b in parts]
        by_token, by_class = ([b.filter(pc.invert(p)) for b, p in zip(parts, passing, strict=True)], [b.filter(p) for b, p in zip(parts, passing, strict=True)])
        owner, own = np.unique(_joined(by_token, "classes", np.uint64), return_inverse=True)
        own = np.repeat(own.astype(np.uint64), _joined(by_token, "runs", np.uint32))
        key = np.unique(_joined(by_token, "tokens", np.uint32).astype(np.uint64) << np.uint64(32) | own)
        token = key >> np.uint64(32)
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([start, [len(key)]])).astype(np.int64)
        times = np.repeat(times, times)
        keep = np.flatnonzero(times > 1)
        classes = np.concatenate([owner[(key[keep] & np.uint64(0xFFFFFFFF)).astype(np.int64)], _joined(by_class, "classes", np.uint64)])
        name = np.concatenate([bucket << np.uint64(32) | token[keep], _joined(by_class, "names", np.uint64)])
        times = np.concatenate([times[keep].astype(np.uint32), _joined(by_class, "times", np.uint32)])
        to = (classes >> np.uint64(20)) % np.uint64(buckets)
        by = np.lexsort((classes, to))
        classes, name, times, to = classes[by], name[by], times[by], to[by]
        edges = np.searchsorted(to, np.arange(buckets + 1, dtype=np.uint64))
        blobs: list[list] = [[] for _ in names]
        for b in np.flatnonzero(np.diff(edges)):
            x = slice(edges[b], edges[b + 1])
            first = np.flatnonzero(np.concatenate([[True], classes[x][1:] != classes[x][:-1]]))
            told = [classes[x][first], np.diff(np.concatenate([first, [edges[b + 1] - edges[b]]])).astype(np.uint32), name[x], times[x]]
            for out, v in zip(blobs, [b, *(t.tobytes() for t in told)], strict=True):
                out.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(blobs[0], pa.int32()), *(pa.array(x, pa.binary()) for x in blobs[1:])], names=names)

    return rows.groupBy("bucket").applyInArrow(run, "bucket int, classes binary, runs binary, names binary, times binary")


def prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """(t, place, c, g, n): of each class the shingles of its prefix that others hold too.

    The order is by the number of classes that hold a shingle. Those of one class alone come first and fill prefixes for nothing: a class whose
    prefix they fill links with none, and drops out here. g names a prefix and size.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in parts if len(b)]
        owner, own = np.unique(_joined(parts, "classes", np.uint64), return_inverse=True)
        own = np.repeat(own, _joined(parts, "runs", np.uint32))
        name, times = _joined(parts, "names", np.uint64), _joined(parts, "times", np.uint32)
        whole = times == 0
        n, held = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        n[own[whole]], held[own[whole]] = (name[whole] >> np.uint64(32)).astype(np.int64), (name[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        own, name, times = own[~whole], name[~whole], times[~whole]
        by = np.lexsort((name, times, own))  # a class sent by several tasks has its common shingles several times, beside each other
        own, name = own[by], name[by]
        once = np.concatenate([[True], (own[1:] != own[:-1]) | (name[1:] != name[:-1])]) if len(own) else np.zeros(0, bool)
        own, name = own[once], name[once]
        shared = np.bincount(own, minlength=len(owner))
        place = np.arange(len(own)) - np.repeat(np.cumsum(shared) - shared, shared) + (held - shared)[own]
        keep = place < prefix_length(n, percent)[own]
        own, name, place = own[keep], name[keep], place[keep]
        edge = np.searchsorted(own, np.arange(len(owner) + 1))
        with np.errstate(over="ignore"):
            group = mix(sums(mix(name), edge) + (n << 32 | held - shared).astype(np.uint64))
        out = [signed(name), place.astype(np.int32), signed(owner[own]), (group[own] >> np.uint64(32)).astype(np.int64), n[own].astype(np.int32)]
        for lo in range(0, len(own), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000]) for x in out], names=["t", "place", "c", "g", "n"])

    return rows.groupBy("bucket").applyInArrow(run, "t long, place int, c long, g long, n int")


def list_pairs(t: np.ndarray, block: np.ndarray, other: np.ndarray, place: np.ndarray, c: np.ndarray, g: np.ndarray, n: np.ndarray, root: np.ndarray, bits: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes in lists sorted by t: groups first, size and position filters, then members of different components, then bitmaps."""
    start = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1])]))
    for a, b in zip(start, [*start[1:], len(t)], strict=True):
        if b - a < 2 or (root[a:b] == root[a]).all():
            continue
        order = a + np.lexsort((g[a:b], n[a:b]))
        heads = np.flatnonzero(np.concatenate([[True], (n[order][1:] != n[order][:-1]) | (g[order][1:] != g[order][:-1])]))
        ends = np.concatenate([heads[1:], [len(order)]])
        size, spot = n[order][heads], place[order][heads]
        member = np.repeat(np.arange(len(heads)), ends - heads)
        for x in range(len(heads)):
            to = int(np.searchsorted(size, 100 * size[x] // percent, "right"))
            fits = np.minimum(size[x] - spot[x], size[x:to] - spot[x:to]) >= required(size[x], size[x:to], percent)
            if not fits.any():
                continue
            two = order[heads[x] : ends[to - 1]][fits[member[heads[x] : ends[to - 1]] - x]]
            for m in order[heads[x] : ends[x]]:
                rest = two[(root[two] != root[m]) & (block[two] == other[m]) & (block[m] == other[two])]
                if len(rest):
                    apart = np.bitwise_count(bits[rest] ^ bits[m]).sum(axis=1, dtype=np.int64)
                    rest = rest[n[m] + n[rest] - 2 * required(n[m], n[rest], percent) >= apart]
                    yield np.full(len(rest), c[m]), c[rest]


def neighbours(key: np.ndarray, t: np.ndarray, place: np.ndarray, c: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours in lists (key), each in an order of its own, that pass the size, position and bitmap filters."""
    with np.errstate(over="ignore"):
        order = np.lexsort((mix(c.view(np.uint64) ^ mix(t.view(np.uint64))), key))
    x, y = order[:-1], order[1:]
    need = required(n[x], n[y], percent)
    fits = (key[x] == key[y]) & (np.minimum(n[x], n[y]) >= need) & (np.minimum(n[x] - place[x], n[y] - place[y]) >= need)
    x, y, need = x[fits], y[fits], need[fits]
    apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
    fits = n[x] + n[y] - 2 * need >= apart
    return c[x][fits], c[y][fits]


def candidates(spark: SparkSession, lists: DataFrame, classes: DataFrame, percent: int, tasks: int, chain: bool) -> DataFrame:
    """Pairs (a, b) of classes of different components that share a prefix shingle and pass the filters: neighbours only (chain), or all. lists: t, place, c, g, n, k (how many hold t). classes: c, root."""
    own = classes.select(F.col("c").alias("c2"), "root", *MAP)
    rows = lists.join(own, F.col("c") == F.col("c2")).drop("c2")
    rows = rows.withColumn("block", F.when(F.col("k") > LIST, F.pmod(F.col("c"), F.ceil(F.col("k") / LIST))).otherwise(F.lit(0)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.when(F.col("k") > LIST, F.sequence(F.lit(0), F.ceil(F.col("k") / LIST).cast("int") - 1)).otherwise(F.array(F.lit(0)))))
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    rows = rows.withColumn("task", F.pmod(F.xxhash64("t", "lo", "hi"), F.lit(tasks)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(parts))
        get = {x: table[x].to_numpy() for x in ("t", "lo", "hi", "block", "other", "place", "c", "g", "n", "root", *MAP)}
        order = np.lexsort((get["hi"], get["lo"], get["t"]))
        x = {k: v[order] for k, v in get.items()}
        key = np.cumsum(np.concatenate([[0], (x["t"][1:] != x["t"][:-1]) | (x["lo"][1:] != x["lo"][:-1]) | (x["hi"][1:] != x["hi"][:-1])]))
        bits = np.stack([x[b].view(np.uint64) for b in MAP], axis=1)
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            a, b = (np.concatenate(v) for v in zip(*held, strict=True))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        if chain:
            held.append(neighbours(key, x["t"], x["place"].astype(np.int64), x["c"], x["n"].astype(np.int64), bits, percent))
            yield sent()
            return
        for pair in list_pairs(key, x["block"], x["other"], x["place"].astype(np.int64), x["c"], x["g"], x["n"].astype(np.int64), x["root"], bits, percent):
            held.append(pair)
            size += len(pair[0])
            if size > 500_000:
                yield sent()
                held, size = [], 0
        if held:
            yield sent()

    return rows.select("task", "t", "lo", "hi", "block", "other", "place", "c", "g", "n", "root", *MAP).groupBy("task").applyInArrow(run, "a long, b long")


def resolved(spark: SparkSession, work: Workspace, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, said: hash of the text, n, d1) of docs, the classes (c, rep), and edges (a, b) that connect the classes that link."""
    batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("said", F.xxhash64("text"))
    sketch = work.write(sketches(spark, texts, width), "sketch")
    rows = sketch.where("kind = 0")
    classes = work.write(
        rows.where("n > 0").groupBy(F.col("d1").alias("c"), "d2", "n").agg(F.min("doc_id").alias("rep"), *[F.min(b).alias(b) for b in MAP]), "classes"
    )
    often = sketch.where("kind = 1").groupBy("d1").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_LEAST).orderBy(F.desc("n"), "d1").limit(TOP).toPandas()
    order = np.argsort(often["d1"].to_numpy(np.int64).view(np.uint64))
    common, counts = often["d1"].to_numpy(np.int64).view(np.uint64)[order], often["n"].to_numpy(np.int64)[order]
    total = int(rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 20, total // BUCKET))
    rare = work.write(prefixes(counted(shingle_rows(spark, texts, common, counts, width, tasks), tasks), percent), "prefixes")
    held = rare.groupBy(F.col("t").alias("t2")).agg(F.count("*").alias("k")).where("k > 1")
    lists = work.write(rare.join(held, F.col("t") == F.col("t2")).drop("t2"), "lists")
    work.drop("prefixes")
    early = confirmed(spark, work, texts, candidates(spark, lists, classes.withColumn("root", F.col("c")), percent, tasks, True), width, percent, "early")
    first = components(work, early, "first")
    roots = work.write(classes.join(first, F.col("c") == F.col("node"), "left").select("c", F.coalesce("root", "c").alias("root"), *MAP), "roots")
    late = confirmed(spark, work, texts, candidates(spark, lists, roots, percent, tasks, False), width, percent, "late")
    work.drop("lists", "roots")
    return rows.select("doc_id", "said", "n", "d1"), classes.select("c", "rep"), early.unionAll(late)


def membership(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, component) for each row: set size, and the least id reachable by links, itself included."""
    work = Workspace(spark, "jaccard")
    rows, classes, links = resolved(spark, work, docs, id_col, text_col, width, percent)
    # documents that share an id are linked through it
    same = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).where("a <> b").select("a", "b")
    final = components(work, links.unionAll(same), "final")
    named = work.write(classes.join(final, F.col("c") == F.col("node"), "left").select("c", "rep", F.coalesce("root", "c").alias("root")), "roots")
    ids = work.write(named.groupBy(F.col("root").alias("root2")).agg(F.min("rep").alias("component")), "ids")
    told = work.write(named.join(ids, F.col("root") == F.col("root2")).select("c", "component"), "named")
    work.drop("classes", "early-links", "late-links", "roots", "ids")
    full = rows.where("n > 0").join(told, F.col("d1") == F.col("c")).select("doc_id", "n", "component")
    return full.unionAll(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))


def representatives(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay: of each component one of least id (rows without id come after all others), and all rows whose set is empty.

    Rows are named by id and text: numbers given at a scan may differ at the next one, when executors were lost in between. So rows that share an
    id but not a text are judged apart, and of rows that share both (and differ in other columns) the least stays.
    """
    work = Workspace(spark, "representatives")
    rows, classes, links = resolved(spark, work, docs, id_col, text_col, width, percent)
    final = components(work, links, "final")
    roots = work.write(classes.join(final, F.col("c") == F.col("node"), "left").select("c", F.coalesce("root", "c").alias("root")), "roots")
    best = rows.where("n > 0").groupBy("d1").agg(F.min(F.struct(F.isnull("doc_id").alias("lone"), "doc_id", "said")).alias("one"))
    best = work.write(best, "best").join(roots, F.col("d1") == F.col("c")).groupBy("root").agg(F.min("one").alias("one")).select("one.*")
    many = rows.where("n > 0").groupBy(F.col("doc_id").alias("id2"), F.col("said").alias("said2")).count()
    kept = best.join(many, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("said") == F.col("said2")))
    kept = work.write(kept.select(F.col("doc_id").alias("tw_id"), F.col("said").alias("tw_said"), F.col("count").alias("tw_k")), "kept")
    empty = rows.where("n = 0").select(F.col("doc_id").alias("tw_id"), F.col("said").alias("tw_said"), F.lit(1).alias("tw_k")).distinct()
    work.drop("classes", "early-links", "late-links", "roots", "best")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at, text = plain.columns[docs.columns.index(id_col)], plain.columns[docs.columns.index(text_col)]
    met = F.col(at).cast("long").eqNullSafe(F.col("tw_id")) & (F.xxhash64(F.col(text)) == F.col("tw_said"))
    out = plain.join(kept.where("tw_k = 1").unionAll(empty), met, "left_semi")
    if kept.where("tw_k > 1").head(1):
        order = [c.name for c in plain.schema if "map<" not in c.dataType.simpleString() and "variant" not in c.dataType.simpleString()]
        again = plain.join(kept.where("tw_k > 1"), met, "left_semi").groupBy(F.col(at).cast("long").alias("tw_id"), F.xxhash64(F.col(text)).alias("tw_said"))
        out = out.unionAll(again.agg(F.min_by(F.struct(*plain.columns), F.struct(*order)).alias("tw_one")).select("tw_one.*"))
    return out.toDF(*docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return membership(spark, docs).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))
