"""BPE encoding and decoding with a contiguous rank array per word.

A word's parts lie in one array beside the ranks of each part with its right neighbour. The least rank is
found by a scan, the boundary behind it is deleted, and the two ranks next to it are looked up anew, until no
pair has a rank. Words over SHORT parts, for which scans would take quadratic time, use a heap of the same ranks
(least rank first, leftmost first), with equal results. Words repeat, so that each task keeps what it has encoded, up
to KEPT words; then it begins anew.

The vocabulary file (the tokenizers library's JSON of a BPE with an end-of-word suffix) is a path parameter. Its text is
read by the driver and broadcast; FILE_BYTES bounds it.

Defined cases: a null text is an empty one: no ids, and decoding gives ''. Special tokens in a text become their ids, as in
the library. Repeated rows are encoded row by row, an empty table gives an empty table, other columns pass through
(see `aside` for names that clash).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import aside, batches

SHORT, KEPT, FILE_BYTES = 96, 250_000, 32 << 20

#: Fixed values of byte-level vocabularies: bytes that stand for themselves; the others follow from code point 256 on, in order.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_symbols() -> list[str]:
    rest = iter(range(256, 512))
    return [chr(b) if b in PRINTABLE else chr(next(rest)) for b in range(256)]


class Encoder:
    """Text -> ids, ids -> text, for one vocabulary."""

    def __init__(self, content: str):
        import regex

        spec = json.loads(content)
        model, steps, splits = spec["model"], spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"] or spec["decoder"]:
            raise ValueError("this vocabulary file needs steps that are not known here")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.names = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.inner = [vocab.get(s, -1) for s in byte_symbols()]
        self.final = [vocab.get(s + suffix, -1) for s in byte_symbols()]
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.spaces, self.blank = regex.compile(steps[1]["pattern"]["Regex"]), steps[1]["content"]
        self.words = regex.compile(splits[0]["pattern"]["Regex"])
        self.special = {t["content"]: t for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.kept: dict[str, tuple[str, str]] = {}

    def merged(self, word: str) -> list[int]:
        """Ids of one word."""
        data = word.encode()
        parts = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        return self.long(parts) if len(parts) > SHORT else self.short(parts)

    def short(self, parts: list[int]) -> list[int]:
        none = (1 << 60, 0)
        get = self.ranks.get
        ranks = [get(a << 32 | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least is none:
                break
            at = ranks.index(least)
            parts[at] = least[1]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get(parts[at] << 32 | parts[at + 1], none)
            if at:
                ranks[at - 1] = get(parts[at - 1] << 32 | parts[at], none)
        return parts

    def long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (found := self.ranks.get(parts[i] << 32 | parts[after[i]])):
                heapq.heappush(heap, (found[0], i, parts[i], parts[after[i]], found[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [p for p in parts if p >= 0]

    def plain(self, text: str) -> list[str]:
        """Words of text between special tokens, after the vocabulary's normalisation."""
        import unicodedata

        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the library lower-cases each character alone
        return self.words.findall(self.spaces.sub(self.blank, text).lower())

    def entry(self, word: str) -> tuple[str, str]:
        ids = self.merged(word)
        if len(self.kept) >= KEPT:
            self.kept.clear()
        self.kept[word] = found = (" ".join(map(str, ids)), self.decode(ids))
        return found

    def both(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by spaces, and the decoded text."""
        pieces: list[tuple[str, str]] = []
        get, entry, at = self.kept.get, self.entry, 0
        for m in [*(self.cut.finditer(text) if self.cut else ()), None]:
            pieces += [get(w) or entry(w) for w in self.plain(text[at : m.start() if m else len(text)])]
            if m:
                pieces.append((str(self.special[m[0]]["id"]), m[0]))
                at = m.end()
        return " ".join([p[0] for p in pieces]), " ".join([p[1] for p in pieces])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.both(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The library's decode without a decoder: the tokens' names, joined by spaces; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


def encoded(spark: SparkSession, docs: DataFrame, path: str, text_col: str = "text", ids: bool = True) -> DataFrame:
    """All columns of docs, and tw_n_tokens, tw_ids (array, if ids), tw_ids_sha256, tw_decoded_sha256."""
    import hashlib

    batches(spark)
    with open(path, encoding="utf-8") as f:
        content = f.read(FILE_BYTES + 1)
    if len(content) > FILE_BYTES:
        raise ValueError("the vocabulary file is too large to broadcast")
    sent = spark.sparkContext.broadcast(content)
    fields = [("tw_n_tokens", T.LongType()), *([("tw_ids", T.ArrayType(T.IntegerType()))] if ids else []), ("tw_ids_sha256", T.StringType()), ("tw_decoded_sha256", T.StringType())]
    docs, (text_col,) = aside(docs, [n for n, _ in fields], text_col)
    names = [*docs.columns, *(n for n, _ in fields)]
    schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate([*(f.dataType for f in docs.schema), *(t for _, t in fields)])])
    at = docs.columns.index(text_col)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in rows:
            n, lists, one, two = [], [], [], []
            for text in batch.column(at).to_pylist():
                told, back = encoder.both(text or "")
                n.append(told.count(" ") + 1 if told else 0)
                if ids:
                    lists.append([int(x) for x in told.split()])
                one.append(hashlib.sha256(told.encode()).hexdigest())
                two.append(hashlib.sha256(back.encode()).hexdigest())
            extra = [pa.array(n, pa.int64()), *([pa.array(lists, pa.list_(pa.int32()))] if ids else []), pa.array(one, pa.string()), pa.array(two, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema).toDF(*names)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encoded(spark, docs, public_tokenizers.path("word_bpe_49k.json"), ids=False)
    return found.select("doc_id", F.col("tw_n_tokens").alias("n_tokens"), F.col("tw_ids_sha256").alias("ids_sha256"), F.col("tw_decoded_sha256").alias("decoded_sha256"))
