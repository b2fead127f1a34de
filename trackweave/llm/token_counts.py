"""Token counts by section or field: each document is encoded once as a whole, and its tokens are attributed to sections by their spans.

Tokens of a byte-level vocabulary (a tiktoken file) have byte spans; sections are character spans of the text, here its lines with the line
ends that follow them. The interval join is a search in both sorted lists. A token that crosses a boundary goes to the section that holds
most of its bytes; of equal shares to the earlier one.

The file's path is a parameter; its bytes are read by the driver and broadcast, at most FILE_BYTES.

Defined cases: a null or empty text has no sections and no tokens, and so no rows (of several fields, each has a row); text without line ends is one section;
repeated rows are counted row by row; an empty table gives an empty table. The result has the id and the columns below, whatever other columns there are; an id
column named as one of them is returned as <name>_in.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import batches

FILE_BYTES, SEPARATOR = 32 << 20, "\n"


def lines(text: bytes) -> np.ndarray:
    """Byte offsets of the lines' ends, each with its line end."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


def attributed(token_ends: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token its section, and whether it crosses a boundary. Ends are byte offsets; both lists cover the text."""
    starts = np.concatenate([[0], token_ends[:-1]])
    first, last = np.searchsorted(section_ends, starts, "right"), np.searchsorted(section_ends, token_ends, "left")
    own = first.copy()
    for i in np.flatnonzero(first != last):
        cuts = np.concatenate([[starts[i]], section_ends[first[i] : last[i]], [token_ends[i]]])
        own[i] += int(np.argmax(np.diff(cuts)))  # the first of equal shares
    return own, first != last


def sectioned(spark: SparkSession, docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str | list[str] = "text", splitter=lines) -> DataFrame:  # noqa: ANN001
    """(id, section, start, end, n_tokens, n_crossing): a row for each section; start and end in code points."""
    batches(spark)
    with open(path, "rb") as f:
        content = f.read(FILE_BYTES + 1)
    if len(content) > FILE_BYTES:
        raise ValueError("the vocabulary file is too large to broadcast")
    sent = spark.sparkContext.broadcast(content)
    kinds = [("section", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType()), ("n_tokens", T.LongType()), ("n_crossing", T.LongType())]
    fields = [text_col] if isinstance(text_col, str) else text_col
    rows = docs.select(F.col(id_col).alias("id"), F.array(*(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)).alias("text"))
    name = id_col if id_col.lower() not in [n for n, _ in kinds] else id_col + "_in"
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in kinds)])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        for batch in rows:
            ids, parts = [], [[np.zeros(0, np.int64)] for _ in kinds]
            for k, parts_ in enumerate(batch.column(1).to_pylist()):
                text = SEPARATOR.join(parts_)
                data = text.encode()
                if len(fields) > 1:
                    ends = np.cumsum([len(x.encode()) + len(SEPARATOR) for x in parts_]) - np.append(np.zeros(len(fields) - 1, np.int64), len(SEPARATOR))
                elif not text:
                    continue
                else:
                    ends = splitter(data)
                own, crossing = attributed(np.cumsum(size[np.array(coder.encode_ordinary(text), np.int64)]), ends)
                char = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[np.concatenate([[0], ends])]
                ids.append(np.full(len(ends), k))
                for out, x in zip(parts, (np.arange(len(ends)), char[:-1], char[1:], np.bincount(own, minlength=len(ends)), np.bincount(own[crossing], minlength=len(ends))), strict=True):
                    out.append(x)
            keep = batch.column(0).take(pa.array(np.concatenate([np.zeros(0, np.int64), *ids])))
            yield pa.RecordBatch.from_arrays([keep, *(pa.array(np.concatenate(x), pa.int32() if n == "section" else pa.int64()) for x, (n, _) in zip(parts, kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", name)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sectioned(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).withColumnsRenamed({"start": "start_char", "end": "end_char"})
