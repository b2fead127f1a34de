"""Writers: tables as CSV with sorted headers, folder manifests as JSON, reports as text, and what happens where an output exists."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.sources import crops as names

CHUNK = 1 << 20
DATABASE = ".folder_db.json"  # fixed value: a folder's manifest


def filled(spark: SparkSession, path: str) -> bool:
    """Whether path is a folder that holds anything, or a file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at) and len(fs.listStatus(at)) > 0


def write_csv(rows: DataFrame, path: str, overwrite: bool = False, one_file: bool = False) -> None:
    """Columns in alphabetic order under a header; a table without rows gives files without lines. one_file suits reports of a bounded size."""
    out = rows.select(*sorted(rows.columns))
    if one_file:
        out = out.coalesce(1)
    out.write.mode("overwrite" if overwrite else "errorifexists").option("header", not out.isEmpty()).csv(path)


def sorted_json(columns: list[str]) -> Column:
    """One JSON object of a row, keys in alphabetic order, nulls written out."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def write_manifests(manifests: DataFrame, path: str, overwrite: bool = False) -> None:
    """One line of JSON for each folder."""
    manifests.select(sorted_json(manifests.columns).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_report(lines: DataFrame, path: str, order: list[str], line: str = "line", overwrite: bool = False) -> None:
    """A text report in one file, its lines in the order given."""
    lines.orderBy(*order).select(F.col(line).cast("string").alias("value")).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def _place(uri: str):
    """File system and path of a URI or an absolute path; Spark's file:/x has one slash."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri("/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)


def write_files(rows: DataFrame, root: str, mounted: bool = False) -> DataFrame:
    """Writes one file for each row of (dest_folder, dest_name, and content or src, a file to copy) and returns dest and bytes of each. Lazy: files are written as the result is read.

    Executors write in parallel, each file under a name of its own first, which is then renamed: a task that runs again, or twice, leaves whole files only. Two rows of one
    dest are the caller's fault (destination() gives names that differ). A row of null content, or without a name, writes nothing and has null bytes.
    A root on a local disk is for a local session; mounted says that all machines see it.
    """
    local = rows.sparkSession.sparkContext.master.startswith("local")
    if not (local or mounted) and (root.startswith("file:") or "://" not in root):
        raise ValueError(f"{root} is on each machine's own disk; name a shared one, or pass mounted=True")
    copies = "src" in rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _place(root)
        for d in batches:
            out = []
            for folder, name, what in d.itertuples(index=False):
                if folder is None or name is None or what is None:
                    out.append((None, None))
                    continue
                at, part, size = f"{base}/{folder}/{name}", f"{base}/{folder}/.{name}.{uuid.uuid4().hex}", 0
                fs.create_dir(f"{base}/{folder}", recursive=True)
                with fs.open_output_stream(part) as sink:
                    if copies:
                        other, path = _place(what)
                        with other.open_input_stream(path) as source:
                            while piece := source.read(CHUNK):
                                size += sink.write(piece) or len(piece)
                    else:
                        sink.write(bytes(what))
                        size = len(what)
                fs.move(part, at)
                out.append((at, size))
            yield pd.DataFrame(out, columns=["dest", "bytes"]).astype({"bytes": "Int64"})

    return rows.select("dest_folder", "dest_name", "src" if copies else "content").mapInPandas(run, "dest string, bytes long")


def write_crops(crops: DataFrame, root: str, by: str = "person", mounted: bool = False) -> DataFrame:
    """Crops (gid or local_id, frame, seconds, local_id, content: an encoded picture) below person_ or track_ folders; crops of one name in a folder get the same file."""
    folder = names.person_folder(F.col("gid")) if by == "person" else names.track_folder(F.col("local_id"))
    return write_files(crops.select(folder.alias("dest_folder"), names.crop_name(F.col("frame"), F.col("seconds"), F.col("local_id")).alias("dest_name"), "content"), root, mounted)


def write_databases(manifests: DataFrame, root: str, mounted: bool = False) -> DataFrame:
    """One manifest file in each folder, keys in alphabetic order, two blanks a level. A manifest is one row, as its file is one object."""

    @F.pandas_udf("binary")
    def pretty(text: pd.Series) -> pd.Series:
        return text.map(lambda t: json.dumps(json.loads(t), indent=2, sort_keys=True).encode())

    return write_files(manifests.select(F.col("folder").cast("string").alias("dest_folder"), F.lit(DATABASE).alias("dest_name"), pretty(sorted_json(manifests.columns)).alias("content")), root, mounted)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], policy: str = "fail") -> DataFrame:
    """A stage's table at path. Where path holds something: fail raises, overwrite makes it anew, resume reads what is there without making it."""
    if policy not in ("fail", "overwrite", "resume"):
        raise ValueError(f"no such policy: {policy}")
    there = filled(spark, path)
    if there and policy == "fail":
        raise FileExistsError(path)
    if not (there and policy == "resume"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
