"""Text files of a shared folder, written and read by the executors, whatever the file system is."""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that one task reads of a file at a time.
PIECE = 32 * 1024 * 1024


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


def write_files(lines: DataFrame, base: str) -> int:
    """Writes the files of `lines` (path below `base`, line, value, torn); behind a torn line is no line
    feed. A file is written whole by one task, again if the task is. Returns their number."""
    def write(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("line")
        data = "".join(v if torn else f"{v}\n" for v, torn in zip(frame["value"].fillna(""), frame["torn"])).encode()
        system, path = file_system(f"{base}/{frame['path'].iloc[0]}")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path) as out:
            out.write(data)
        return pd.DataFrame({"n": [len(data)]})

    return lines.select("path", "line", "value", "torn").groupBy("path").applyInPandas(write, "n long").count()


def lines_of(uri: str, begin: int, end: int) -> Iterator[tuple[int, str]]:
    """offset, line of the lines whose line feed lies in begin..end of the file."""
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        start = begin
        while start > 0:  # back to where the line that `begin` cuts began
            step = min(65_536, start)
            at = f.read_at(step, start - step).rfind(b"\n")
            if at >= 0:
                start = start - step + at + 1
                break
            start -= step
        rest, at = b"", start
        while at < end:
            data = f.read_at(min(1 << 20, end - at), at)
            if not data:
                return
            at += len(data)
            *whole, rest = (rest + data).split(b"\n")
            for line in whole:
                yield start, line.decode("utf-8", "replace")
                start += len(line) + 1


def read_from(plan: DataFrame) -> DataFrame:
    """path, offset, value of the complete lines of each file of `plan` (path, begin, size) from its byte
    `begin` on. Large ranges are split, so that a file isn't one task's."""
    pieces = plan.where("size > begin").select("path", F.col("size").cast("long").alias("size"), F.explode(F.sequence(F.col("begin").cast("long"), F.col("size") - 1, F.lit(PIECE))).alias("begin"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, begin in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[tuple[int, str]] = []
                lines = lines_of(path, begin, min(begin + PIECE, size))
                while True:
                    rows = [row for _, row in zip(range(10_000), lines)]
                    if not rows:
                        break
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([o for o, _ in rows], pa.int64()), pa.array([v for _, v in rows])], ["path", "offset", "value"])

    return pieces.repartition("path", "begin").mapInArrow(read, "path string, offset bigint, value string")


def listing(spark, base: str, suffix: str = ".jsonl") -> DataFrame:  # noqa: ANN001
    """path, size, modified (milliseconds) of the files below a folder; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(base)
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"))
