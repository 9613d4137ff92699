"""Transcripts as append-only text files: which files, which lines, which records."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Below a root: a project's sessions, their sub-agents, and workflows of those.
DEPTHS = ("*/*.jsonl", "*/*/subagents/*.jsonl", "*/*/subagents/workflows/*/*.jsonl")
ARCHIVE = "archived_sessions"


def at_depths(root: str, path: Column) -> Column:
    """Whether a path lies at one of the three depths below the root."""
    inside = F.substring(path, len(root.rstrip("/")) + 2, 1_000_000)
    patterns = [d.replace(".", r"\.").replace("*", "[^/]*") for d in DEPTHS]
    return path.startswith(root.rstrip("/") + "/") & reduce(lambda a, b: a | b, (inside.rlike(f"^{p}$") for p in patterns))


def not_archived(path: Column) -> Column:
    return path.endswith(".jsonl") & ~path.contains(f"/{ARCHIVE}/")


def of_session(path: Column, session: Column) -> Column:
    """Whether a file may hold a session: by a part of its path, its stem, or its name."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.array_contains(F.split(path, "/"), session) | (F.regexp_replace(name, r"\.[^.]*$", "") == session) | name.contains(session)


def read_lines(spark: SparkSession, paths: list[str], source: str, recursive: bool = False) -> DataFrame:
    """source, path, line, value, torn of text files. A line ends with a line feed and nothing else;
    `torn` is the last one of a file that has none behind it: it is still being written. Files are read in
    splits; the line's number is that of the file."""
    reader = spark.read.option("lineSep", "\n")
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    rows = reader.text(paths).select("value", "_metadata.file_path", "_metadata.file_size", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    if recursive:
        rows = rows.where(not_archived(F.col("file_path")))
    whole, w = Window.partitionBy("file_path"), Window.partitionBy("file_path").orderBy("file_block_start", "at")
    rows = rows.withColumns({"line": F.row_number().over(w), "lines": F.count("*").over(whole), "bytes": F.sum(F.octet_length("value") + 1).over(whole)})
    # The reader leaves out a byte-order mark of three bytes.
    over = F.col("bytes") - F.col("file_size")
    torn = (F.col("line") == F.col("lines")) & over.isin(1, -2)
    return rows.select(F.lit(source).alias("source"), F.col("file_path").alias("path"), "line", "value", torn.alias("torn"))


def complete(lines: DataFrame) -> DataFrame:
    """Lines without a torn tail, whatever it holds: the next scan reads it."""
    return lines.where(~F.col("torn")).drop("torn")


def records(lines: DataFrame) -> DataFrame:
    """`lines` with the readable ones as variant `record`."""
    return lines.withColumn("record", F.try_parse_json("value")).where(F.schema_of_variant("record").startswith("OBJECT<"))


def may_bill_a(value: Column) -> Column:
    """Cheap test before parsing: a billed message, or a line that may set the folder."""
    return (value.contains('"assistant"') & value.contains('"usage"')) | value.contains('"cwd"')


def may_bill_b(value: Column) -> Column:
    return (value.contains('"event_msg"') & value.contains('"token_count"')) | value.contains('"turn_context"') | value.contains('"session_meta"')
