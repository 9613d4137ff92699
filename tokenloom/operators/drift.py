"""Schemas that drift between files: one consistent table, and a list of every change.

The schema of each line is read in the JVM, reduced to the distinct schemas of each file by
partial aggregation, and folded per file and leaf path through a type lattice:

    none < boolean, none < whole < decimal < text, boolean < text, everything < text

Consecutive files of a feed are then compared; only pairs that differ leave the JVM. Where fields
disappear while others appear, the values of just these two files are profiled (`PROFILE`), and a
pair of fields is a rename if names and values go together (`likeness`), under one-to-one
assignment, best first. Names are compared word by word, equal, one the beginning or the
abbreviation of the other; a word counts the more the fewer of the files' fields have it. A
numbered part of a name, as in `write_5m`, must agree. No list of names or synonyms is built in.

Defined cases: a line that isn't a JSON object (null, blank, torn, a key twice) is not a
record; a file without records has no fields; a field that is null on every line is there but
has no type, and is never retyped; a list is a leaf of type text; an empty object is no leaf;
repeated lines change nothing in the schema and stay in the table; a null feed is the feed named
by the empty string; lines without a file number belong to no file and change nothing; extra
columns are ignored.
"""

import json
import re
from collections import Counter
from collections.abc import Iterator
from math import log1p, sqrt
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.operators.graph import checkpointed

BOOLEAN, WHOLE, DECIMAL, TEXT = 1, 2, 4, 8
#: What two names must have in common, as a share of the weight of their words; where a field has no
#: values; where one holds numbers and the other none; and below which text must look alike.
LEAST, LEAST_UNSEEN, LEAST_UNLIKE, LEAST_OTHER_SHAPE = 0.34, 0.5, 0.85, 0.6
#: What a word is worth that begins with the other one, or has its abbreviation in it.
BEGINS, ABBREVIATES = 0.9, 0.8


def kind_of(bits: int) -> str:
    """The lattice's join of the types whose bits are set."""
    if not bits:
        return ""
    if bits in (BOOLEAN, WHOLE):
        return "boolean" if bits == BOOLEAN else "whole"
    return "decimal" if bits & (DECIMAL | WHOLE) == bits else "text"


def leaves_of(schema: str) -> list[tuple[str, int]]:
    """Leaf paths and type bits of a variant schema such as OBJECT<a: BIGINT, b: OBJECT<c: VOID>>."""
    out: list[tuple[str, int]] = []

    def end_of_type(i: int) -> int:
        depth, quoted = 0, False
        while i < len(schema):
            c = schema[i]
            if c == "`":
                quoted = not quoted
            elif not quoted:
                if c in "<(":
                    depth += 1
                elif c in ">)":
                    if depth == 0:
                        return i
                    depth -= 1
                elif c == "," and depth == 0:
                    return i
            i += 1
        return i

    def walk(i: int, prefix: str) -> int:
        """From just behind OBJECT< to just behind its >."""
        while schema[i] != ">":
            if schema[i] == "`":
                j = i + 1
                while schema[j] != "`" or schema[j : j + 2] == "``":
                    j += 2 if schema[j : j + 2] == "``" else 1
                name, i = schema[i + 1 : j].replace("``", "`"), j + 3
            else:
                j = schema.index(":", i)
                name, i = schema[i:j], j + 2
            path = f"{prefix}.{name}" if prefix else name
            if schema.startswith("OBJECT<", i):
                i = walk(i + 7, path)
            else:
                j = end_of_type(i)
                out.append((path, bits_of(schema[i:j])))
                i = j
            if schema.startswith(", ", i):
                i += 2
        return i + 1

    walk(7, "")
    return out


def bits_of(kind: str) -> int:
    if kind == "VOID":
        return 0
    if kind == "BOOLEAN":
        return BOOLEAN
    if kind in ("BIGINT", "INT", "SMALLINT", "TINYINT"):
        return WHOLE
    if m := re.fullmatch(r"DECIMAL\((\d+),(\d+)\)", kind):
        return WHOLE if m[2] == "0" and int(m[1]) > 18 else DECIMAL
    return DECIMAL if kind in ("DOUBLE", "FLOAT") else TEXT


def words(path: str) -> list[str]:
    """The words of a path's name, each once, whatever their spelling."""
    return list(dict.fromkeys(w.lower() for w in re.findall(r"\d+[a-z]+|[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^\W\d_]+", path)))


def word_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if short[0].isdigit() or long[0].isdigit() or short[0] != long[0]:
        return 0.0
    if len(short) > 2 and long.startswith(short):
        return BEGINS
    rest = iter(long)
    return ABBREVIATES if len(short) > 1 and not set(short[1:]) & set("aeiou") and all(c in rest for c in short) else 0.0


def weights(paths: set[str]) -> dict[str, float]:
    """What each word of the paths' names is worth."""
    return {w: 1 / sqrt(n) for w, n in Counter(w for p in paths for w in words(p)).items()}


def similarity(a: str, b: str, worth: dict[str, float]) -> float:
    """The share of two names' weight that their words have in common, each word paired once."""
    x, y = words(a), words(b)
    if {w for w in x if w[0].isdigit()} != {w for w in y if w[0].isdigit()}:
        return 0.0
    common, left, right = 0.0, set(x), set(y)
    for like, v, w in sorted(((word_likeness(v, w), v, w) for v in x for w in y), key=lambda t: (-t[0], t[1], t[2])):
        if like and v in left and w in right:
            left.remove(v)
            right.remove(w)
            common += like * (worth[v] + worth[w])
    return common / (sum(worth[w] for w in (*x, *y)) or 1)


class Seen(NamedTuple):
    """The values of a field in a file, as sums that can be added up."""

    n: int = 0
    #: whether all of them are or spell numbers
    numeric: bool = True
    #: one bit for each shape of text, digits and letters alike
    shapes: int = 0
    #: smallest and largest hash: equal for the same set of values
    low: int = (1 << 63) - 1
    high: int = -(1 << 63)
    #: of the logarithms of their sizes
    size: float = 0.0

    def and_value(self, value: object) -> "Seen":
        if value is None:
            return self
        text = str(value).lower() if isinstance(value, bool) else str(value)
        try:
            size, number = log1p(abs(float(text))), True
        except ValueError:
            size, number = 0.0, False
        shape = re.sub(r"[a-z]+", "a", re.sub(r"\d+", "9", text.lower()))
        h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
        return Seen(self.n + 1, self.numeric and number, self.shapes | 1 << xxhash.xxh64_intdigest(shape.encode("utf-8", "surrogatepass")) % 63, min(self.low, h), max(self.high, h), self.size + size)


#: How the parts of `Seen` are added up, and their types.
PROFILE = {"n": (F.sum, "bigint"), "numeric": (F.bool_and, "boolean"), "shapes": (F.bit_or, "bigint"), "low": (F.min, "bigint"), "high": (F.max, "bigint"), "size": (F.sum, "double")}


def likeness(a: str, b: str, before: Seen, after: Seen, worth: dict[str, float]) -> tuple[float, float]:
    """(by names, by values) of two fields that may be the same one; zeros if they can't be."""
    name = similarity(a, b, worth)
    numbers = before.numeric and after.numeric
    same = (before.low, before.high) == (after.low, after.high)
    if not before.n or not after.n:
        values, least = 0.5, LEAST_UNSEEN
    elif before.numeric != after.numeric:
        values, least = 0.0, LEAST_UNLIKE
    elif numbers:
        values, least = max(0.0, 1 - abs(before.size / before.n - after.size / after.n) / 5), LEAST
    else:
        values = 1.0 if same else 0.5 if before.shapes & after.shapes else 0.0
        least = LEAST if values else LEAST_OTHER_SHAPE
    # The last parts of the paths must have a word in common, or the fields the same text.
    last = any(word_likeness(v, w) for v in words(a.rpartition(".")[2]) for w in words(b.rpartition(".")[2]))
    if not last and (numbers or not same or not before.n):
        return 0.0, 0.0
    return (name, values) if name >= least else (0.0, 0.0)


def changes(before: dict[str, int], after: dict[str, int], seen_before: dict[str, Seen] | None = None, seen_after: dict[str, Seen] | None = None) -> list[tuple[str, str, str]]:
    """(kind, field before, field after) between the fields of two files."""
    gone, new = sorted(before.keys() - after.keys()), sorted(after.keys() - before.keys())
    worth = weights(before.keys() | after.keys()) if gone and new else {}
    seen = lambda of, path: (of or {}).get(path, Seen())
    pairs = sorted(((*likeness(a, b, seen(seen_before, a), seen(seen_after, b), worth), a, b) for a in gone for b in new), key=lambda p: (-p[0], -p[1], p[2], p[3]))
    out, used_before, used_after = [], set(), set()
    for name, _, a, b in pairs:
        if name and a not in used_before and b not in used_after:
            used_before.add(a)
            used_after.add(b)
            out.append(("renamed", a, b))
    out += [("removed", a, "") for a in gone if a not in used_before] + [("added", "", b) for b in new if b not in used_after]
    out += [("retyped", p, p) for p in sorted(before.keys() & after.keys()) if before[p] and after[p] and kind_of(before[p]) != kind_of(after[p])]
    return out


def records(lines: DataFrame) -> DataFrame:
    """`lines` with the readable records as variant column `record`."""
    parsed = lines.withColumn("record", F.try_parse_json("raw_line"))
    return parsed.where(F.schema_of_variant("record").startswith("OBJECT<"))


def fields(lines: DataFrame) -> DataFrame:
    """feed, file_no, path, bits: the leaf paths of each file with the fold of their types."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feed, file_no, path, bits = [], [], [], []
            for f, n, s in zip(*(batch.column(k).to_pylist() for k in ("feed", "file_no", "schema"))):
                for p, b in leaves_of(s):
                    feed.append(f), file_no.append(n), path.append(p), bits.append(b)
            yield pa.RecordBatch.from_pydict({"feed": pa.array(feed, pa.string()), "file_no": pa.array(file_no, pa.int64()), "path": pa.array(path, pa.string()), "bits": pa.array(bits, pa.int32())})

    seen = records(lines.select("feed", "file_no", "raw_line")).select("feed", "file_no", F.schema_of_variant("record").alias("schema")).distinct()
    return seen.mapInArrow(explode, "feed string, file_no bigint, path string, bits int").groupBy("feed", "file_no", "path").agg(F.bit_or("bits").alias("bits"))


def _values(record: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Leaf paths with their values; a list is a leaf."""
    stack = [(prefix, record)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            stack += [(f"{path}.{k}" if path else k, v) for k, v in value.items()]
        else:
            yield path, value


def profiles(lines: DataFrame) -> DataFrame:
    """feed, file_no, fields (array of path and the parts of `Seen`) of each file of `lines`."""
    names = ["feed", "file_no", "path", *PROFILE]

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, Seen] = {}
            for feed, file_no, line in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    record = json.loads(line or "")
                except (ValueError, RecursionError):
                    continue
                for path, value in _values(record) if isinstance(record, dict) else ():
                    key = (feed, file_no, path)
                    found[key] = found.get(key, Seen()).and_value(value)
            rows = [(*key, *seen) for key, seen in found.items()]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    schema = "feed string, file_no bigint, path string, " + ", ".join(f"{k} {kind}" for k, (_, kind) in PROFILE.items())
    partial = lines.select("feed", "file_no", "raw_line").mapInArrow(observe, schema)
    whole = partial.groupBy("feed", "file_no", "path").agg(*(add(k).alias(k) for k, (add, _) in PROFILE.items()))
    return whole.groupBy("feed", "file_no").agg(F.collect_list(F.struct("path", *PROFILE)).alias("fields"))


def file_changes(lines: DataFrame) -> DataFrame:
    """file_no, change_kind, field_before, field_after of each file against the one before it in its feed."""
    lines = lines.select(F.coalesce("feed", F.lit("")).alias("feed"), F.col("file_no").cast("long").alias("file_no"), "raw_line").where("file_no is not null")
    files = lines.select("feed", "file_no").distinct()
    # A file's row is as long as its schema, a feed's window holds one row a file.
    schemas = fields(lines).groupBy("feed", "file_no").agg(F.array_sort(F.collect_list(F.struct("path", "bits"))).alias("after"))
    none = F.array().cast("array<struct<path:string,bits:int>>")
    w = Window.partitionBy("feed").orderBy("file_no")
    pairs = files.join(schemas, ["feed", "file_no"], "left").withColumn("after", F.coalesce("after", none)).withColumns({"before": F.lag("after").over(w), "prior": F.lag("file_no").over(w)})
    pairs = checkpointed(pairs.where("before is not null and before <> after"))
    # Only files in which fields both went and came are read again.
    paths = lambda c: F.transform(c, lambda f: f["path"])
    moved = pairs.where((F.size(F.array_except(paths("before"), paths("after"))) > 0) & (F.size(F.array_except(paths("after"), paths("before"))) > 0))
    asked = moved.select("feed", F.explode(F.array("file_no", "prior")).alias("file_no")).distinct()
    seen = checkpointed(profiles(lines.join(asked, ["feed", "file_no"], "left_semi")))
    both = pairs.join(seen.withColumnRenamed("fields", "seen_after"), ["feed", "file_no"], "left").join(seen.select("feed", F.col("file_no").alias("prior"), F.col("fields").alias("seen_before")), ["feed", "prior"], "left")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda rows: {r["path"]: Seen(*(r[k] for k in PROFILE)) for r in rows or ()}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for n, before, after, *values in zip(*(batch.column(k).to_pylist() for k in ("file_no", "before", "after", "seen_before", "seen_after"))):
                for change in changes({f["path"]: f["bits"] for f in before}, {f["path"]: f["bits"] for f in after}, *map(of, values)):
                    for column, value in zip(out, (n, *change)):
                        column.append(value)
            yield pa.RecordBatch.from_pydict({"file_no": pa.array(out[0], pa.int64())} | {k: pa.array(v, pa.string()) for k, v in zip(("change_kind", "field_before", "field_after"), out[1:])})

    return both.select("file_no", "before", "after", "seen_before", "seen_after").mapInArrow(compare, "file_no bigint, change_kind string, field_before string, field_after string")


def _column_name(path: str) -> str:
    return path.replace(".", "_")


def union_schema(lines: DataFrame, most: int = 10_000) -> dict[str, tuple[str, list[str]]]:
    """field -> (type, paths) over all files. The fields are the classes of paths that renames
    connect, named by their most frequent path; the driver gets one row a path, and more than
    `most` paths are refused as being data, not a schema."""
    found = fields(lines).groupBy("path").agg(F.bit_or("bits").alias("bits"), F.count("*").alias("files")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} paths")
    renames = file_changes(lines).where("change_kind = 'renamed'").select("field_before", "field_after").distinct().limit(most + 1).collect()
    if len(renames) > most:
        raise ValueError(f"more than {most} renames")
    top = {r.path: r.path for r in found}

    def find(p: str) -> str:
        while top[p] != p:
            p = top[p]
        return p

    alike: dict[frozenset[str] | str, str] = {}
    same = [(r.field_before, r.field_after) for r in renames]
    # Also one field: spellings that say the same, and paths that would give one column name.
    same += [(alike.setdefault(key, p), p) for p in sorted(top) for key in (frozenset(words(p)), _column_name(p).lower())]
    for before, after in same:
        a, b = find(before), find(after)
        top[max(a, b)] = min(a, b)
    classes: dict[str, list] = {}
    for r in found:
        classes.setdefault(find(r.path), []).append(r)
    out = {}
    for rows in classes.values():
        rows.sort(key=lambda r: (-r.files, r.path))
        bits = 0
        for r in rows:
            bits |= r.bits
        out[rows[0].path] = (kind_of(bits), [r.path for r in rows])
    return dict(sorted(out.items()))


def consistent(lines: DataFrame, schema: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """All records under the union schema: feed, file_no, line_no, and a column for each field.
    A value that can't be cast to the field's type is null; where a record has several of a
    field's paths, the most frequent path with a value counts."""
    sql = {"whole": "bigint", "decimal": "double", "boolean": "boolean"}
    jpath = lambda p: "$" + "".join("['" + k.replace("'", "\\'") + "']" for k in p.split("."))
    columns = [F.coalesce(*(F.try_variant_get("record", jpath(p), sql.get(kind, "string")) for p in paths)).alias(_column_name(field)) for field, (kind, paths) in schema.items()]
    return records(lines).select("feed", "file_no", "line_no", *columns)
