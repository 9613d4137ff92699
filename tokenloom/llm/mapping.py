"""Mapping freely typed model names to the entries of a reference list.

An entry is read as the words of its family (those before its first number), its numbers in
order, and its qualifiers (the words after), which stand in any order; a value names an entry if
its words spell all of the entry's and its numbers are the same. Letter case, width, quotes and
separators don't count. A release date or an effort level at the end and a vendor in front are
tried as part of the name first and left out where that names nothing.

All words of all entries are in tries, family words and qualifiers apart, families below that word
by word. A Levenshtein automaton (with swaps of neighbours) walks a word's letters and returns every
word within a distance that depends on its length (`budget`). Qualifiers also have alias paths: the
first letter and some of the consonants behind it. Whole names may have aliases, as a table.
Of all entries found the one of the smallest distance counts; two equally close ones, or a word
that is unknown behind the beginning of a family, leave the value unmatched. In front of a family
words may be left out that are neither qualifiers nor begin a family.

The list goes to every task, so its size is checked (`MOST_ENTRIES`). Rows aren't shuffled. Entries
that differ in nothing but spelling can't be told apart, so values that name them are unmatched.

Defined cases: null and blank values give no row; values that are an entry literally give no row;
repeated elements of an array give a row each; an empty reference list leaves all unmatched.
"""

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import strip

UNMATCHED = "UNMATCHED"
MOST_ENTRIES = 100_000
# Effort levels, which don't make another model.
EFFORTS = "minimal|low|medium|high|xhigh|max"
_EFFORT = re.compile(rf"\s*[(\[]\s*(?:{EFFORTS})(?:[\s_-]*effort)?\s*[)\]]$|[\s@:_/-]+(?:{EFFORTS})(?:[\s_-]*effort)?$")
_DATE = re.compile(r"[\s@:_-]+20\d\d([-_.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])$")
_VENDOR = re.compile(r"^(?:[a-z]{2}\.)?[a-z][a-z0-9]*\.(?=[a-z])")
_TOKEN = re.compile(r"v?\d+(?:[.,_]\d+)*|[^\W\d_]+")
_VOWELS = frozenset("aeiou")
_EDGE = " \t\r\n\f\v\"'`“”‘’«».,;:"


def budget(length: int) -> int:
    """How many edits a word of this length allows."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 7 else 3


class Trie:
    """Words letter by letter; `search` returns all within a distance."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.longest = 0

    def add(self, word: str, value: object) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault("", {})[value] = len(word)
        self.longest = max(self.longest, len(word))

    def search(self, word: str, most: int, allowed=lambda length: 1_000) -> dict[object, int]:
        """value -> smallest distance to `word`, where that is at most `most` and `allowed` by the entry's length."""
        found: dict[object, int] = {}
        n = len(word)
        if n > self.longest + most:
            return found
        stack = [(self.root, 0, "", list(range(n + 1)), None)]
        while stack:
            node, depth, last, row, above = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[n] <= most:
                        for value, length in child.items():
                            if row[n] <= allowed(length) and row[n] < found.get(value, 1_000):
                                found[value] = row[n]
                    continue
                new = [depth + 1] + [1_000] * n
                # Cells farther from the diagonal than `most` can't end within it.
                for j in range(max(1, depth + 1 - most), min(n, depth + 1 + most) + 1):
                    cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (word[j - 1] != c))
                    if above is not None and j > 1 and word[j - 1] == last and word[j - 2] == c:
                        cost = min(cost, above[j - 2] + 1)
                    new[j] = cost
                if min(new) <= most or min(row) < most:
                    stack.append((child, depth + 1, c, new, row))
        return found


    def abbreviated(self, word: str) -> list[object]:
        """The values of the words that `word` may stand for: their first letter, then some of
        their consonants, in order."""
        if not 2 <= len(word) <= self.longest or _VOWELS & set(word[1:]) or word[0] not in self.root:
            return []
        found, stack = [], [(self.root[word[0]], 1)]
        while stack:
            node, at = stack.pop()
            for c, child in node.items():
                if c == "":
                    found += [value for value, length in child.items() if at == len(word) < length]
                else:
                    # Taking a letter as early as possible loses no abbreviation.
                    stack.append((child, at + (at < len(word) and c == word[at])))
        return found


def number_of(token: str) -> str:
    """v4.0 -> 4, 3_5 -> 3.5"""
    parts = re.findall(r"\d+", token)
    while len(parts) > 1 and not parts[-1].strip("0"):
        parts.pop()
    return ".".join(p.lstrip("0") or "0" for p in parts)


def cleaned(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).lower()
    return "".join(c for c in text if unicodedata.category(c) != "Cf").strip(_EDGE)


def readings(value: str) -> Iterator[str]:
    """The value, and the value without effort levels, release dates and vendors, the least shortened first."""
    text = cleaned(value)
    seen: set[str] = set()
    while True:
        name = text.rpartition("/")[2].strip()
        for reading in (name, _VENDOR.sub("", name)):
            if reading not in seen:
                seen.add(reading)
                yield reading
        shorter = _EFFORT.sub("", text, count=1).strip(_EDGE)
        shorter = _DATE.sub("", text).strip(_EDGE) if shorter == text else shorter
        if shorter == text or not shorter:
            return
        text = shorter


def tokens(text: str) -> tuple[list[str], str, int]:
    """Words in order, the numbers, how many words stand before the first number."""
    words, numbers, before = [], [], -1
    for token in _TOKEN.findall(text):
        if token[-1].isdigit():
            before = len(words) if before < 0 else before
            numbers.append(number_of(token))
        elif token != "v":
            words.append(token)
    return words, ".".join(numbers), len(words) if before < 0 else before


class Reference:
    def __init__(self, names: list[str], aliases: dict[str, str] | None = None) -> None:
        """aliases: other spellings of whole entries."""
        self.literal = frozenset(names)
        self.family_words, self.qualifiers = Trie(), Trie()
        #: what families begin with, word by word
        self.begins: set[tuple[str, ...]] = {()}
        #: (family, numbers, sorted qualifiers) -> entries
        self.entries: dict[tuple, set[str]] = {}
        for spelling, name in [*((n, n) for n in names), *(aliases or {}).items()]:
            words, numbers, before = tokens(cleaned(spelling).rpartition("/")[2])
            before = before or min(1, len(words))
            family, rest = tuple(words[:before]), tuple(sorted(words[before:]))
            for i, word in enumerate(family):
                self.family_words.add(word, word)
                self.begins.add(family[: i + 1])
            for word in rest:
                self.qualifiers.add(word, word)
            if family:
                self.entries.setdefault((family, numbers, rest), set()).add(name)
        self.match = lru_cache(200_000)(self._match)
        self.near_family = lru_cache(50_000)(lambda word: self.family_words.search(word, budget(self.family_words.longest), budget))
        self.near_qualifier = lru_cache(50_000)(self._near_qualifier)

    def _near_qualifier(self, word: str) -> dict[object, int]:
        found = self.qualifiers.search(word, budget(self.qualifiers.longest), budget)
        return found if 0 in found.values() else {q: 1 for q in self.qualifiers.abbreviated(word)} | found

    def named(self, text: str, lenient: bool) -> dict[str, int]:
        """entry -> distance of the entries that a reading names. lenient: in front of a family also
        words may be left out that nearly, but not exactly, begin one."""
        words, numbers, _ = tokens(text)
        states: dict[tuple[tuple[str, ...], tuple[str, ...]], int] = {((), ()): 0}
        for word in words:
            longer: dict[tuple[tuple[str, ...], tuple[str, ...]], int] = {}
            family, qualifiers = self.near_family(word), self.near_qualifier(word)
            begins = [d for w, d in family.items() if (w,) in self.begins]
            idle = not qualifiers and (not begins or lenient and 0 not in begins)
            for (f, q), cost in states.items():
                then = [((*f, w), q, cost + d) for w, d in family.items() if (*f, w) in self.begins]
                then += [(f, tuple(sorted((*q, w))), cost + d) for w, d in qualifiers.items()]
                if not f and idle:
                    then.append((f, q, cost))
                for g, r, c in then:
                    if c < longer.get((g, r), 1_000_000):
                        longer[g, r] = c
            states = longer
            if not states:
                return {}
        out: dict[str, int] = {}
        for (f, q), cost in states.items():
            for name in self.entries.get((f, numbers, q), ()):
                out[name] = min(cost, out.get(name, cost))
        return out

    def _match(self, value: str) -> str | None:
        """The entry, UNMATCHED, or null for a value that is an entry literally."""
        if value in self.literal:
            return None
        for lenient in (False, True):
            for text in readings(value):
                found = self.named(text, lenient)
                if found:
                    best = min(found.values())
                    closest = [name for name, d in found.items() if d == best]
                    return closest[0] if len(closest) == 1 else UNMATCHED
        return UNMATCHED


def reference_names(entries: DataFrame, name: str = "model_name") -> list[str]:
    names = sorted(r[0] for r in entries.where(F.col(name).isNotNull()).select(name).distinct().limit(MOST_ENTRIES + 1).collect())
    if len(names) > MOST_ENTRIES:
        raise ValueError(f"a reference list has at most {MOST_ENTRIES} entries")
    return names


def alias_table(aliases: DataFrame | None, alias: str = "alias", name: str = "model_name") -> dict[str, str]:
    """The other spellings of entries, as bounded as the entries are; of one that is given twice the first entry counts."""
    if aliases is None:
        return {}
    rows = aliases.where(F.col(alias).isNotNull() & F.col(name).isNotNull()).groupBy(alias).agg(F.min(name)).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"there are at most {MOST_ENTRIES} aliases")
    return {r[0]: r[1] for r in rows}


def mapped(values: DataFrame, names: list[str], value: str = "raw_value", aliases: DataFrame | None = None) -> DataFrame:
    """`values` with the entry that each non-blank value names as `model_name`; literal entries
    left out. A column that already has this name is replaced. aliases: alias, model_name."""
    values = values.drop(*(c for c in values.columns if c.lower() == "model_name"))
    other = alias_table(aliases)
    rows = values.where(F.col(value).isNotNull() & (strip(F.col(value)) != ""))
    schema = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    columns = rows.columns
    at = columns.index(value)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = Reference(names, other)
        for batch in batches:
            coded = batch.column(at).dictionary_encode()
            entries = pa.array([reference.match(v) for v in coded.dictionary.to_pylist()], pa.string())
            out = pa.RecordBatch.from_arrays([*batch.columns, entries.take(coded.indices)], [*columns, "model_name"])
            yield out.filter(out.column(len(columns)).is_valid())

    return rows.mapInArrow(match, f"{schema}, model_name string")


def free_values(usage: DataFrame, summaries: DataFrame) -> DataFrame:
    """record_table, row_id, raw_value of all freely typed models."""
    table: Column = F.lit("usage_event").alias("record_table")
    a = usage.select(table, F.col("seq").alias("row_id"), F.col("model").alias("raw_value"))
    b = summaries.select(F.lit("summary_report").alias("record_table"), F.col("summary_id").alias("row_id"), F.explode("unpriced_models").alias("raw_value"))
    return a.unionByName(b)
