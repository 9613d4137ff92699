"""Freely typed model names."""

import random
import re

import pytest

from tokenloom.llm import mapping

NAMES = ["orlanda-4.1-mini", "orlanda-5", "kestrivon-3-large", "kestrivon-3.5-small", "mirrowend-2"]


@pytest.mark.parametrize("value, entry", [
    ("ORLANDA_4.1_Mini", 0), ("mini orlanda v4,1", 0), ("eu.talvane.orlanda:4_1:mn@20250102", 0), ("`proxy/v1/orlnada - 4.1 - mini (high)`", 0), ("ｏｒｌａｎｄａ－５－２０２５０１０２", 1), ("Orlanda 5.0 [medium effort]​", 1),
    ("hub:kestirvon 3 lg-high.", 2), ("KeSTRIVONN-V3.5-sm-2024-01-02-low", 3), ("mirowend 2", 4), ("orlanda-4.1", None), ("orlanda-4.1-small", None), ("kestrivon-3", None), ("mirrowend-2-vision", None), ("zephyrine-2", None), ("???", None), ("n/a", None), ("2", None), ("orlanda-5-mini-large", None)])
def test_values(value, entry):
    assert mapping.Reference(NAMES).match(value) == (mapping.UNMATCHED if entry is None else NAMES[entry])


def distance(a, b):
    prev2, prev = None, list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i]
        for j, e in enumerate(b, 1):
            v = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (c != e))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == e:
                v = min(v, prev2[j - 2] + 1)
            row.append(v)
        prev2, prev = prev, row
    return prev[-1]


def test_trie_against_brute_force():
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abc", k=rnd.randint(1, 8))) for _ in range(200)]
    trie = mapping.Trie()
    for w in words:
        trie.add(w, w)
    for _ in range(300):
        q = "".join(rnd.choices("abcd", k=rnd.randint(0, 9)))
        most = rnd.randint(0, 3)
        assert trie.search(q, most) == {w: d for w in words if (d := distance(q, w)) <= most}


def test_rows(spark):
    rows = spark.createDataFrame([("t", 1, "orlanda-5"), ("t", 2, " orlanda-5"), ("t", 3, None), ("t", 4, " \t"), ("t", 5, "nothing"), ("t", 5, "nothing"), ("t", 6, "x" * 100_000)], "record_table string, row_id long, raw_value string")
    out = sorted(tuple(r) for r in mapping.mapped(rows, NAMES).collect())
    assert [(r[1], r[3]) for r in out] == [(2, "orlanda-5"), (5, "UNMATCHED"), (5, "UNMATCHED"), (6, "UNMATCHED")] and out[0][2] == " orlanda-5"
    assert mapping.mapped(rows, []).where("model_name <> 'UNMATCHED'").count() == 0
    assert mapping.mapped(rows.where("false"), NAMES).count() == 0
    # A clashing column is replaced.
    from pyspark.sql import functions as F

    assert mapping.mapped(rows.withColumn("MODEL_NAME", F.lit(1)), NAMES).columns == ["record_table", "row_id", "raw_value", "model_name"]


def test_reference_list_is_bounded(spark, monkeypatch):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "model_name string")
    assert mapping.reference_names(df) == ["a", "b"]
    monkeypatch.setattr(mapping, "MOST_ENTRIES", 1)
    with pytest.raises(ValueError):
        mapping.reference_names(df)


@pytest.mark.parametrize("value, entry", [
    ("Arvel Bonar 4", 0), ("arvel_conta-v4", 1), ("hub/arvl contta 4.0 (high)", 1), ("arvel 4", 2), ("talvane arvel bonar:4:mn", 3), ("arvel-bonar-4-vision", None), ("arvel-zephyrine-4", None), ("bonar 4", None), ("bonar arvel conta 4", 1), ("conta-arvel-bonra-4", 0), ("arvel conta 5", None)])
def test_families_of_several_words(value, entry):
    names = ["arvel-bonar-4", "arvel-conta-4", "arvel-4", "arvel-bonar-4-mini"]
    assert mapping.Reference(names).match(value) == (mapping.UNMATCHED if entry is None else names[entry])


def test_entries_that_say_the_same_cannot_be_told_apart():
    reference = mapping.Reference(["orlanda-5", "Orlanda 5.0", "orlanda-4"])
    assert [reference.match(v) for v in ("ORLANDA 5", "orlanda-5", "orlanda_4")] == [mapping.UNMATCHED, None, "orlanda-4"]


#: Lists of other shapes: several words, sizes in numbers, qualifiers of every kind.
LISTS = [
    ["gpt-4o", "gpt-4o-mini", "claude-3.5-sonnet", "claude-3-opus", "llama-3.1-70b", "llama-3.1-8b", "text-embedding-3-large", "text-embedding-3-small", "o3", "o3-mini", "phi-3-medium", "command-r-plus", "mistral-large-2407"],
    ["alpha-3-fast", "alpha-3-pro", "Beta Nova 2", "beta-nova-2-turbo", "Stadtrad Cargo 500", "Stadtrad Cargo 500 plus"],
]


@pytest.mark.parametrize("names", LISTS)
def test_every_entry_of_other_lists_names_itself(names):
    reference = mapping.Reference(names)
    for name in names:
        assert reference.match(name) is None
        for written in (f" {name.upper()} ", name.replace("-", " "), name.replace("-", "_").title(), f"vendor/{name.swapcase()}", f"{name}-20240602", f"{name} (high)"):
            assert reference.match(written) in (name, None)
    assert [reference.match(v) for v in ("gpt-5", "alpha 3", "beta-nova", "llama 3.1", "", "---")] == [mapping.UNMATCHED] * 6


@pytest.mark.parametrize("names", LISTS)
def test_random_edits(names):
    """One wrong letter in a word of six letters or more: hardly any entry is missed, and none taken for another."""
    rnd, reference, right, wrong, n = random.Random(11), mapping.Reference(names), 0, 0, 0
    for _ in range(400):
        name = rnd.choice([x for x in names if any(len(w) > 5 for w in re.findall(r"[A-Za-z]+", x))])
        word = rnd.choice([m for m in re.finditer(r"[A-Za-z]+", name) if len(m[0]) > 5])
        at, letter = rnd.randrange(word.start() + 1, word.end()), rnd.choice("abcdefghijklmnopqrstuvwxyz")
        edited = rnd.choice([name[:at] + letter + name[at + 1 :], name[:at] + name[at + 1 :], name[:at] + letter + name[at:]])
        got = reference.match(edited)
        n, right, wrong = n + 1, right + (got in (name, None)), wrong + (got not in (name, None, mapping.UNMATCHED))
    assert right >= 0.99 * n and not wrong


def test_aliases_of_entries(spark):
    aliases = spark.createDataFrame([("big bertha", "orlanda-5"), (None, "x"), ("big bertha", "zzz")], "alias string, model_name string")
    values = spark.createDataFrame([("Big-Berhta",), ("orlanda 5",), ("bertha",)], "raw_value string")
    got = {r.raw_value: r.model_name for r in mapping.mapped(values, ["orlanda-5"], aliases=aliases).collect()}
    assert got == {"Big-Berhta": "orlanda-5", "orlanda 5": "orlanda-5", "bertha": mapping.UNMATCHED}


def test_abbreviations_against_brute_force():
    words = ["small", "smart", "mini", "main", "large", "legal", "pro", "turbo"]
    trie = mapping.Trie()
    for w in words:
        trie.add(w, w)
    for q in ("sm", "sml", "smrt", "mn", "lg", "lrg", "pr", "trb", "s", "sa", "smallest", "lrgx", "xl"):
        def skips(w, q=q):
            rest = iter(w[1:])
            return 1 < len(q) < len(w) and w[0] == q[0] and not set(q[1:]) & set("aeiou") and all(c in rest for c in q[1:])
        assert sorted(trie.abbreviated(q)) == sorted(filter(skips, words))
