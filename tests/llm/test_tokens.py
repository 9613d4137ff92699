"""Encoding of whole texts, against the tokenizer itself."""

import random
from pathlib import Path

import pytest

from tokenloom.llm import packing, tokens

pytestmark = pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="no vocabulary")
PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "'s", "'", "ll", "1", "23", "日本", "語", "。", "é", "!", "--", "　", "<|endoftext|>", "𝔘", "https://x.y/", "Привет", "\t"]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(Path(tokens.VOCABULARY).with_suffix(".json")))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_cut_and_joined_anywhere(reference):
    rnd, coder, inside = random.Random(3), tokens.bpe(), 0
    for k in range(800):
        text = "".join(rnd.choices(PARTS if k % 3 else rnd.choices(PARTS, k=3), k=rnd.randint(1, 70)))
        begins = tokens.cuts(text, rnd.randint(3, 20))
        inside += sum(i for _, i in begins)
        stops = [b for b, _ in begins[1:]] + [len(text)]
        pieces = [(i, coder.encode(text[b:e]), *coder.ends(text[b:e])) for (b, i), e in zip(begins, stops)]
        assert tokens.join_pieces(coder, pieces) == reference(text), text
    assert inside > 500


def test_long_words_as_a_tree(reference, monkeypatch):
    monkeypatch.setattr(tokens, "LEAF", 16)
    rnd = random.Random(4)
    for _ in range(150):
        text = "".join(rnd.choices(["日本", "語", "abc", "x", "th", "e"], k=150))
        assert tokens.bpe().encode(text) == reference(text)


def test_rows(spark, reference):
    long = "The counter restarted, so the difference was negative. " * 900 + "語" * 40_000 + "x" * 20_001
    texts = [(1, None), (2, ""), (3, "hello <|endoftext|> world"), (3, "hello <|endoftext|> world"), (4, long), (4, long), (5, " " * 30_000), (None, "a")]
    df = spark.createDataFrame([(i, t, [9]) for i, t in texts], "doc_id long, text string, ids array<int>")
    out = sorted(((r.doc_id or 0, list(r.ids)) for r in tokens.encoded(df).collect()))
    assert out == sorted((i or 0, reference(t) if t else []) for i, t in texts)
    assert tokens.encoded(df.where("false")).count() == 0


def test_packing_is_whole_and_tight():
    import numpy as np

    rnd = np.random.default_rng(1)
    for sizes in (np.minimum(2048, rnd.lognormal(5, 1, 3000).astype(int) + 1), np.full(50, 1025), np.array([2048, 1, 1]), np.array([], int), rnd.integers(600, 1100, 500)):
        place = packing.pack(np.asarray(sizes, np.int64), 2048)
        fill = np.bincount(place, sizes) if len(sizes) else np.array([])
        assert len(place) == len(sizes) and (fill <= 2048).all() and (fill > 0).all()
    sizes = np.minimum(2048, rnd.lognormal(5, 1, 20_000).astype(int) + 1)
    assert packing.pack(sizes, 2048).max() + 1 <= 1.002 * -(-sizes.sum() // 2048)


def test_containers(spark):
    sized = spark.createDataFrame([(1, 5000), (2, 0), (3, 2048), (4, 900), (4, 900), (5, 1148), (6, 1)], "doc_id long, n_tokens int")
    rows = packing.containers(sized, group=3).collect()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append((r.part_no, r.first_token, r.n_tokens))
    assert sorted(of[1]) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)] and of[2] == [(0, 0, 0)] and len(of[4]) == 2
    fill = {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert fill.pop(None) == 0 and max(fill.values()) <= 2048
    assert packing.containers(sized.where("false")).count() == 0
