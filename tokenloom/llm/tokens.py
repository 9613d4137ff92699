"""Encoding of the whole corpus with a public byte-level BPE.

Texts of up to `LONG` characters are encoded as they are. Longer ones are cut and their pieces
encoded in parallel, as rows of their own, then joined in order. A cut between a visible
character and white space always falls between two words of the tokenizer, so ids on both sides
stay. Where a stretch has no such place the cut falls inside a word, and the word's two halves
are joined by re-encoding a growing window around the cut until both sides agree: a sequence of
tokens is the encoding of its bytes exactly if each pair of neighbours encodes to itself, so it
is enough that the pairs at both ends of the window do. Parts of one very long word are
joined the same way, as a tree, within a piece and across pieces.

Defined cases: null and empty texts give an empty list; strings of special tokens are ordinary
text; repeated rows give a list each; an empty table gives an empty result; extra columns are
ignored.
"""

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary is, unless the session names another file as `SETTING`.
VOCABULARY, SETTING = "/opt/tokenizers/byte_bpe_50k.tiktoken", "spark.tokenloom.vocabulary"
LONG = 16_384
#: Bytes of a word from which its halves are encoded on their own.
LEAF = 4_096
# Fixed value: how byte-level BPE of this vocabulary splits a text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Bpe:
    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        lines = Path(vocabulary).read_bytes().splitlines()
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.encoding = tiktoken.Encoding("bpe", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.word = regex.compile(WORDS)
        self.agree = lru_cache(200_000)(lambda a, b: self.of_bytes(self.bytes_of[a] + self.bytes_of[b]) == [a, b])

    def of_bytes(self, word: bytes) -> list[int]:
        """The encoding of one word."""
        return self.encoding._encode_single_piece(word)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of a word from those of its two halves."""
        if not left or not right:
            return left or right
        size = 1
        while True:
            a, b = left[-size:], right[:size]
            middle = self.of_bytes(b"".join(self.bytes_of[t] for t in (*a, *b)))
            left_agrees = size >= len(left) or self.agree(left[-size - 1], middle[0])
            right_agrees = size >= len(right) or self.agree(middle[-1], right[size])
            if left_agrees and right_agrees:
                return left[:-size] + middle + right[size:]
            size *= 2

    def tree(self, word: bytes) -> list[int]:
        """The encoding of one word, halves of long ones joined."""
        if len(word) <= LEAF:
            return self.of_bytes(word)
        half = len(word) // 2
        return self.join(self.tree(word[:half]), self.tree(word[half:]))

    def encode(self, text: str) -> list[int]:
        if len(text) <= LEAF:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        begin = 0
        # Only words too long to be encoded at once are taken out.
        for m in self.word.finditer(text):
            if m.end() - m.start() > LEAF:
                out += self.encoding.encode_ordinary(text[begin : m.start()]) + self.tree(m.group().encode())
                begin = m.end()
        return out + self.encoding.encode_ordinary(text[begin:])

    def ends(self, text: str) -> tuple[int, int]:
        """How many tokens the first and the last word of a text have."""
        spans = [m.group() for m in self.word.finditer(text)]
        return (len(self.tree(spans[0].encode())), len(self.tree(spans[-1].encode()))) if spans else (0, 0)


@lru_cache(2)
def bpe(vocabulary: str = VOCABULARY) -> Bpe:
    """One a process."""
    return Bpe(vocabulary)


def cuts(text: str, size: int = LONG) -> list[tuple[int, bool]]:
    """Where pieces of about `size` characters begin, and whether the cut before falls inside a word."""
    out, at = [(0, False)], size
    same = regex.compile(r"\p{L}{2}|\p{N}{2}|\s{2}(?=\s)|[^\s\p{L}\p{N}]{2}")
    while at < len(text):
        low = out[-1][0] + size // 2
        calm = next((i for i in range(at, low, -1) if text[i].isspace() and not text[i - 1].isspace()), 0)
        if calm:
            out.append((calm, False))
        else:
            # Inside a word: both sides alike, and no apostrophe near by that could end a word.
            i = at
            while i < len(text) and not (same.match(text, i - 1) and "'" not in text[i - 3 : i + 1]):
                i += 1
            if i >= len(text):
                break
            out.append((i, True))
        at = out[-1][0] + size
    return out


def encoded(documents: DataFrame, vocabulary: str | None = None, long: int = LONG) -> DataFrame:
    """doc_id, ids (array of int) of every row. vocabulary: a file that every executor can read."""
    vocabulary = vocabulary or documents.sparkSession.conf.get(SETTING, VOCABULARY)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        for batch in batches:
            ids = [coder.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                begins = cuts(text, long)
                stops = [b for b, _ in begins[1:]] + [len(text)]
                n = len(begins)
                same = batch.column(0).take(pa.array([i] * n)), batch.column(1).take(pa.array([i] * n))
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(n), pa.int32()), pa.array([inside for _, inside in begins]), pa.array([text[b:e] for (b, _), e in zip(begins, stops)])], ["row", "doc_id", "piece", "inside", "text"])

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        for batch in batches:
            texts = batch.column(4).to_pylist()
            ids = [coder.encode(t) for t in texts]
            ends = [coder.ends(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.list_(pa.int32())), pa.array([a for a, _ in ends], pa.int32()), pa.array([b for _, b in ends], pa.int32())], ["row", "doc_id", "piece", "inside", "ids", "first", "last"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        for batch in batches:
            texts = []
            for parts in batch.column(1).to_pylist():
                texts.append(join_pieces(coder, [(p["inside"], p["ids"], p["first"], p["last"]) for p in parts]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = documents.select("doc_id", "text")
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= long).mapInArrow(whole, f"doc_id {kind}, ids array<int>")
    # Each delivery of a repeated row keeps its own pieces.
    numbered = rows.where(F.length("text") > long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cut = numbered.mapInArrow(pieces, f"row bigint, doc_id {kind}, piece int, inside boolean, text string")
    spread = cut.repartition("row", "doc_id", "piece").mapInArrow(halves, f"row bigint, doc_id {kind}, piece int, inside boolean, ids array<int>, first int, last int")
    parts = spread.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "inside", "ids", "first", "last"))).alias("parts"))
    return short.unionByName(parts.select("doc_id", "parts").mapInArrow(joined, f"doc_id {kind}, ids array<int>"))


def join_pieces(coder: Bpe, pieces: list[tuple[bool, list[int], int, int]]) -> list[int]:
    """ids of a text from its pieces (inside a word, ids, tokens of the first and last word). The
    parts of a word that goes through many pieces are joined as a tree."""
    out: list[int] = []
    word: list[list[int]] = []  # the parts so far of the word that the last piece ends with

    def close() -> None:
        while len(word) > 1:
            word[:] = [coder.join(*pair) if len(pair) > 1 else pair[0] for pair in (word[i : i + 2] for i in range(0, len(word), 2))]
        out.extend(word.pop() if word else ())

    for inside, ids, first, last in pieces:
        if inside:
            word.append(ids[:first])
            if first == len(ids):
                continue
            close()
            ids = ids[first:]
        else:
            close()
        out += ids[: len(ids) - last]
        word.append(ids[len(ids) - last :])
    close()
    return out


def sizes(documents: DataFrame, vocabulary: str | None = None, long: int = LONG) -> DataFrame:
    """doc_id, n_tokens of every row."""
    return encoded(documents, vocabulary, long).select("doc_id", F.size("ids").alias("n_tokens"))
