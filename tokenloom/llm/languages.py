"""Language labels of documents and of their segments, by multilingual mixture inference.

A document is cut into sentences; code, logs and tables are left out, as sentences in which
words of natural language are the minority. Each sentence has a likelihood under each language,
from character n-grams (1 to `ORDERS`) counted on labelled documents. Expectation-maximisation
finds the proportions in which the document mixes the languages, and languages are taken out of
the mixture one by one as long as the penalised likelihood grows. A sentence's posterior under
the remaining mixture gives its language; runs of sentences in one language are segments.

The n-gram model is fitted on at most `SAMPLE` labelled documents a language, of at most
`SAMPLE_CHARS` characters each, chosen by a hash of their id. Labels are partly wrong: the model
is fitted twice more on the sentences on which label and model agree. It is an array of fixed
size (`CELLS` n-grams an order), which every task gets. All documents are labelled, over their whole texts.

Defined cases: null, empty and wordless texts have no segments and no language; null, blank and
placeholder labels (`NO_LANGUAGE`) are absent; an unknown label is another language; repeated
rows are labelled each; ties go to the language first in the alphabet; without any labelled
document nothing is found; text of a language without labelled documents is `UNKNOWN` and doubtful to nobody; extra columns are ignored.
"""

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import strip

ORDERS, CELLS = 4, 1 << 16
SAMPLE, SAMPLE_CHARS = 400, 20_000
#: Share of probability spread over all n-grams, seen or not.
UNSEEN = 0.05
#: Sentences whose scores a process remembers.
REMEMBERED = 200_000
#: What a further language must add to a document's log-likelihood.
PENALTY = 3.0
#: A sentence of `LONG_ENOUGH` letters is of none of the languages if its likelihood a letter lies so far below
#: that of the labelled ones (all but one in a thousand), and ahead of the next language by less than that.
UNKNOWN, LONG_ENOUGH, BELOW, AHEAD = "und", 20, 2.0, 0.45

# Codes and names of the languages.
LANGUAGES = {
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa spanish español espanol castellano",
    "fr": "fr fra fre french français francais",
    "it": "it ita italian italiano",
    "ja": "ja jpn jp japanese 日本語",
    "nl": "nl nld dut dutch nederlands flemish",
    "pt": "pt por portuguese português portugues",
    "ru": "ru rus russian русский",
    "zh": "zh zho chi cmn chinese 中文 汉语 漢語 mandarin",
}
NO_LANGUAGE = ("", "und", "zxx", "mul", "mis", "unk", "unknown", "none", "null", "n/a", "na", "nan", "-", "--", "?", "??", "???", "undefined", "undetermined", "xx", "xxx", "auto", "other")

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_NOISE = re.compile(r"<\|[^|\n]*\|>|\\u[0-9a-f]{4}|https?://\S+")
_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
#: Where a sentence ends: before line feeds, behind a mark.
_END = re.compile(rf"\n+|[.!?…](?:\s+|(?=[{_CJK}]))|[。！？](?![。！？」』）])")
_WORD = re.compile(r"[(\"'«“‘„¿¡>*_\[#-]*([^\W\d_]+(?:[-'’][^\W\d_]+)*)[.,;:!?…)\"'»”’“*_\]]*")
_HAS_CJK = re.compile(rf"[{_CJK}]")
_NOT_CJK = re.compile(rf"[^{_CJK}ー々]+")
_COMMAND = re.compile(r"^\W*\$\s")


def language_of_label(label: Column) -> Column:
    """ISO 639-1 code that a label names; the label itself if it is unknown; null if it names none."""
    clean = F.lower(strip(label))
    base = F.regexp_replace(F.split_part(F.regexp_replace(clean, "_", "-"), F.lit("-"), F.lit(1)), r"\s*\(.*$", "")
    known = F.create_map(*(F.lit(x) for code, names in LANGUAGES.items() for name in names.split() for x in (name, code)))
    return F.when(label.isNull() | clean.isin(*NO_LANGUAGE), None).otherwise(F.coalesce(known[clean], known[base], clean))


@lru_cache(200_000)
def _word(token: str) -> str:
    """The word in a token, without the marks around it; the empty string if it is none."""
    m = _WORD.fullmatch(token)
    return m[1] if m else ""


def sentences(text: str) -> list[str]:
    """The words of each sentence of natural language, in order."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("\u200b", "").replace("\ufeff", "").replace("\u00ad", "")
    text = text.lower()
    if "```" in text:
        text = _FENCE.sub("\n", text)
    if "<|" in text or "\\u" in text or "http" in text:
        text = _NOISE.sub(" ", text)
    cjk = not text.isascii() and _HAS_CJK.search(text) is not None
    out = []
    begin = 0
    for m in chain(_END.finditer(text), (None,)):
        part = text[begin:] if m is None else text[begin : m.start() + (text[m.start()] != "\n")]
        begin = m.end() if m else 0
        tokens = part.split()
        if not tokens or "$" in part and _COMMAND.match(part):
            continue
        words = list(filter(None, map(_word, tokens)))
        if cjk and _HAS_CJK.search(part):
            letters = _NOT_CJK.sub(" ", part).strip()
            if len(letters) >= 2 and len(letters) >= sum(map(len, words)) / 2:
                out.append(letters)
                continue
        if len(words) >= 2 and 2 * len(words) >= len(tokens):
            out.append(" ".join(words))
    return out


def grams(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all n-grams of the units, and the unit of each."""
    text = "".join(f" {u} " for u in units)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    unit = np.repeat(np.arange(len(units)), [len(u) + 2 for u in units])
    cells, owners = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, ORDERS + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(1)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        inside = unit[:m] == unit[n - 1 :]
        cells.append(((mixed >> np.uint64(40)) % np.uint64(CELLS)).astype(np.int64)[inside] + (n - 1) * CELLS)
        owners.append(unit[:m][inside])
    return np.concatenate(cells), np.concatenate(owners)


class Model:
    """Log-probabilities of n-grams by language."""

    def __init__(self, names: list[str], table: np.ndarray, floor: float = -np.inf) -> None:
        self.names, self.table, self.floor = names, table, floor
        self.known: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {"names": self.names, "table": self.table, "floor": self.floor, "known": {}}

    @classmethod
    def fit(cls, labelled: list[tuple[str, str]], rounds: int = 3) -> "Model | None":
        names = sorted({lang for lang, _ in labelled})
        units, lang = [], []
        for name, text in labelled:
            own = sentences(text)
            units += own
            lang += [names.index(name)] * len(own)
        if not units:
            return None
        code: dict[str, int] = {}
        at = np.array([code.setdefault(u, len(code)) for u in units])
        given, keep = np.array(lang), np.ones(len(units), bool)
        cell, owner = grams(units)
        lengths = np.array([len(u) for u in units])
        model, floor = None, -np.inf
        for turn in range(rounds):
            table = np.zeros((ORDERS * CELLS, len(names)))
            for k in range(len(names)):
                table[:, k] = np.bincount(cell[(keep & (given == k))[owner]], minlength=ORDERS * CELLS)
            by_order = table.reshape(ORDERS, CELLS, len(names))
            share = by_order / np.maximum(by_order.sum(1, keepdims=True), 1)
            model = cls(names, np.log((1 - UNSEEN) * share + UNSEEN / CELLS).reshape(ORDERS * CELLS, len(names)).astype(np.float32), floor)
            if turn == rounds - 1:
                break
            scores = model.score(list(code))[at]
            best = scores.argmax(1)
            usual = (scores.max(1) / lengths)[(lengths >= LONG_ENOUGH) & (best == given)]
            floor = float(np.quantile(usual, 0.001)) if len(usual) else floor
            # A language without any agreement keeps all it has.
            agree = best == given
            keep = agree | ~np.isin(given, given[agree])
        return model

    def unknown(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How sure it is, from 0 on, that each sentence is of none of the languages."""
        if len(self.names) < 2:
            return np.zeros(len(scores))
        first, second = -np.partition(-scores, 1, 1)[:, :2].T
        low = (first / lengths < self.floor - BELOW) & (lengths >= LONG_ENOUGH)
        return np.where(low, np.maximum(0.0, 1 - (first - second) / lengths / AHEAD), 0.0)

    def remembered(self, units: list[str]) -> np.ndarray:
        """`score`, each unit scored once a process while the memory of them (`REMEMBERED`) lasts."""
        new = [u for u in units if u not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = units
        self.known.update(zip(new, self.score(new)))
        out = np.array([self.known[u] for u in units])
        return out

    def score(self, units: list[str]) -> np.ndarray:
        """Log-likelihood of each unit under each language, averaged over the orders."""
        out = np.zeros((len(units), len(self.names)))
        begin = 0
        while begin < len(units):  # so many letters at a time, that the memory stays small
            end, letters = begin, 0
            while end < len(units) and (letters < 200_000 or end == begin):
                letters += len(units[end])
                end += 1
            cell, owner = grams(units[begin:end])
            # Of each order the cells come unit by unit.
            first = np.concatenate([[0], np.nonzero((owner[1:] != owner[:-1]) | (cell[1:] // CELLS != cell[:-1] // CELLS))[0] + 1])
            np.add.at(out, begin + owner[first], np.add.reduceat(self.table[cell], first, axis=0))
            begin = end
        return out / ORDERS


def mixture(scores: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(languages, posteriors): the set of languages of a document and each sentence's posterior under their mixture."""
    chosen = np.unique(scores.argmax(1))

    def fitted(langs: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        own = scores[:, langs]
        share = np.full(len(langs), 1 / len(langs))
        for _ in range(rounds if len(langs) > 1 else 1):
            joint = own + np.log(share)
            top = joint.max(1, keepdims=True)
            weight = np.exp(joint - top)
            total = weight.sum(1, keepdims=True)
            posterior = weight / total
            new = np.maximum(posterior.mean(0), 1e-6)
            done = np.abs(new - share).max() < 1e-7
            share = new
            if done:
                break
        return float((top + np.log(total)).sum()) - PENALTY * len(langs), share, posterior

    best, share, posterior = fitted(chosen)
    while len(chosen) > 1:
        tries = []
        for i in np.argsort(share):
            tries.append((fitted(np.delete(chosen, i)), i))
        (value, s, p), i = max(tries, key=lambda t: t[0][0])
        if value <= best:
            break
        chosen, best, share, posterior = np.delete(chosen, i), value, s, p
    return chosen, posterior


def labelled_segments(scores: np.ndarray, lengths: np.ndarray, names: list[str], unknown: np.ndarray | None = None) -> tuple[str, float, list[tuple[str, float]]]:
    """(language, confidence, segments of language and confidence) of a document's sentences. A
    document's language is the one of most letters, its confidence the share of letters, weighted
    by their posterior; the posterior is taken against all languages. Sentences of none of them (`unknown`, how
    surely) are left out of the mixture and are segments of the language `UNKNOWN`."""
    if unknown is not None and unknown.any():
        known = unknown == 0
        pick, sure, langs = np.zeros(len(scores), np.int64), unknown * lengths, np.zeros(0, np.int64)
        if known.any():
            langs, posterior = mixture(scores[known])
            pick[known] = posterior.argmax(1)
            joint = scores[known] - scores[known].max(1, keepdims=True)
            sure[known] = np.exp(joint[np.arange(len(joint)), langs[pick[known]]]) / np.exp(joint).sum(1) * lengths[known]
        pick[~known] = len(langs)
        langs, names = np.append(langs, len(names)), [*names, UNKNOWN]
    else:
        langs, posterior = mixture(scores)
        pick = posterior.argmax(1)
        joint = scores - scores.max(1, keepdims=True)
        sure = np.exp(joint[np.arange(len(pick)), langs[pick]]) / np.exp(joint).sum(1)
        sure = np.maximum(sure, posterior[np.arange(len(pick)), pick] * sure) * lengths
    letters = np.bincount(pick, lengths, len(langs))
    main = int(letters.argmax())
    edges = np.concatenate([[0], np.nonzero(pick[1:] != pick[:-1])[0] + 1, [len(pick)]])
    segments = [(names[langs[pick[a]]], float(sure[a:b].sum() / lengths[a:b].sum())) for a, b in zip(edges[:-1], edges[1:])]
    return names[langs[main]], float(sure[pick == main].sum() / lengths.sum()), segments


def label_texts(texts: list[str | None], model: Model | None) -> list[tuple[str | None, float | None, list[tuple[str, float]]]]:
    """(language, confidence, segments) of each text. Equal sentences are scored once; texts whose
    sentences all point to one language need no mixture."""
    units = [sentences(t) if t and model else [] for t in texts]
    flat = [u for own in units for u in own]
    if not flat:
        return [(None, None, [])] * len(texts)
    code: dict[str, int] = {}
    at = np.array([code.setdefault(u, len(code)) for u in flat])
    scores = model.remembered(list(code))[at]
    lengths = np.array([len(u) for u in flat], float)
    best, unknown = scores.argmax(1), model.unknown(scores, lengths)
    sure = lengths / np.exp(scores - scores.max(1, keepdims=True)).sum(1)
    counts = np.array([len(own) for own in units])
    ends = np.cumsum(counts)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        own = slice(end - n, end)
        if not n:
            out.append((None, None, []))
        elif (best[own] == best[end - 1]).all() and not unknown[own].any():
            lang, confidence = model.names[best[end - 1]], float(sure[own].sum() / lengths[own].sum())
            out.append((lang, confidence, [(lang, confidence)]))
        else:
            out.append(labelled_segments(scores[own], lengths[own], model.names, unknown[own]))
    return out


def fitted_model(documents: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of a corpus, from its bounded sample of labelled rows."""
    some = documents.select("doc_id", "text", language_of_label(F.col("lang")).alias("label")).where(F.col("label").isin(*LANGUAGES) & (F.length("text") <= SAMPLE_CHARS))
    first = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    rows = some.withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample).select("label", "text").collect()
    return Model.fit(sorted((r.label, r.text) for r in rows))


def labelled(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, label (the language the given label names, null if none), lang, confidence and
    segments (array of lang, confidence) of every document; lang is null where no sentence is."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, label string, lang string, confidence double, segments array<struct<lang:string,confidence:double>>"
    segment = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64())]))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            langs, sure, runs = [], [], []
            for part in _by_letters(batch.column(2).to_pylist()):
                for lang, confidence, segments in label_texts(part, known):
                    langs.append(lang), sure.append(confidence)
                    runs.append([{"lang": a, "confidence": b} for a, b in segments])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(runs, segment)], ["doc_id", "label", "lang", "confidence", "segments"])

    return documents.select("doc_id", language_of_label(F.col("lang")).alias("label"), "text").mapInArrow(label, schema)


def _by_letters(texts: list[str | None], most: int = 1_000_000) -> Iterator[list[str | None]]:
    part, letters = [], 0
    for t in texts:
        part.append(t)
        letters += len(t or "")
        if letters > most:
            yield part
            part, letters = [], 0
    if part:
        yield part


def doubtful(labels: DataFrame) -> DataFrame:
    """The documents whose label is absent, names another language, or names one of several."""
    return labels.where(f"lang is not null and lang <> '{UNKNOWN}' and (label is null or label <> lang or size(array_distinct(transform(segments, s -> s.lang))) > 1)")
