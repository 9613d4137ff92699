"""Languages of documents and segments."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import languages

DATA = "/root/testdata/sf0.01/documents.parquet"
TEXTS = {
    "en": ["The counter restarted, so the difference was negative.", "Nothing else depends on it.", "I would keep the old name for now."],
    "de": ["Das dauerte viel zu lange und ist nicht normal.", "Auf dem alten Gerät geht es, auf dem neuen nicht.", "Bitte die Datei nicht löschen, bis die Summe geprüft ist."],
    "fr": ["Il a fallu beaucoup trop de temps pour un démarrage normal.", "Cela marche sur la vieille machine, pas sur la nouvelle.", "Ne supprimez pas le fichier avant la vérification."],
}


@pytest.fixture(scope="module")
def model():
    return languages.Model.fit([(lang, " ".join(texts)) for lang, texts in TEXTS.items() for _ in range(3)])


def labelled(spark, model, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {r.doc_id: (r.lang, [s.lang for s in r.segments], r.confidence) for r in languages.labelled(df, model).collect()}, df


def test_sentences_of_code_and_tables_are_left_out():
    text = "The first one holds.\n```\nfor x in y: print the value\n```\n| a-1 | 22 | 0.5 |\n$ tail -n 81 logs/x.log\n{\"ts\": 1, \"in\": 2}\n- x3 = 0x10;\nfn f7(a: u64) -> u64 {\nlogs/x.json:3\n> Who owns t/x.log now?这花了38秒，实在太慢了。"
    assert languages.sentences(text) == ["the first one holds", "who owns now", "这花了 秒 实在太慢了"]


def test_segments(spark, model):
    en, de, fr = (" ".join(TEXTS[k]) for k in ("en", "de", "fr"))
    out, df = labelled(spark, model, [(1, en, "en"), (2, en, "de"), (3, de, None), (4, f"{en} {fr}\n\n```\ncode it is\n```\n{fr} {en}", "en"), (5, None, "en"), (6, "", None), (7, "| 1 | 2 |", " "), (8, de.upper(), "German"), (9, (en + "\n") * 300, "en-GB"), (9, en, "en")])
    assert {k: v[:2] for k, v in out.items()} == {1: ("en", ["en"]), 2: ("en", ["en"]), 3: ("de", ["de"]), 4: ("en", ["en", "fr", "en"]) if out[4][0] == "en" else ("fr", ["en", "fr", "en"]), 5: (None, []), 6: (None, []), 7: (None, []), 8: ("de", ["de"]), 9: ("en", ["en"])}
    assert all(0 < c <= 1 for _, segments, c in out.values() if segments)
    assert sorted(r.doc_id for r in languages.doubtful(languages.labelled(df, model)).collect()) == [2, 3, 4]
    assert languages.labelled(df.where("false"), model).count() == 0
    assert all(r.lang is None for r in languages.labelled(df, None).collect())


def test_a_redundant_language_with_a_large_share_is_taken_out():
    # Languages 0 and 1 say the same of 20 sentences; 2, 3 and 4 have two sentences of their own each.
    scores = np.full((26, 5), -50.0)
    scores[:20, :2] = -0.1
    scores[np.arange(20), np.arange(20) % 2] = 0
    scores[np.arange(20, 26), [2, 2, 3, 3, 4, 4]] = 0
    langs, posterior = languages.mixture(scores)
    assert len(langs) == 4 and set(langs) > {2, 3, 4} and len(set(posterior[:20].argmax(1))) == 1


@pytest.mark.parametrize("label, code", [("EN", "en"), ("en_US", "en"), ("es-419", "es"), ("Deutsch", "de"), (" zho ", "zh"), ("日本語", "ja"), ("pt-BR", "pt"), ("und", None), ("", None), ("N/A", None), (None, None), ("sv", "sv")])
def test_labels(spark, label, code):
    df = spark.createDataFrame([(label,)], "lang string")
    assert df.select(languages.language_of_label(F.col("lang"))).first()[0] == code


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_held_out_accuracy(spark):
    documents = spark.read.parquet(DATA)
    model = languages.fitted_model(documents.where("doc_id % 2 = 0"))
    one = languages.labelled(documents.where("doc_id % 2 = 1"), model).where("label is not null and size(segments) = 1")
    right, n = one.agg(F.count_if(F.col("label") == F.col("lang")), F.count("*")).first()
    assert n > 300 and right / n > 0.9  # labels themselves are partly wrong


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_languages_without_labelled_documents(spark):
    model = languages.fitted_model(spark.read.parquet(DATA))
    swedish = "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete."
    turkish = "Bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler."
    english, german = "All human beings are born free and equal in dignity and rights.", "Alle Menschen sind frei und gleich an Würde und Rechten geboren."
    rows = [(1, swedish, "sv"), (2, turkish, None), (3, f"{english} {turkish}", "en"), (4, english, "en"), (5, german, "fr")]
    out, df = labelled(spark, model, rows)
    assert {k: v[:2] for k, v in out.items()} == {1: ("und", ["und"]), 2: ("und", ["und"]), 3: (out[3][0], ["en", "und"]), 4: ("en", ["en"]), 5: ("de", ["de"])}
    assert 1 not in {r.doc_id for r in languages.doubtful(languages.labelled(df, model)).collect()}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_held_out_accuracy_of_segments_and_confidence(spark):
    """Texts put together from two documents of known languages: both are found, in order, and who is sure is right."""
    documents = spark.read.parquet(DATA)
    model = languages.fitted_model(documents.where("doc_id % 2 = 0"))
    plain = languages.labelled(documents.where("doc_id % 2 = 1"), model).where("size(segments) = 1 and lang = label and confidence > 0.99").join(documents, "doc_id").select("doc_id", "label", "text").where("length(text) between 80 and 3000").orderBy("doc_id").limit(160).collect()
    pairs = [(a, b) for a, b in zip(plain[::2], plain[1::2]) if a.label != b.label]
    answers = languages.label_texts([f"{a.text}\n\n{b.text}" for a, b in pairs], model)
    right = [[lang for lang, _ in segments] == [a.label, b.label] for (a, b), (_, _, segments) in zip(pairs, answers)]
    assert len(pairs) > 30 and sum(right) / len(right) > 0.95
    sure = [c for ok, (_, _, segments) in zip(right, answers) if ok for _, c in segments]
    assert sum(c > 0.9 for c in sure) / len(sure) > 0.95
