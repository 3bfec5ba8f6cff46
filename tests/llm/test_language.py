import random

import pytest
from pyspark.sql import functions as F

from storyloom.llm import language as L

WORDS = {
    "en": "the council of workers said that they would not accept this new law and the ministry wanted more time with all of them",
    "it": "il consiglio dei lavoratori ha detto che non accettano questa nuova legge e il ministero voleva più tempo con tutti loro della",
    "es": "el consejo de los trabajadores dijo que no aceptan esta nueva ley y el ministerio quería más tiempo con todos ellos según",
    "fr": "le conseil des travailleurs a dit qu ils ne veulent pas cette nouvelle loi et le ministère voulait plus de temps avec eux",
    "de": "der rat der arbeiter sagte dass sie das neue gesetz nicht annehmen und das ministerium wollte mehr zeit mit ihnen über",
    "pt": "o conselho dos trabalhadores disse que não aceitam esta nova lei e o ministério queria mais tempo com todos eles não são",
    "nl": "de raad van de arbeiders zei dat zij deze nieuwe wet niet aanvaarden en het ministerie wilde meer tijd met hen allen zijn",
    "ru": "совет рабочих сказал что они не примут этот новый закон и министерство хотело больше времени со всеми ними городе",
}


def sentence(lang, rng, n=12):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    lines, labels = [], []
    for lang in L.LANGS:
        for k in range(80):
            lines.append(L.plain(sentence(lang, rng)))
            labels.append(lang if k % 20 else rng.choice(L.LANGS))
    return L.fit(lines, labels)


def test_held_out_accuracy_despite_wrong_labels(model):
    rng = random.Random(2)
    want = [lang for lang in L.LANGS for _ in range(40)]
    got = model.scores([L.plain(sentence(x, rng, 8)) for x in want]).argmax(axis=1)
    assert sum(L.LANGS[g] == w for g, w in zip(got, want)) >= 0.97 * len(want)


def test_scores_equal_the_kernel_expansion(model):
    lines = ["the ministry said", "das ministerium wollte", ""]
    for i, g in enumerate(list(L.line_grams(lines))[:2]):
        assert len(set(g.tolist())) == len(g) > 20
        want = model.weights[g].sum(axis=0) / len(g) ** 0.5
        assert abs(model.scores(lines)[i] - want).max() < 1e-3


def test_documents_lines_and_labels(spark, model):
    rng = random.Random(3)
    en, de, ru = (lambda n=12, x=x: sentence(x, rng, n) for x in ("en", "de", "ru"))
    rows = [(1, "en", f"{en()} {en()}\n{de()}\n\n{en()}"), (2, "EN-us", en()), (3, "fr", ru()), (4, None, de()), (5, "??", "https://www.x.example/1 123 !!"), (6, "en", ""), (7, None, None), (8, "Deutsch", de()), (8, "Deutsch", de())]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("seg_no", F.lit(9))
    found = [r for r in L.classify(df, model).collect()]
    assert len([r for r in found if r.seg_no == 0]) == 9
    by = {(r.doc_id, r.seg_no): r for r in found}
    assert by[1, 0].lang == "en" and by[1, 2].lang == "de" and 0 < by[1, 2].confidence <= 1 and by[5, 0].lang is None and by[7, 0].confidence == 0.0
    case = lambda r: r.lang is not None and (r.seg_no > 0 or r.label != r.lang)
    assert {(r.doc_id, r.seg_no, r.lang) for r in found if case(r)} == {(1, 2, "de"), (3, 0, "ru"), (4, 0, "de")}
    assert L.wrong_labels(df.limit(0)).count() == 0


def test_label_forms(spark):
    forms = ["en", " ENG", "en_GB", "English", "pt-BR", "Português", "deu", "und", "", "??", "bg", "Русский", None]
    got = [r[0] for r in spark.createDataFrame([(f,) for f in forms], "l string").select(L.canonical_label("l")).collect()]
    assert got == ["en", "en", "en", "en", "pt", "pt", "de", None, None, None, None, "ru", None]
