import random
from pathlib import Path

import pytest

from tilewright.llm import languages as lg

#: Words for made-up sentences of some languages.
WORDS = {
    "en": "the valve opens when pressure rises and a spring holds that housing against this shaft which moves with its rotor under load".split(),
    "de": "das ventil öffnet wenn der druck steigt und eine feder hält dieses gehäuse gegen die welle welche sich mit ihrem läufer bewegt".split(),
    "fr": "la vanne s'ouvre lorsque cette pression monte et un ressort maintient le boîtier contre l'arbre qui bouge avec son rotor sous charge".split(),
    "ru": "клапан открывается когда давление растет и пружина удерживает корпус против вала который движется вместе с ротором под нагрузкой".split(),
    "ja": "弁が開くと圧力が上がりばねがその筐体を軸に対して保持し回転子とともに動く".split(),
}


def say(rng, lang, n=40):
    return " ".join(rng.choices(WORDS[lang], k=n)) if lang != "ja" else "".join(rng.choices("弁が開くと圧力上りばねその筐体を軸に対して保持し回転子ともに動", k=n * 4))


def test_labels(spark):
    given = ["en", "EN", "en-GB", "en_us", "eng", "English", " english ", "deu", "German", "zh-Hant-TW", "xx", "??", "", None, "unknown", "Klingon", "e n"]
    df = spark.createDataFrame([(g,) for g in given], "lang string")
    got = [r[0] for r in df.select(lg.named_language(df.lang)).collect()]
    assert got == ["en"] * 7 + ["de", "de", "zh"] + [None] * 7


def test_paragraphs():
    assert lg.paragraphs("a\nb\n\nc\r\n \t\r\n\r\nd\n \n\ne\n\n") == ["a\nb", "c", "d", "e\n\n"[:1]]
    assert lg.paragraphs("") == [] and lg.paragraphs(" \n\n ") == []


def corpus(n=60, wrong=0.25):
    """Documents of one language each; a part of the labels is wrong or missing."""
    rng = random.Random(1)
    out = []
    for i in range(n * len(WORDS)):
        lang = list(WORDS)[i % len(WORDS)]
        paras = [say(rng, lang) for _ in range(3)]
        label = rng.choice([x for x in WORDS if x != lang] + [None]) if rng.random() < wrong else lang
        out.append((i, lang, paras, label))
    return out


def test_wrong_labels_and_mixed_documents(spark):
    rng = random.Random(2)
    docs, want, rows = corpus(), set(), []
    for i, lang, paras, label in docs:
        if i % 10 == 0:
            other = rng.choice([x for x in WORDS if x != lang])
            paras = [paras[0], "short", say(rng, other), paras[1], paras[2]]
            want.add((i, 3, other))
        if label != lang:
            want.add((i, 0, lang))
        rows.append((i, "\r\n\r\n".join(paras), label, "x", 0.5))
    rows += [(9001, None, "en", "x", 0.5), (9002, "", None, "x", 0.5), (9003, "too short", "de", "x", 0.5), (9004, "\n \n", "de", "x", 0.5), (9005, "12 34 " * 500, "de", "x", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, para string, confidence double")
    assert {tuple(r) for r in lg.p8_found(df).collect()} == want
    got = lg.p8_languages(df).toPandas()
    assert set(got.doc_id) == {i for i, *_ in docs} and got.confidence.between(0, 1).all() and (got.confidence > 0.5).all()


def test_held_out_accuracy():
    docs = corpus(wrong=0.3)
    m = lg.fit(["\n\n".join(p) for _, _, p, label in docs[::2] if label], [label for _, _, _, label in docs[::2] if label])
    rng = random.Random(9)
    texts = [(say(rng, lang, 25), lang) for lang in WORDS for _ in range(40)]
    got = m.judge([t for t, _ in texts])
    assert sum(m.langs[k] == lang for (_, k, _), (_, lang) in zip(got, texts, strict=True) if k >= 0) / len(texts) > 0.99


def test_long_paragraph_in_pieces(monkeypatch):
    docs = corpus(20, 0)
    m = lg.fit(["\n\n".join(p) for _, _, p, _ in docs], [lang for _, lang, _, _ in docs])
    text = say(random.Random(3), "de", 3000)
    whole = m.judge([text])[0]
    monkeypatch.setattr(lg, "CHUNK_CHARS", 1000)
    parts = m.judge(["a", text, ""])
    assert parts[1][:2] == whole[:2] and parts[0] == (1, -1, parts[0][2]) and parts[2][1] == -1


def test_empty_and_unlabelled(spark):
    kind = "doc_id long, text string, lang string"
    assert lg.p8_found(spark.createDataFrame([], kind)).collect() == []
    # without a single label no language is known
    assert lg.p8_found(spark.createDataFrame([(1, "word " * 100, None)], kind)).collect() == []


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
def test_test_tables_agree_with_most_labels(spark):
    got = lg.identified(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("lang IS NOT NULL AND stated IS NOT NULL").toPandas()
    assert (got.lang == got.stated).mean() > 0.85


def test_language_with_long_texts_only(spark):
    rng = random.Random(3)
    rows = [(i, "\n\n".join(say(rng, lang) for _ in range(150 if lang == "de" else 3)), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    assert all(len(t) > lg.SAMPLE_CHARS for _, t, lang in rows if lang == "de")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert lg.fitted(df).langs == ["de", "en", "fr"]
    assert lg.p8_found(df).collect() == []
    got = df.select(lg.sample_text("text", 1000).alias("t"), "text").collect()
    assert all(len(r.t) <= 1000 and set(lg.paragraphs(r.t)) <= set(lg.paragraphs(r.text)) for r in got)
    one = spark.createDataFrame([("x" * 50, "x" * 20), ("a\n\n" + "b" * 50, "a")], "text string, want string")
    assert all(r.t == r.want for r in one.select(lg.sample_text("text", 20).alias("t"), "want").collect())


def test_sample_is_the_smallest_hashes_whatever_is_short(spark):
    # almost all texts of one language are too short, so its sample is looked for in more and more rows
    long = {"en": "the quick brown fox jumps over the lazy dog and runs away " * 3, "de": "der schnelle braune Fuchs springt über den faulen Hund und rennt " * 3}
    rows = [(i, long["de"] if i % 100 == 0 else "kurz", "de") for i in range(4000)] + [(10_000 + i, long["en"], "en") for i in range(300)] + [(20_000, long["en"], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    fit, lg.fit = lg.fit, lambda texts, labels: seen.append((texts, labels))
    try:
        lg.fitted(df, docs=20)
    finally:
        lg.fit = fit
    texts, labels = seen[0]
    assert labels == ["de"] * 20 + ["en"] * 20 and set(texts) == set(long.values())
