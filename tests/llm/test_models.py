"""Fitted operators: held-out accuracy, and odd rows."""

from collections import Counter
from harvestry.llm import langid, toxicity
from harvestry.llm.registry import queries
from tests.llm.conftest import ODD


def test_toxicity_held_out(spark):
    base = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    rows = [r for r in queries()["op2_toxicity"](spark, base).collect() if r.held_out and r.doc_id in labels]
    right = {t: sum(r.predicted == t for r in rows if labels[r.doc_id] == t) / sum(labels[r.doc_id] == t for r in rows) for t in (0, 1)}
    # About one in twenty texts that are marked as toxic here says nothing toxic (one word repeated, say).
    assert right[0] > 0.98 and right[1] > 0.85


def test_toxicity_odd(odd, nothing, rng):
    def text(toxic):  # a word's contexts vary, as a copied passage counts once
        words = [f"w{rng.randrange(300)}" for _ in range(40)]
        for bad in rng.sample(["gargoyle", "vermin", "dreadful"], 3 * toxic):
            words.insert(rng.randrange(40), bad)
        return " ".join(words).encode()

    model = toxicity.fit([(i % 2, text(i % 2), i % 8 > 5) for i in range(400)])
    out = toxicity.score_documents(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    new = model.score([b"w1 he is a GARGOYLE, w7 w9 and vermin! w2", b"w4 w9 w1 w33", b""])
    assert new[0] > 0.5 > new[1] and 0 <= new[2] <= 1
    assert toxicity.score_documents(nothing, model).count() == 0
    assert toxicity.fit([]) is None and {r.score for r in toxicity.score_documents(odd, None).collect()} == {0.0}


def test_toxicity_without_labels(spark, odd):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.sample(odd, labels) == []


def test_toxicity_sample_of_strided_ids(spark):
    for ids in ([20 * i for i in range(60)], [4 * i + 1 for i in range(60)], [0, 2, 4, 6]):
        docs = spark.createDataFrame([(i, f"text {i}") for i in ids for _ in range(2)], "doc_id long, text string")
        labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
        rows = toxicity.sample(docs, labels, folds=None)
        assert len(rows) == 2 * len(ids) and all({r[0] for r in rows if r[2] == part} == {0, 1} for part in (True, False))
        assert not {r[1] for r in rows if r[2]} & {r[1] for r in rows if not r[2]} and toxicity.fit(rows) is not None


def test_language_held_out(spark):
    base = "/root/testdata/sf0.1"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries()["op9_language_id"](spark, base).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) / len(rows) > 0.98


def test_language_odd(spark, odd, nothing):
    model = langid.fit([("en", "the and of that with this"), ("de", "der die und das mit nicht"), ("fr", "le la les des et une"), ("es", "el los las una con para")] * 3)
    out = langid.predict_documents(odd, model).collect()
    assert len(out) == len(ODD) and {r.lang_pred for r in out if r.doc_id in (3, 4, 5, 6)} == {"und"} and all(0 <= r.score <= 1 for r in out)
    assert model.predict("der und die")[0] == "de" and model.predict("LES ET UNE")[0] == "fr"
    assert langid.predict_documents(nothing, model).count() == 0
    assert langid.sample(nothing) == [] and {r.lang_pred for r in langid.predict_documents(odd, langid.fit([])).collect()} == {"und"}
    assert langid.fit([("en", "one language")]).predict("some text") == ("en", 1.0)


def test_samples_are_bounded(spark, monkeypatch):
    """Rows that repeat a doc_id, and very long texts, don't make a sample larger."""
    from harvestry.llm import langid, toxicity

    rows = [(1, f"text number {i % 50}", "en") for i in range(500)] + [(i, "word " * 300, "fr") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, {0: 5, 1: 5}, None)
    assert len(got) == 10
    monkeypatch.setattr(toxicity, "BYTES", 3000)
    assert sum(len(t) for _, t, _ in toxicity.sample(docs, labels, {0: 50, 1: 50}, None)) <= 6000
    assert 0 < len(langid.sample(docs, 20, None)) <= 20
    assert all(n <= 10 for n in Counter(lang for lang, _ in langid.sample(docs, 20, None)).values())
    monkeypatch.setattr(langid, "BYTES", 3000)
    assert 0 < sum(len(t) for _, t in langid.sample(docs, 20, None)) <= 3000
