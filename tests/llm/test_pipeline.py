"""The pipeline: each stage's decisions against the stage's operator by hand, and the run as a whole."""

import corpus_pipeline
import numpy as np
from harvestry.llm import langid, lines, packing, simhash, toxicity
from tests.llm.conftest import ODD
from tests.llm.test_documents import lines_by_hand


def alike_by_hand(rows, least=0.8):
    """The smallest id reachable over pairs whose five-word shingles are so similar, from all pairs."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and top(i) != top(j) and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i in sets}


def test_near_copies_against_all_pairs(spark, rng, monkeypatch):
    """Groups of edited copies, some of which only reach each other over the original, in one part and in many."""
    rows = []
    for group in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((8, 40, 150, 600)))]
        for k in range(10):
            words = list(base)
            for _ in range(rng.randrange(1 + len(words) // 40 * (k > 0) + (k > 0))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(3000)}"
            rows.append((group * 100 + (k * 7) % 11, " ".join(words)))
    rows += [(5000, None), (5001, ""), (5002, " "), (5003, "one two"), (5004, "One  TWO")]
    want = alike_by_hand(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for part, whole in ((simhash.PART, simhash.WHOLE), (3, 700)):
        monkeypatch.setattr(simhash, "PART", part)
        monkeypatch.setattr(simhash, "WHOLE", whole)
        assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == want


def test_recall_of_candidates(rng):
    """Pairs at the similarity itself: nearly all share a band and are within the radius."""
    met = close = 0
    for _ in range(400):
        n = rng.choice((30, 100, 400))
        common = [rng.getrandbits(64) for _ in range(8 * n)]
        x, y = (simhash.sketch(np.array(sorted([*common, *(rng.getrandbits(64) for _ in range(n))]), np.uint64)) for _ in range(2))
        met += any(a == b for a, b in zip(x[1], y[1], strict=True))
        close += (x[0] ^ y[0]).bit_count() <= simhash.WIDE
    assert met >= 0.985 * 400 and close >= 0.985 * 400


def test_stages(spark, base):
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns = docs.columns
    kept = [r.asDict() for r in docs.collect()]
    labels = spark.read.parquet(f"{base}/labels.parquet")

    model = toxicity.fit(toxicity.sample(docs, labels, folds=None))
    kept = [r for r in kept if model is None or model.score([(r["text"] or "").encode()])[0] < 0.5]
    lang = langid.fit(langid.sample(spark.createDataFrame(kept, docs.schema), folds=None))
    kept = [r for r in kept if lang.predict(r["text"])[0] != "und"]
    by_hand = lines_by_hand([(r["doc_id"], r["text"]) for r in kept])
    deduped = {r.doc_id: r.kept_text for r in lines.dedup_lines(spark.createDataFrame(kept, docs.schema)).collect()}
    assert sum(by_hand.values()) == len(deduped)
    kept = [{**r, "text": deduped[r["doc_id"]]} for r in kept]
    component = alike_by_hand([(r["doc_id"], r["text"]) for r in kept])
    kept = [r for r in kept if component[r["doc_id"]] == r["doc_id"]]

    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, base)
        assert at.columns == columns, name
    assert sorted((r.doc_id, r.text) for r in at.collect()) == sorted((r["doc_id"], r["text"]) for r in kept)
    pieces = corpus_pipeline.run(spark, base).collect()
    import public_tokenizers

    path = public_tokenizers.path(packing.VOCABULARY)
    assert sum(r.length for r in pieces) == sum(len(packing.encode(r["text"], path)) for r in kept)


def test_odd(spark, tmp_path, odd, nothing):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs, n in ((odd, len(ODD)), (nothing, 0)):
        at = docs.select("doc_id", "text", "lang", "source", "n_chars")
        counts = []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            counts.append(at.count())
        assert counts[0] == n and counts == sorted(counts, reverse=True)
        corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).count()


def rows_of(docs):
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)


def test_rows_are_decided_one_by_one(spark, base, rng, monkeypatch):
    def text(toxic):
        words = [f"w{rng.randrange(300)}" for _ in range(40)]
        for bad in rng.sample(["gargoyle", "vermin", "dreadful"], 3 * toxic):
            words.insert(rng.randrange(40), bad)
        return " ".join(words)

    def docs(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)

    model = toxicity.fit([(i % 2, text(i % 2).encode(), i % 8 > 5) for i in range(400)])
    bad, good = "w1 he is a GARGOYLE, w7 w9 and vermin! w2", "w4 w9 w1 w33"
    monkeypatch.setattr(toxicity, "fit", lambda rows: model)
    assert rows_of(corpus_pipeline.drop_toxic(spark, docs([(None, bad), (None, good), (7, bad), (7, good)]), base)) == rows_of(docs([(7, good), (None, good)]))

    assert rows_of(corpus_pipeline.drop_unknown_language(spark, docs([(1, good), (None, ""), (None, good), (2, None), (2, good)]), base)) == rows_of(docs([(1, good), (2, good), (None, good)]))

    a, b, c = text(0), text(0), text(0)
    rows = [(5, a), (5, a), (5, b), (7, b), (None, b), (None, c), (None, c), (None, a)]
    assert rows_of(corpus_pipeline.drop_near_duplicates(spark, docs(rows), base)) == rows_of(docs([(5, a), (5, b), (None, c)]))


def test_language_stage_without_known_languages(spark, base):
    rows = [(1, "some text"), (2, "1234 !!!"), (3, None), (None, "žltý kôň"), (4, "")]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert rows_of(corpus_pipeline.drop_unknown_language(spark, docs, base)) == [(1, "some text"), (None, "žltý kôň")]
