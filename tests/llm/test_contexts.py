"""Context mixing over words: against a plain computation, and as a distribution."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestry.llm import contexts, scoring


def split(names, counts):
    """Each name's path as (node, probability of a one, bit), by halving the counts in the names' order."""
    paths = {n: [] for n in names}

    def go(low, high):
        if high - low < 2:
            return
        part = counts[low:high]
        half = sum(part) / 2
        middle = min(max(low + 1, next(i for i in range(low, high + 1) if sum(counts[low:i]) >= half)), high - 1)
        one = sum(counts[middle:high]) / sum(part)
        for i in range(low, high):
            paths[names[i]].append(((low, high), one, int(i >= middle)))
        go(low, middle)
        go(middle, high)

    go(0, len(names))
    return paths


def by_hand(texts):
    """log10 of each text's probability, from (words, train), without hashes or arrays over tokens: one part, scored after one lesson."""
    known = Counter(w for words, train in texts if train for w in [*words, ""])
    names = sorted(known, key=str.encode)
    paths = split([*names, None], [*(known[w] for w in names), 1])
    spots = [(i, before, w, train) for i, (words, train) in enumerate(texts) for before, w in zip([(None, None), *zip([None, *words], words, strict=False)], [*words, ""], strict=False)]
    seen = defaultdict(lambda: [0, 0])
    for _, (two, one), w, train in spots:
        for node, _, bit in paths[w] if train else ():
            seen[one, node][bit] += 1
            seen[two, one, node][bit] += 1
    gates = contexts.SEEN**2
    weights = [[0.0, 0.3, 0.7, 0.0] for _ in range(gates)]
    refined = {}
    level = lambda t: min(t.bit_length(), contexts.SEEN - 1)
    ln = lambda p: math.log(p / (1 - p))
    bounded = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    for turn in (0, 1):
        taught, slope, total = [np.eye(4) * 20 for _ in range(gates)], np.zeros((gates, 4)), defaultdict(float)
        lessons = []
        for i, (two, one), w, train in spots:
            fresh = True
            for node, p, bit in paths[w]:
                s, t = list(seen[one, node]), list(seen[two, one, node])
                if train:
                    s[bit] -= 1
                    t[bit] -= 1
                p1 = bounded((s[1] + 0.5 * p) / (sum(s) + 0.5))
                p2 = bounded((t[1] + 0.5 * p1) / (sum(t) + 0.5))
                gate = level(sum(s)) * contexts.SEEN + level(sum(t))
                x = np.array([ln(bounded(p)), ln(p1), ln(p2), 1.0])
                z = min(max(float(x @ weights[gate]), -15), 15)
                mixed = 1 / (1 + math.exp(-z))
                at = gate, min(max(round(z * 2 + 16), 0), contexts.LEVELS - 1)
                start = 1 / (1 + math.exp(-(at[1] / 2 - 8)))
                zero, ones = refined.get(at, (20 * (1 - start), 20 * start))
                final = (mixed + ones / (zero + ones)) / 2
                total[i] += math.log10(final if bit else 1 - final)
                if train and fresh:
                    lessons.append((gate, x, bit - mixed, mixed * (1 - mixed), at, bit, (zero, ones)))
                fresh = fresh and sum(s) > 0
        for gate, x, error, curve, at, bit, before in lessons:
            slope[gate] += error * x
            taught[gate] += curve * np.outer(x, x)
            a, b = refined.get(at, before)
            refined[at] = (a + 1 - bit, b + bit)
        weights = [w + np.linalg.solve(h, s) for w, h, s in zip(weights, taught, slope, strict=True)]
    return [total[i] for i in range(len(texts))]


def some_texts(rng, n):
    words = [f"w{k}" for k in range(12)]
    texts = [([rng.choice(words) for _ in range(rng.randrange(1, 15))], True) for _ in range(n)]
    return [*texts, *((words, rng.random() < 0.5) for words, _ in texts[: n // 3])]


def test_scores_by_hand(spark, rng):
    texts = some_texts(rng, 30)
    rows = [(i, " ".join(words), train) for i, (words, train) in enumerate(texts)]
    got = {r.doc_id: r.score for r in scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3), sample=50).collect()}
    assert np.allclose([got[i] for i in range(len(rows))], by_hand(texts), rtol=1e-4)


def test_tokens_share_one(rng):
    """In any context the probabilities of all leaves sum to 1, seen or not."""
    texts = some_texts(rng, 20)
    names = sorted({w for words, _ in texts for w in [*words, ""]})
    tree = contexts.Tree.of(np.array([3, *range(1, len(names) + 1)]))
    numbers = [names.index(w) for words, _ in texts for w in [*words, ""]]
    first = np.cumsum([0, *(len(w) + 1 for w, _ in texts[:-1])])
    short, two = contexts.contexts(np.array(numbers, np.uint32), first, np.ones(len(names), int), 1)
    long = contexts.longer(short, two)
    known = np.stack([short, long, np.array(numbers, np.uint32), np.ones(len(numbers), np.uint32)])
    for place in ((short[4], long[4]), (short[9], np.uint32(1)), (np.uint32(5), np.uint32(6))):
        own = [10 ** contexts.score_bucket(tree, np.append(known, np.array([[*place, leaf, 0]], np.uint32).T, axis=1))[-1] for leaf in range(len(names) + 1)]
        assert abs(sum(own) - 1) < 1e-4


def test_texts_that_repeat_score_apart(spark, rng):
    words = [f"v{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
    rows = [(i, t, True) for i, t in enumerate([*texts, *texts[:10]])]
    got = {r.doc_id: r.bits_per_byte for r in scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), sample=50).collect()}
    assert max(got[i] for i in range(10)) < 0.5 * min(got[i] for i in range(10, 60))


def test_splits_and_slices(rng):
    words = np.array([0, 1, 0, 1, 2, 0, 1], np.uint32)
    parts = np.array([1, 50, 1])
    short, two = contexts.contexts(words, np.array([0, 4]), parts, 1)
    long = contexts.longer(short, two)
    assert short[0] == short[4] and short[3] == short[1] and len({int(x) for x in short}) >= 4 and len({int(x) for x in long}) == 6
    assert list(contexts.slices(np.array([contexts.HELD, 5, 5, contexts.HELD]))) == [(0, 1), (1, 3), (3, 4)]
    columns = [np.array([rng.getrandbits(32) for _ in range(100)], np.uint32) for _ in range(3)]
    import zstandard

    assert (contexts.unpacked(contexts.packed(columns, zstandard.ZstdCompressor()), 3, zstandard.ZstdDecompressor()) == np.stack(columns)).all()


def test_words_of_a_batch():
    """The words of an Arrow array are those that one text at a time gives."""
    import pyarrow as pa
    from harvestry.llm.common import tokens_of, words_of

    texts = ["", None, "  a B\tc\n", "ÄÖ\u00a0x \x1c y\x85z \x00", "one", "\x0b\x0cé\r\u2003É ", " \n "]
    words, rows, counts = words_of(pa.array(texts))
    want = [tokens_of((t or "").encode()) for t in texts]
    assert words.to_pylist() == [w for x in want for w in x] and counts.tolist() == list(map(len, want)) and rows.tolist() == [i for i, x in enumerate(want) for _ in x]


def test_slices_share_their_counts(rng):
    """A bucket that is read in slices is scored as one that is held whole."""
    tree = contexts.Tree.of(np.array([400, 300, 200, 100, 50, 50], float))
    n = 6000
    columns = np.array([[rng.randrange(3) * 7 for _ in range(n)], [rng.randrange(5) for _ in range(n)], [rng.randrange(6) for _ in range(n)], [rng.randrange(4) > 0 for _ in range(n)]], np.uint32)
    texts = np.arange(n)
    want = contexts.score_bucket(tree, columns)
    parts = [(0, 1000), (1000, 4500), (4500, n)]
    got = list(contexts.score_slices(tree, lambda: ((texts[a:b], columns[:, a:b]) for a, b in parts)))
    assert np.allclose(np.concatenate([x for _, x in got]), want, rtol=0, atol=1e-12) and np.concatenate([t for t, _ in got]).tolist() == texts.tolist()


def test_starts_are_split_by_the_texts_themselves():
    words, first, parts = np.arange(12, dtype=np.uint32), np.array([0, 4, 8]), np.ones(12, int)
    ids = np.array([5, 77, 1003])
    whole = contexts.contexts(words, first, parts, 4, ids)[0][first]
    alone = [contexts.contexts(words[a : a + 4], np.array([0]), parts, 4, ids[k : k + 1])[0][0] for k, a in enumerate(first)]
    assert whole.tolist() == alone


@pytest.mark.parametrize("parts", (1, 5))
def test_scores_do_not_depend_on_the_layout(spark, base, parts):
    docs = spark.read.parquet(f"{base}/documents.parquet").selectExpr("doc_id", "text", "doc_id % 7 <> 2 AS train").where("doc_id < 60")
    one = {r.doc_id: r.score for r in scoring.score_documents(docs.repartition(3)).collect()}
    other = {r.doc_id: r.score for r in scoring.score_documents(docs.orderBy(F.desc("doc_id")).coalesce(1).repartition(parts, F.col("doc_id") % 3)).collect()}
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-6 * abs(one[k]) for k in one)


def test_spellings_learn_from_all_tokens(spark, rng):
    """No sample: its size changes nothing, and tasks' sums over grams teach what all tokens at once teach."""
    tokens = [bytes(rng.choice(b"abcdexyz") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    rows = [(i, " ".join(t.decode() for t in rng.sample(tokens, 20)), True) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    few, many = ({r.doc_id: r.spelled_score for r in scoring.score_documents(docs, 10, n).collect()} for n in (5, 500))
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-9 * abs(few[k]) for k in few)
    types = sorted(set(tokens))
    table = np.zeros((len(scoring.ORDERS), 2, 1 << scoring.BITS), np.uint32)
    scoring.bit_counts(types, table)
    grams = scoring.gram_counts(spark.createDataFrame([(bytearray(t),) for t in types], "token binary").repartition(3))
    assert (scoring.bit_table(grams, grams.count()) == table).all()
    one, other = scoring.learn(table, types), scoring.learn_all(grams, table)
    assert np.allclose(one.weights, other.weights) and np.allclose(one.refined, other.refined)


def test_distinct_rows_in_order(rng):
    """Distinct rows come in the order of (short, long, leaf, train), with their counts and each token's row."""
    columns = np.array([[rng.choice((0, 1, 2**32 - 1)) for _ in range(3000)], [rng.choice((0, 7, 2**32 - 1)) for _ in range(3000)], [rng.choice((0, 5, 200_000)) for _ in range(3000)], [rng.randrange(2) for _ in range(3000)]], np.uint32)
    rows, times, of = contexts.distinct(columns, np.ones(3000, np.int64))
    want = Counter(zip(*columns.tolist(), strict=True))
    assert list(zip(*rows.tolist(), strict=True)) == sorted(want) and times.tolist() == [want[k] for k in sorted(want)]
    assert (rows[:, of] == columns).all()


def test_lessons_are_sums_over_rows():
    """What levels note one by one, sorted by gate, is what each row adds by itself; rows of weight 0 add nothing."""
    r = np.random.default_rng(5)
    mixer, gates = contexts.Mixer(), contexts.SEEN**2
    slope, curve, refined = np.zeros((gates, 4)), mixer.taught.copy(), mixer.refined.copy()
    for n in (300, 40, 1):
        gate, at = r.integers(0, 20, n), r.integers(0, contexts.LEVELS, n)
        at += gate * contexts.LEVELS
        inputs = [r.normal(size=n).astype(np.float32) for _ in range(3)]
        bit, p, times = (r.random(n) < 0.5).astype(np.float32), r.random(n).astype(np.float32), r.integers(0, 3, n).astype(np.float32)
        mixer.note(gate, inputs, at, bit, p, times)
        for k in range(n):
            x = np.array([*(v[k] for v in inputs), 1.0], float)
            slope[gate[k]] += (float(bit[k]) - float(p[k])) * times[k] * x
            curve[gate[k]] += float(p[k]) * (1 - float(p[k])) * times[k] * np.outer(x, x)
            refined[int(bit[k]), gate[k], at[k] % contexts.LEVELS] += times[k]
    weights = mixer.weights + np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
    mixer.teach()
    assert np.allclose(mixer.weights, weights, atol=1e-4) and np.allclose(mixer.taught, curve, rtol=1e-4, atol=1e-3) and np.array_equal(mixer.refined, refined)
    assert not mixer.slope.any() and not mixer.bent.any() and not mixer.places.any()


def test_levels_double():
    counts = np.array([0, 1, 2, 3, 4, 7, 8, 63, 64, 1e6], np.float32)
    assert contexts.level(counts).tolist() == [0, 1, 2, 2, 3, 3, 4, 6, 7, 7] and contexts.level(counts).dtype == np.int64


def test_texts_are_dealt_together_up_to_a_size():
    """op5: batches are put together before words are looked up, and long texts keep a group small."""
    import pyarrow as pa

    small, large = pa.RecordBatch.from_pydict({"text": ["ab"] * 10}), pa.RecordBatch.from_pydict({"text": ["x" * 1000] * 10})
    assert [b.num_rows for b in scoring.gathered([small] * 7, 30, 5000)] == [30, 30, 10]
    assert [b.num_rows for b in scoring.gathered([small, large, small, large, small], 1000, 5000)] == [20, 20, 10]


def test_rows_alone_in_their_two_words_are_scored_once_a_kind(monkeypatch):
    """op5: rows whose two words have seen nothing else are predicted together, as the leaf after one word that they are."""
    n, leaves, predicted, whole = 300, 8, [], contexts.Mixer.predict
    monkeypatch.setattr(contexts.Mixer, "predict", lambda self, gate, inputs: predicted.append(len(gate)) or whole(self, gate, inputs))
    leaf = np.arange(n) % leaves * 7
    found = contexts.score_bucket(contexts.Tree.of(np.arange(1.0, 65)), np.stack([np.full(n, 7), np.arange(n) * 5, leaf, np.ones(n, int)]).astype(np.uint32))
    assert sum(predicted) < n and all(len(set(found[leaf == x].tolist())) == 1 for x in set(leaf.tolist()))


def test_order_of_two_columns():
    """op5: rows in order and the runs of equal ones, with and without room for places beside the keys; sums by text follow them."""
    r = np.random.default_rng(3)
    for high, low in ((50, 7), (2**32, 2**32), (3, 2**32), (2**32, 2)):
        a, b = r.integers(0, high, 500).astype(np.uint64), r.integers(0, low, 500).astype(np.uint32)
        a[100:200], b[100:200] = a[:100], b[:100]
        order, new = contexts.ordered(a, b)
        rows = list(zip(a[order].tolist(), b[order].tolist(), strict=True))
        assert sorted(order.tolist()) == list(range(500)) and rows == sorted(rows) and new.tolist() == [k == 0 or rows[k] != rows[k - 1] for k in range(500)]
    text = (r.integers(0, 3, 500) << scoring.PLACE) + r.integers(0, 9, 500)
    of, sums = scoring.sums_of(text, np.arange(500.0))
    assert of.tolist() == sorted(set(text.tolist())) and sums.tolist() == [float(np.flatnonzero(text == x).sum()) for x in of.tolist()]
    assert [len(x) for x in scoring.sums_of(text[:0], np.zeros(0))] == [0, 0]
