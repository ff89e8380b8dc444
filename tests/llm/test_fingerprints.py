"""Fingerprints against their definition in plain loops, and on odd rows."""

import hashlib
from math import log2

import numpy as np
import pytest

from harvestry.llm import fingerprints as fp
from tests.llm.conftest import ODD


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def bytes_of(texts):
    return [t.encode() for t in texts]


def block(texts):
    return next(fp.blocks(texts))[1:]


def grades_by_definition(data):
    out = []
    for i in range(len(data) - 63):
        w = data[i : i + 64]
        out.append(fp.GRADES * -sum(w.count(c) / 64 * log2(w.count(c) / 64) for c in set(w)) / 6)
    return out


def places_by_definition(text, rank):
    graded = fp.grades(np.frombuffer(text, np.uint8))
    own = [int(rank[g]) for g in graded]
    votes = [0] * len(own)
    for i in range(len(own)):
        run = own[i : i + 64]
        if min(run) <= fp.GRADES:
            votes[i + run.index(min(run))] += 1
    return [i for i, v in enumerate(votes) if v >= fp.VOTES]


def test_grades_by_definition(rng):
    for text in (prose(rng, 100), "a" * 100, "ab" * 60, prose(rng, 20) + "x" * 90, "Žltý kôň " * 20):
        got = fp.grades(np.frombuffer(text.encode(), np.uint8))
        assert np.abs(got - np.array(grades_by_definition(text.encode()))).max() <= 1.01
    assert len(fp.grades(np.frombuffer(b"short", np.uint8))) == 0 and fp.grades(np.frombuffer(b"a" * 64, np.uint8)).tolist() == [0]


@pytest.mark.parametrize("size", (1 << 20, 100))
def test_features_by_definition(rng, monkeypatch, size):
    monkeypatch.setattr(fp, "SLICE", size)
    texts = bytes_of([prose(rng, 150), "", "ab", prose(rng, 12), "x" * 300, prose(rng, 80), prose(rng, 10)])
    rank = fp.ranks(np.array([rng.randrange(1000) for _ in range(fp.GRADES + 1)]))
    data, starts = block(texts)
    got = fp.feature_places(data, starts, rank)
    want = [int(s) + p for s, t in zip(starts, texts, strict=False) for p in places_by_definition(t, rank)]
    assert got.tolist() == want and len(want) > 10


def test_rarest_first():
    n = np.array([5] * fp.GRADES + [1])
    rank = fp.ranks(n)
    assert rank[fp.GRADES] == 0 and rank[fp.WEAK] < rank[fp.WEAK + 1] and (rank[: fp.WEAK] == fp.GRADES + 1).all()


def test_likeness(rng):
    rank = fp.ranks(np.arange(fp.GRADES + 1))
    one, other = prose(rng, 3000), prose(rng, 3000)
    half = fp.edited(one, other)
    a, b, c, d = fp.fingerprints(bytes_of([one, other, half, one]), rank)
    assert len(a) > 1 and (a == d).all() and fp.likeness(a, d) == 1
    assert fp.likeness(a, b) < 0.1 and 0.4 < fp.likeness(a, c) < 0.7 and fp.likeness(a, c) == fp.likeness(c, a)
    assert fp.likeness(a, a[:0]) == 0 and fp.likeness(a[:0], a[:0]) == 1


def test_bloom_takes_features_once(rng):
    h = np.array([rng.getrandbits(64) for _ in range(200)], np.uint64)
    assert (fp.bloom(h) == fp.bloom(np.concatenate([h, h[::-1]]))).all() and len(fp.bloom(h)) == 2
    assert np.bitwise_count(fp.bloom(h[:1])).sum() <= fp.HASHES


def in_order(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    return [(i, t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows)]


def check(df, rows):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in df.collect())
    want = sorted((i is not None, i or 0, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for i, t, n in in_order(rows))
    assert got == want


@pytest.mark.parametrize("share", (512, 7))
def test_documents_against_loops(spark, rng, monkeypatch, share):
    monkeypatch.setattr(fp, "RANGE_ROWS", share)
    monkeypatch.setattr(fp, "BLOCK", 1 << 14)
    rows = [(rng.randrange(-500, 500) * 7 + k, prose(rng, rng.choice((3, 30, 300)))) for k in range(60)]
    rows += [(9000 + k, "the same text in every row " * 9) for k in range(20)] + [(None, "unknown"), (None, "another")]
    df = fp.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).cache()
    check(df, rows)
    got = df.collect()
    same = [r for r in got if r.doc_id is not None and r.doc_id >= 9000]
    assert len({r.fingerprint for r in same}) == 1 and all(r.near_next == 1 for r in sorted(same)[:-1])
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    texts = [t for _, t, _ in in_order(rows)]
    n = np.zeros(fp.GRADES + 1, np.int64)
    for t in texts:
        n += np.bincount(fp.grades(np.frombuffer(t.encode(), np.uint8)), minlength=fp.GRADES + 1)
    want = fp.fingerprints(bytes_of(texts), fp.ranks(n))
    assert sorted(r.fingerprint for r in got) == sorted(map(fp.written, want))


def test_fingerprints_odd(spark, odd, nothing):
    check(fp.fingerprint_documents(odd), ODD)
    assert fp.fingerprint_documents(nothing).count() == 0
    one = fp.fingerprint_documents(odd.where("doc_id = 1")).collect()
    assert [(r.near_next, r.near_edited) for r in one] == [(1.0, 0.0)]  # its one feature is the whole text


def test_op11_on_documents(spark, base, documents):
    from harvestry.llm.registry import queries

    rows = queries()["op11_fingerprints"](spark, base).collect()
    check(spark.createDataFrame(rows), [(r.doc_id, r.text) for r in documents.collect()])
    long = [r for r in rows if r.n_chars > 500]
    assert np.median([r.near_next for r in long]) < 0.2 < np.median([r.near_edited for r in long])
