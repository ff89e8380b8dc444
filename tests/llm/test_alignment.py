"""Alignment of two tokenizers against plain loops over whole texts, and on odd rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tokenizers_of
import pyarrow as pa
import pytest

from harvestry.llm import alignment
from harvestry.llm.chunks import both, cuts
from tests.llm.conftest import ODD

FILES = (tokenizers_of.path(alignment.BYTE_LEVEL), tokenizers_of.path(alignment.PIECES))
PARTS = ["a", "the", "Bar", "\n", "\n\n", "  ", " ", " ", " ", ".", ",", "'s", "é", "—", "\t", "\r\n", "漢", "🙂", "1", "234", "----", "\x1c", "<s>", "<|endoftext|>", "　", "ẞ", "(", ");\r", "x" * 9, "\u0085", "<0x41>", "__", " ", "é"]


def hostile(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(n)))


def whole(text):
    """Tokens of a whole text by both libraries, with their bytes; none where the bytes don't come back."""
    known = both(*FILES)
    if not text:
        return [], []
    a = [(i, known.a_bytes[i]) for i in known.a.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, known.b_bytes[i]) for i in known.b.encode(text)]
    same = {b"".join(x for _, x in side) for side in (a, b)} == {(" " + text).encode()}
    return (a, b) if same else ([], [])


def by_loops(texts):
    grouped = []
    for text in texts:
        a, b = whole(text)
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, start = [], 0
        for cut in common:
            groups.append([[i for (i, _), e in zip(side, own, strict=True) if start < e <= cut] for side, own in zip((a, b), ends, strict=True)])
            start = cut
        grouped.append(groups)
    held = Counter(p for groups in grouped for p in {(i, j) for x, y in groups for i in x for j in y})
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = []
    for groups in grouped:
        links = [(i, j) for x, y in groups for i in x for j in y]
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), said))
    return out


def got(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, *(r[c] for c in alignment.SUMS), r.groups) for r in df.collect())


def want(rows):
    return sorted((d is not None, d or 0, *x) for (d, _), x in zip(rows, by_loops([t for _, t in rows]), strict=True))


def test_chunks_have_the_tokens_of_the_text(rng):
    known = both(*FILES)
    for _ in range(4000):
        text = " " + (hostile(rng, 14) or "x")
        raw = text.encode()
        at = [0, *np.flatnonzero(cuts(np.frombuffer(raw, np.uint8), known.together)).tolist(), len(raw)]
        a, b, _ = known.encode([raw[i:j] for i, j in zip(at, at[1:], strict=False)])
        assert sum(a, []) == known.a.encode(text, add_special_tokens=False).ids, text
        assert sum(b, []) == known.b.encode(text[1:]), text


@pytest.mark.parametrize("block", (alignment.BLOCK, 300))
def test_alignment_against_loops(spark, rng, block):
    rows = [(i * 3, hostile(rng, 60)) for i in range(60)] + [(500 + i, "one text in many rows, " * 3) for i in range(10)]
    rows += [(600, "- " + "-" * 3000), (601, "a ▁ mark"), (602, " "), (603, "\n"), (7, "a repeated id"), (7, "a repeated id")]
    df = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block=block)
    assert got(df) == want(rows)


def test_alignment_odd(odd, nothing):
    assert got(alignment.align(odd)) == want([(d, t) for d, t in ODD])
    assert alignment.align(nothing).count() == 0


def test_op13_on_documents(spark, base, documents):
    from harvestry.llm.registry import queries

    rows = [(r.doc_id, r.text) for r in documents.collect()]
    result = sorted((r.doc_id, *(r[c] for c in alignment.SUMS), r.groups_sha256) for r in queries()["op13_token_alignment"](spark, base).collect())
    assert result == [(*x[1:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "") for x in want(rows)]


def test_blocks_look_their_chunks_up(spark):
    """Documents come in rows of bounded size; pairs count once a document, and not where one of its chunks has none."""
    rows = [(i, "the cat " * (i % 3)) for i in range(alignment.ROW_DOCS + 90)]
    kept = alignment.chunked(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), FILES, alignment.BLOCK).where("ids is not null").collect()
    assert [len(r.sizes) for r in kept] == [alignment.ROW_DOCS, 90] and [d for r in kept for d in r.doc_ids] == list(range(len(rows)))
    assert all(len(r.ids) < sum(r.sizes) for r in kept)
    entries = pa.table({"local": [0, 1, 2, 3], "pairs": pa.array([[7, 5], [5], None, []], pa.list_(pa.int64())), "said": ["a", "b", None, "d"], **{c: pa.array([1, 10, None, 100], pa.int64()) for c in alignment.SUMS}})
    docs = pa.array([3, None, 4, 5], pa.int64()), np.array([3, 0, 2, 2], np.int32), np.array([0, 1, 0, 1, 2, 1, 3])
    (counts,) = alignment.pairs_held(iter([docs]), entries)
    assert counts.to_pydict() == {"pair": [5, 7], "docs": [2, 1]}
    (found,) = alignment.told(iter([docs]), entries)
    assert found.column("groups").to_pylist() == ["a;b;a", "", "", "b;d"] and found.column("n_a").to_pylist() == [12, 0, 0, 110]
