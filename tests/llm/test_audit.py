"""The filter audit against plain loops over documents and orders, and on odd rows."""

from itertools import permutations

from harvestry.llm import audit
from tests.llm.conftest import ODD

LABEL = "doc_id long, quality int, toxic int"


def fails(rows, i):
    """Names of the filters that row i fails, by their definitions."""
    doc, text = rows[i][0], rows[i][1] or ""
    words = text.encode().split()
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
        out.add("C")
    if set(text) & set("#$%&*|"):
        out.add("D")
    if doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, *_ in rows):
        out.add("E")
    return out


def by_loops(rows, labels):
    out = {}
    failing = [fails(rows, i) for i in range(len(rows))]
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}  # an unknown id is nobody's
    for part in {r[2] or "" for r in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = set(mine)
            for step, f in enumerate(order, 1):
                here = {i for i in left if f in failing[i]}
                shapley[f] += len(here)
                failed = {i for i in mine if f in failing[i]}
                redundant = len(failed - left)
                left -= here
                ids = [rows[i][0] for i in here]
                out[part, "".join(order), step] = [len(left), len(here), redundant, sum(failing[i] == {f} for i in mine), sum(d in good for d in ids), sum(d in toxic for d in ids), f]
        for key, x in out.items():
            if key[0] == part:
                x[-1] = shapley[x[-1]]
    return out


def got(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_step_table_by_definition():
    table = audit.step_table()
    assert table.shape == (32, 120)
    for pattern in range(32):
        for k, order in enumerate(audit.ORDERS):
            steps = [s for s, f in enumerate(order) if pattern >> "ABCDE".index(f) & 1]
            assert table[pattern, k] == (steps[0] if steps else 5)


def test_audit_against_loops(spark, rng, monkeypatch):
    def text():
        words = [f"w{rng.randrange(rng.choice((40, 400)))}" for _ in range(rng.choice((20, 199, 200, 400)))]
        return " ".join(words) + rng.choice(("", " #", " " + "ABC" * rng.randrange(30)))

    rows = [(i * 3, text(), rng.choice(("en", "fr", "", None))) for i in range(80)]
    rows += [(300 + i, rows[rng.randrange(80)][1], "en") for i in range(60)] + [(1, rows[5][1], "de"), (1, rows[5][1], "de"), (None, rows[5][1], "de"), (400, None, "de"), (401, "", "de")]
    labels = [(i * 3, rng.randrange(2), rng.randrange(2)) for i in range(60)] + [(0, 0, 1), (0, 1, 0), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    want = by_loops(rows, labels)
    for held in (1000, 1):  # also where a task hands on its counts after each batch
        monkeypatch.setattr(audit, "HELD_PARTS", held)
        assert got(audit.audit(docs, spark.createDataFrame(labels, LABEL))) == want


def test_audit_odd(spark, odd, nothing):
    rows = [(d, t, "en") for d, t in ODD]
    labels = spark.createDataFrame([], LABEL)
    assert got(audit.audit(odd, labels)) == by_loops(rows, [])
    assert audit.audit(nothing, labels).count() == 0
