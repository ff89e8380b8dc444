"""Operators over documents: against brute force or exact round trips, and on odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from harvestry.llm import licenses, lines, packing, pieces, scoring, simhash, transport
from harvestry.llm.registry import oracle_sql, queries
from tests.llm.conftest import ODD
from tests.sqlcheck import same_rows


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, base, name):
    same_rows(queries()[name](spark, base), oracle_sql()[name], base)


def test_fingerprint_by_definition():
    import xxhash

    words = "the quick brown fox jumps over the lazy dog again".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(b"The QUICK brown fox\njumps  over the lazy dog again ") == want
    assert simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"two words") == xxhash.xxh64_intdigest(b"two words", 42)


def test_fingerprint_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit("žltý kôň pije vodu"))).first()[0]
    import xxhash

    assert got % (1 << 64) == xxhash.xxh64_intdigest("žltý kôň pije vodu".encode(), 42)


def near(rng, n):
    base_ = [f"w{rng.randrange(4000)}" for _ in range(200)]
    out = []
    for i in range(n):
        words = list(base_) if i % 3 else [f"v{rng.randrange(4000)}" for _ in range(200)]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(200)] = "changed"
        out.append((i * 7 % 1009, " ".join(words)))
    return out


def test_simhash_against_all_pairs(spark, rng, monkeypatch):
    rows = near(rng, 300) + [(2000, None), (2001, "")]
    want = simhash.brute_force(rows)
    for part in (simhash.PART, 20):  # also with parts so small that buckets are salted
        monkeypatch.setattr(simhash, "PART", part)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == want


def test_simhash_pairs_are_exact(rng):
    x = np.array([rng.getrandbits(64) for _ in range(40)] + [(0xFFFF ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) for _ in range(600)], np.uint64)
    got = {tuple(sorted(p)) for i, j in simhash.close_pairs(x, None) for p in zip(i.tolist(), j.tolist(), strict=True) if p[0] != p[1]}
    assert got == {(j, i) for i in range(len(x)) for j in range(i) if (int(x[i]) ^ int(x[j])).bit_count() <= 4}


def test_simhash_masks_cover_the_radius(rng):
    for n in (10, 10**7, 10**10):
        kept = simhash.masks(n)
        for _ in range(200):
            flip = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not flip & m for m in kept)


def test_simhash_odd(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3} and {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(nothing).count() == 0


def lines_by_hand(rows):
    strip = "".join(map(chr, [32, *range(9, 14)]))
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(strip))
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    has = defaultdict(set)
    for i, ls in docs:
        for x in ls:
            if len(key(x)) >= 20:
                has[key(x)].add(i)
    gone = {k: max(x for x in v if x is not None) for k, v in has.items() if len(v) >= 3}
    return Counter((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for i, ls in docs for kept in [[x for x in ls if key(x) not in gone or i == gone[key(x)]]])


def test_lines(spark, rng):
    pool = ["a line that is long enough to count"] * 2 + ["  A Line THAT is long enough to count\t", "short", "", "another line of some twenty letters", "ünïcödé lines count by code points"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(40)] + [(50, None), (51, ""), (3, "short\n" + pool[0]), (3, pool[0])]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out) == lines_by_hand(rows)


def test_lines_odd(odd, nothing):
    out = lines.dedup_lines(odd)
    assert out.count() == len(ODD) and "key" in out.columns
    assert lines.dedup_lines(nothing).count() == 0


def test_packing_is_whole(documents, odd, nothing):
    for docs in (documents, odd):
        rows = sorted(packing.pack(docs, 128).collect(), key=lambda r: (r.sequence_id, r.offset))
        at = 0
        for r in rows:
            assert (r.sequence_id, r.offset) == divmod(at, 128) and r.offset + r.length <= 128
            at += r.length
        texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        ids = Counter()
        for i, t in texts:
            ids[i, len(packing.encode(t, path()))] += 1
        assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == ids and sum(r.length for r in rows) == sum(n * k for (_, n), k in ids.items())
    assert packing.pack(nothing).count() == 0


def path():
    import public_tokenizers

    return public_tokenizers.path(packing.VOCABULARY)


def test_packing_ids_are_the_tokenizers_own(documents, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in documents.select("text").collect()] + [x or "" for _, x in ODD]
    texts += ["<|endoftext|>", "a <|endoftext|>b<|endoftext|> <|endoftext|>", "x<|endoftext|", " \n <|endoftext|>  \n z"]
    want = {x: [*e.ids, 1] for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True)}
    assert all(packing.encode(x, path()).tolist() == want[x] for x in texts)
    rows = packing.pack(spark.createDataFrame([(1, texts[0])], "doc_id long, text string")).collect()
    got = [zlib.crc32(np.array(want[texts[0]][r.start : r.start + r.length], "<u4").tobytes()) for r in rows]
    assert got == [r.ids_crc32 for r in rows]
    rows = packing.pack(spark.createDataFrame([(1, "a <|endoftext|>b")], "doc_id long, text string")).collect()
    assert [(r.length, r.ids_crc32) for r in rows] == [(5, zlib.crc32(np.array([64, 220, 50256, 65, 1], "<u4").tobytes()))]


def test_transport_stream_round_trip():
    for n in (0, 1, 191, 192, 193, 6143, 6144, 6145, 60_000, 130_000):
        payload = transport.padded(bytes(i * 31 % 251 for i in range(n)))
        data = transport.write_stream(payload)
        s = transport.parse_stream(data)
        assert b"".join(u[3] for u in s.units) == payload and len(data) % 188 == 0
        assert not (s.breaks or s.bad_sections or s.lost_sync) and s.types == {transport.DATA_PID: transport.PRIVATE_TYPE}
        assert [u[1] for u in s.units] == [k * transport.TICKS for k in range(len(s.units))] and s.units[0][2]


def test_transport_stream_faults():
    data = bytearray(transport.write_stream(transport.padded(b"x" * 9000)))
    assert transport.parse_stream(bytes(data[: 188 * 5] + data[188 * 6 :])).breaks == 1
    data[188 * 5] = 0
    assert transport.parse_stream(bytes(data)).lost_sync == 1
    broken = bytearray(transport.write_stream(transport.padded(b"x")))
    broken[10] ^= 1
    assert transport.parse_stream(bytes(broken)).bad_sections == 1
    assert transport.section_crc(b"123456789") == 0x0376E6E7  # the check value of this CRC


def packets(data):
    return [data[i : i + 188] for i in range(0, len(data), 188)]


def test_transport_stream_repeats_and_discontinuities():
    payload = transport.padded(bytes(range(250)) * 300)
    points = []
    data = transport.write_stream(payload, points)
    assert transport.parse_stream(data).points == points and len(points) == -(-len(payload) // (transport.UNIT * transport.RANDOM_EVERY))
    once = packets(data)
    s = transport.parse_stream(b"".join(p for q in once for p in (q, q)))  # each packet sent twice
    assert b"".join(u[3] for u in s.units) == payload and s.breaks == s.bad_sections == 0 and s.repeats == len(once)
    assert transport.parse_stream(b"".join([*once[:4], once[4], once[4], once[4], *once[5:]])).breaks == 1  # but not three times
    k = next(i for i, p in enumerate(once) if i > 50 and p[3] & 0x20 and p[1:3] == b"\x41\x01" and p[5] & 0x40)  # an access point's first packet
    cut = [*once[: k - 3], *once[k - 2 :]]  # without the data packet before it and its tables
    assert transport.parse_stream(b"".join(cut)).breaks == 1
    cut[k - 1] = cut[k - 1][:5] + bytes([cut[k - 1][5] | 0x80]) + cut[k - 1][6:]
    assert transport.parse_stream(b"".join(cut)).breaks == 0


def test_transport_stream_long_sections():
    """A map with many streams takes three packets; its section runs on across their headers."""
    streams = list(range(0x200, 0x200 + 80))
    import struct

    body = struct.pack(">HH", 0xE000 | streams[0], 0xF000) + b"".join(struct.pack(">BHH", 6, 0xE000 | p, 0xF000) for p in streams)
    long = b"\x00" + transport.section(2, 1, body)
    parts = [long[i : i + 184].ljust(184, b"\xff") for i in range(0, len(long), 184)]
    head = lambda pid, first, n: struct.pack(">BHB", 0x47, first << 14 | pid, 0x10 | n)
    data = head(0, 1, 0) + transport.tables()[0] + b"".join(head(transport.PMT_PID, i == 0, i) + p for i, p in enumerate(parts))
    s = transport.parse_stream(data)
    assert len(parts) == 3 and s.types == dict.fromkeys(streams, 6) and s.bad_sections == s.breaks == 0


def test_transport_stream_query(odd, nothing):
    rows = transport.read_back(transport.store(odd)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if r.doc_id in (4, 8):
            payload = transport.padded(dict(ODD)[r.doc_id].encode())
            assert (r.payload_sha256, r.tail_crc32, r.payload_bytes) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(payload))
    stored = {r.doc_id: r.points for r in transport.store(odd).collect()}
    assert all(r.points == stored[r.doc_id] and r.points[0].time == 0 for r in rows if r.doc_id != 10)
    assert transport.read_back(transport.store(nothing)).count() == 0


def test_license_notices(spark, odd, nothing):
    text = "Some prose.\n\nReleased under the MIT License.\n\nMore prose about a license to kill.\nLicensed under CC BY-NC 4.0.\n"
    moved = "This work is licensed under the GNU General Public License, version 2. Then " + "other words " * 300 + "\nlicensed  under the Apache License, version 2.0 and more"
    rows = licenses.scan(spark.createDataFrame([(1, text), (2, moved), (3, "We licensed the photo. Copyright 2020."), (4, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license) for r in sorted(rows, key=lambda r: (r.doc_id, r.start))] == [(1, "MIT"), (1, "CC-BY-NC-4.0"), (2, "GPL-2.0"), (2, "Apache-2.0")]
    assert all(text.encode()[r.start : r.start + r.length].decode() == r.notice for r in rows if r.doc_id == 1)
    assert licenses.scan(odd).count() == 0 and licenses.scan(nothing).count() == 0


def test_license_late_in_a_block():
    known = tuple(licenses.TEMPLATES.items())
    for name in ("MIT-text", "BSD-text", "Apache-2.0", "GPL-2.0"):
        own = licenses.TEMPLATES[name]
        for n in range(0, 420, 10):
            text = f" * Copyright 2020 A. Person\n * {'x' * n}\n * {own}\n".encode()
            assert [(x, text[a:b].decode()) for x, a, b, *_ in licenses.find(text, known)] == [(name, own[:-1])]
    # The words after this line leave it less than the share that is compared first.
    text = "Licensed under the Apache License, Version 2.0.\nEinbetztz chtz lichchach, erä heitö und tz, als schkeitöheit geö der, enlichensch äenau heitachzu. Der er ungber der.\nFür chenß erö, sch schüte ch, den ßst ungzu lichteein berte der für i".encode()
    assert [(x, a, b) for x, a, b, *_ in licenses.find(text, known)] == [("Apache-2.0", 0, 46)]
    text = b"licensed " * 30_000  # blocks that run on stay one, found in one pass
    assert licenses.blocks(text, 300) == [(0, len(text))]


def test_license_beside_an_unknown_version():
    known = tuple(licenses.TEMPLATES.items())
    for name in ("MIT", "CC-BY-4.0", "Apache-2.0", "GPL-2.0"):
        for notice in (b"This work is licensed under the GNU Lesser General Public License, version 2.1.", b"Licensed under the Apache License, Version 1.1."):
            own = licenses.TEMPLATES[name].encode()
            for text in (notice + b"\n" + own, own + b" " + notice, notice + b" " + own + b"\n" + notice):
                assert [(n, text[a:b]) for n, a, b, *_ in licenses.find(text, known)] == [(name, own[:-1])]


def test_licenses_of_the_documents(documents):
    planted = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    want = Counter((r.doc_id, name) for r in documents.collect() for line, name in planted.items() for _ in range((r.text or "").count(line)))
    assert Counter((r.doc_id, r.license) for r in licenses.scan(documents).collect()) == want


def test_license_texts_and_tags(rng):
    known = tuple(licenses.TEMPLATES.items())
    filler = lambda n: " ".join(rng.choice("some other words stand here and there in plain prose".split()) for _ in range(n))
    for name, own in known:
        wrapped = own.replace(". THE", ".\n\nTHE").replace(". 2.", ".\n2.")
        for text in (own, f"{filler(200)}\n{own}\n{filler(200)}", f"{filler(30)}\n\n{wrapped}\n\n{filler(30)}"):
            assert [x for x, *_ in licenses.find(text.encode(), known)] == [name], (name, text)
    for text, name in (("Distributed under the ISC License", "ISC"), ("It is licensed under the MIT license", "MIT"), ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0-only-tag"), ("he studied at MIT, under the old license", None), (licenses.TEMPLATES["LGPL-3.0-header"].replace("version 3", "version 2"), None)):
        assert [x for x, *_ in licenses.find(text.encode(), known)] == [name] * bool(name)


def test_license_work_grows_with_the_text():
    import time

    known = tuple(licenses.TEMPLATES.items())
    took = []
    for n in (400, 1600):
        text = "".join(f"Part {i}: Released under the MIT License. \n" for i in range(n)).encode()
        licenses.inside.cache_clear()
        began = time.process_time()
        assert [x for x, *_ in licenses.find(text, known)] == ["MIT"] * n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]


def test_license_alternatives_and_short_forms():
    known = tuple(licenses.TEMPLATES.items())
    for text, names in (
        ("// SPDX-License-Identifier: MIT OR Apache-2.0\n", ["MIT-tag", "Apache-2.0-tag"]), ("# SPDX-License-Identifier: MIT OR (Apache-2.0) AND ISC\n", ["MIT-tag", "Apache-2.0-tag", "ISC-tag"]), ("It is licensed under GPLv3.", ["GPL-3.0-short"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]), ("Licensed under the EUPL, Version 1.2", ["EUPL-1.2"]), ("SPDX-License-Identifier: MIT OR Nobody", ["MIT-tag"]),
        ("Released under the MIT License. Part 2. Released under the ISC License. And: Released under the MIT License.", ["MIT", "ISC", "MIT"]),
    ):
        assert [x for x, *_ in licenses.find(text.encode(), known)] == names, text


def test_no_cue_no_license(documents):
    """What decides that a text is looked at loses nothing: without it the same notices are found."""
    known = tuple(licenses.TEMPLATES.items())
    some = [r.text.encode() for r in documents.collect() if r.text and not licenses.CUES.search(r.text.encode())][:60]
    prepared = licenses.prepared(known)
    for text in some:
        listed = licenses.words(text)[0]
        assert not any(licenses.confirm(listed, template, telling) for _, _, _, template, telling in prepared)


def small_pieces(rng, n_best=4):
    names = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab"]
    return pieces.Pieces([(p, 300 + i, rng.choice([-1.0, -2.0, -3.5, -2.2])) for i, p in enumerate(names)], {b: b for b in range(256)}, n_best)


def all_segmentations(table, text):
    x, out = "▁" + text.replace(" ", "▁"), []

    def go(i, s, ids):
        if i == len(x):
            out.append((round(s, 6), tuple(ids)))
            return
        for j in range(i + 1, len(x) + 1):
            if x[i:j] in table.score:
                go(j, s + table.score[x[i:j]][0], [*ids, table.score[x[i:j]][1]])
        if x[i] not in table.score:
            go(i + 1, s + table.unknown, [*ids, *x[i].encode()])

    go(0, 0.0, [])
    return sorted(out, key=lambda r: -r[0])


def test_n_best_against_all(rng):
    for _ in range(20):
        table = small_pieces(rng)
        for _ in range(20):
            text = "".join(rng.choice("abc d") for _ in range(rng.randrange(1, 10)))
            got, want = [(round(s, 6), i) for s, i in table.best(text)], all_segmentations(table, text)
            assert [s for s, _ in got] == [s for s, _ in want[:4]] and len(set(got)) == len(got) and set(got) <= set(want)


def test_parts_side_by_side_as_one_by_one(rng):
    for _ in range(20):
        table = small_pieces(rng)
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(40)]
        size = np.array([len(w) for w in words])
        codes = np.array([[table.codes[ord(w[k])] if k < len(w) else 0 for w in words] for k in range(size.max())])
        score, loss, length, ids = table.abreast(codes, size)
        want = [table.best_two(w) for w in words]
        assert list(zip(score, loss, strict=True)) == [w[:2] for w in want]
        assert length.tolist() == [len(w[2]) for w in want] and ids.tolist() == [i for w in want for i in w[2]]


def test_new_chunks_are_searched_together(rng, monkeypatch):
    """op8: the place-by-place search in Python is only for the chunks that can be in the N best, however many are new."""
    calls, ways = [], pieces.Pieces.ways
    monkeypatch.setattr(pieces.Pieces, "ways", lambda table, text: calls.append(text) or ways(table, text))
    table = small_pieces(rng, 3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(4, 12))) for _ in range(2000)]
    (score, ids), *_ = table.best(" ".join(words))
    assert len(calls) <= 2 * 12 and len(set(words)) > 1000  # two chunks of at most twelve characters
    assert ids == tuple(i for w in words for i in table.lattice("▁" + w)[0][1])
    assert abs(score - sum(table.lattice("▁" + w)[0][0] for w in words)) < 1e-6


def test_pieces_round_trip(documents, odd, nothing):
    import public_tokenizers

    table = pieces.load(public_tokenizers.path(pieces.MODEL))
    for t in [r.text for r in documents.select("text").collect()] + [x for _, x in ODD if x and "▁" not in x]:
        assert all(table.decode(ids) == t for _, ids in table.best(t))
    assert pieces.segment_documents(documents).where("not round_trip").count() == 0
    rows = pieces.segment_documents(odd).collect()
    assert len(rows) == len(ODD) and {r.doc_id for r in rows if not r.round_trip} == {10}
    assert [(len(r.ids), r.best_score, r.others) for r in rows if r.doc_id == 4] == [(0, 0.0, [])]
    assert pieces.segment_documents(nothing).count() == 0 and pieces.decode_documents(pieces.segment_documents(nothing)).count() == 0


def test_pieces_as_a_user_has_them(spark, documents):
    from pyspark.sql import functions as F

    encoded = pieces.segment_documents(documents)
    texts = {r.doc_id: r.text for r in documents.collect()}
    decoded = {r.doc_id: r.text for r in pieces.decode_documents(encoded).collect()}
    again = {r.doc_id: r.text for r in pieces.decode_documents(encoded.select("doc_id", F.get("others", F.lit(0)).alias("x")), column="x").collect()}
    assert decoded == texts and {i: t for i, t in again.items() if t} == {i: t for i, t in texts.items() if again[i]}
    import public_tokenizers

    table = pieces.load(public_tokenizers.path(pieces.MODEL))
    for r in pieces.encode_documents(documents).limit(20).collect():
        assert r.ids == list(table.best(texts[r.doc_id])[0][1])
    assert [table.raw[i].decode() for i in table.best("The cat sat on the mat")[0][1]] == ["▁The", "▁cat", "▁sat", "▁on", "▁the", "▁mat"]


def test_scores_of_a_unigram_model_stay():
    given = [("a", 3, -1.5), ("b", 4, -2.25), ("ab", 5, -3.0)]
    assert pieces.by_rank(given) == given
    ranked = pieces.by_rank([("a", 3, -7.0), ("b", 4, -2.0), ("ab", 5, -1e9)])
    assert ranked[1][2] > ranked[0][2] and ranked[2][2] == -1e9 and abs(sum(np.exp(s) for *_, s in ranked[:2]) - 1) < 1e-12


def test_scoring_base_by_hand(documents):
    from pyspark.sql import functions as F

    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in documents.collect()]
    counts = Counter()
    for _, t, train in rows:
        if train:
            counts.update([*t.encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    marked = documents.withColumn("train", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    for frequent in (50, 200_000):  # with and without a tail that is joined
        got = {r.doc_id: r for r in scoring.score_documents(marked, frequent, 2000).collect()}
        for i, t, _ in rows:
            tokens = [*t.encode().lower().split(), b""]
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in counts for w in tokens), n)
            assert abs(r.base_score - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)) < 1e-6
            assert r.score < 0 and r.spelled_score <= r.score + 1e-9 and 0 < r.bits_per_byte < 20
    held = [got[i] for i, _, train in rows if not train]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_spelling_is_a_distribution():
    """All spellings of one byte, and all longer ones by their first byte, share a probability of one."""
    table = np.zeros((len(scoring.ORDERS), 2, 1 << scoring.BITS), np.uint32)
    words = [b"abc", b"abd", b"bcd", b"", b"cab"] * 20
    scoring.bit_counts(words, table)
    mixer = scoring.learn(table, words)
    for stem in (b"", b"a", b"ab"):
        own = 10 ** mixer.log10([stem])[0]
        longer = 10 ** mixer.log10([stem + bytes([b]) for b in range(256) if b != 32])
        # P(stem then anything) = P(stem ends) + sum over next bytes; the last uses words that end there only, so it is a bound
        assert own + longer.sum() <= 1 + 1e-9
    first = sum(10 ** _first_byte(mixer, b) for b in range(256))
    assert abs(first - 1) < 1e-9


def _first_byte(mixer, byte):
    total = 0.0
    for _, data, contexts in scoring.spelled([b"" if byte == 32 else bytes([byte])]):
        for b, (node, bit) in enumerate(scoring.bits_of(data[:1])):
            at = [scoring.slots(c[:1], node) for c in contexts]
            gate = mixer.known[-1][at[-1]].astype(int) * 8 + mixer.known[-3][at[-3]]
            x = mixer.weights[gate, -1] + sum(mixer.weights[gate, k] * mixer.stretch[k][s] for k, s in enumerate(at))
            p = (1 / (1 + np.exp(-np.clip(x, -20, 20))) + mixer.refined[b, gate // 8, mixer.level(x)]) / 2
            total += float(np.log10(p if bit[0] else 1 - p)[0])
    return total


def test_scoring_odd(odd, nothing):
    from pyspark.sql import functions as F

    rows = scoring.score_documents(odd.withColumn("train", F.lit(True)), 10, 100).collect()
    assert len(rows) == len(ODD) and all(np.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert scoring.score_documents(nothing.withColumn("train", F.lit(True))).count() == 0
    none = scoring.score_documents(odd.withColumn("train", F.lit(False)), 10, 100).collect()
    assert len(none) == len(ODD) and {r.train_tokens for r in none} == {0}
