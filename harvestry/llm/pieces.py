"""SentencePiece encoding and decoding with N-best segmentation.

A chunk's lattice holds all pieces at all places. A forward Viterbi pass gives each place's best score from the start; a
backward A-star search from the end takes these as exact heuristics, so paths come out in order of their scores. A text is
cut where no piece crosses (between a letter and a blank, say), so its lattice falls into independent chunks: the N best
segmentations of the text are the N best sums over its chunks. Characters without a piece are spelled by byte pieces.

Of most chunks only the best path and what the second loses is needed. New chunks are therefore searched side by side, place by
place: one array operation extends the paths of thousands of chunks by the pieces of one length.

A unigram model's scores are log-probabilities and are taken as they are. A merge table's scores are only the ranks of its
pieces, whose sums mean nothing (they favour many early pieces over the one that they merge into); there a piece's
log-probability follows from its rank by the Zipf-Mandelbrot law.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush, nsmallest
from itertools import chain, count, islice
from math import log

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm.common import bounded_batches, each_batch, read_table, texts_of

MODEL, N_BEST = "piece_bpe_32k.model", 3
#: What the Zipf-Mandelbrot law adds to a rank.
FLAT = 100
BLANK = "▁"
#: What a character without a piece costs beyond the lowest score of a usual piece.
UNKNOWN_COST = 10.0
#: Characters of the chunks that a worker remembers, at which it begins anew; characters of texts that are segmented at once.
CACHE, AT_ONCE = 8_000_000, 1 << 19
#: The longest parts that are searched side by side, and how many.
LONGEST, ABREAST = 48, 4096


#: Segmentations as (score, ids), best first.
Best = list[tuple[float, tuple[int, ...]]]


class Column:
    """An array that grows at its end."""

    def __init__(self, kind: str) -> None:
        self.room, self.size = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.zeros(need, self.room.dtype)])
        self.room[self.size : need] = more
        self.size = need


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Digests:
    """By a chunk's number its best score, what the second loses (infinite where there is none), its best ids' place among
    `ids` and their number, and whether they decode to the chunk."""

    def __init__(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.characters = 0
        self.score, self.loss, self.start, self.size, self.same, self.ids = (Column(kind) for kind in ("f8", "f8", "i8", "i8", "?", "<u4"))


class Pieces:
    """A piece table: pieces with ids and scores, byte pieces, and the N best segmentations of texts."""

    def __init__(self, pieces: Iterable[tuple[str, int, float]], bytes_: dict[int, int], n_best: int = N_BEST) -> None:
        self.score = {p: (s, i) for p, i, s in pieces}
        self.bytes_, self.n_best = bytes_, n_best
        self.raw = {i: p.encode("utf-8", "surrogatepass") for p, (_, i) in self.score.items()} | {i: bytes([b]) for b, i in bytes_.items()}
        # Every prefix of a piece, with the piece's score and ids where it is one.
        self.trie: dict[str, tuple[float, tuple[int, ...]] | None] = {p[:k]: None for p in self.score for k in range(1, len(p))}
        self.trie.update((p, (s, (i,))) for p, (s, i) in self.score.items())
        self.pairs = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        usual = [s for s, _ in self.score.values() if s > -1e8]
        self.unknown = min(usual, default=0.0) - UNKNOWN_COST
        crossed = any(p[k] != BLANK and p[k + 1] == BLANK for p in self.score for k in range(len(p) - 1))
        self.chunks = re.compile(".+" if crossed else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", re.S)
        # The same as arrays: characters have codes (0: in no piece), prefixes are numbered nodes, a step is a node and a code.
        letters = sorted({c for p in self.score for c in p})
        code = dict(zip(letters, range(1, len(letters) + 1), strict=True))
        self.width = len(letters) + 1
        self.codes = np.zeros(ord(letters[-1]) + 2 if letters else 1, np.int64)
        self.codes[list(map(ord, letters))] = range(1, self.width)
        node = {p: k for k, p in enumerate(["", *filter(None, self.trie)])}
        self.steps = np.full(len(node), np.iinfo(np.int64).max)
        self.steps[:-1] = [node[p[:-1]] * self.width + code[p[-1]] for p in islice(node, 1, None)]
        self.after_step = np.argsort(self.steps) + 1
        self.steps.sort()
        self.worth, self.piece = np.full(len(node), -np.inf), np.zeros(len(node), np.uint32)
        for p, k in islice(node.items(), 1, None):
            self.worth[k], self.piece[k] = self.score.get(p, (-np.inf, 0))
        self.alone = np.array([False, *(c in self.score for c in letters)])
        self.crossed = np.sort([np.iinfo(np.int64).max, *(code[x] * self.width + code[y] for x, y in self.pairs)])
        self.raw_size = np.zeros(max(self.raw, default=0) + 1, np.int64)
        self.raw_size[list(self.raw)] = [len(x) for x in self.raw.values()]
        self.known = Digests()

    def ways(self, text: str) -> tuple[list[list[tuple[float, int, tuple[float, tuple[int, ...]]]]], list[float]]:
        """Forward Viterbi: per place the ways into it (score from the start, start, piece) and the best score from the start."""
        n, look, score = len(text), self.trie.get, self.score
        into: list[list] = [[] for _ in range(n + 1)]
        best = [0.0] + [-np.inf] * n
        for i in range(n):
            have = best[i]
            for j in range(i + 1, n + 1):
                found = look(text[i:j], 0)
                if not found:
                    if found is None:
                        continue
                    break
                to = have + found[0]
                into[j].append((to, i, found))
                if to > best[j]:
                    best[j] = to
            if text[i] not in score:
                to = have + self.unknown
                spelled = tuple(self.bytes_[b] for b in text[i].encode("utf-8", "surrogatepass"))
                into[i + 1].append((to, i, (self.unknown, spelled)))
                best[i + 1] = max(best[i + 1], to)
        return into, best

    def lattice(self, text: str) -> Best:
        """The N best (score, ids) of one chunk, best first, by A-star from the end; paths of equal scores in a fixed order."""
        into, best = self.ways(text)
        most = self.n_best
        for edges in into:  # beyond the N best ways into a place no other can be on an N best path
            if len(edges) > most:
                edges.sort(key=lambda e: (-e[0], e[1]))
                del edges[most:]
        out: Best = []
        # An entry: minus the whole path's score, a number, the place it has come back to, its own part of the score, its pieces.
        heap: list[tuple[float, int, int, float, tuple]] = [(-best[-1], 0, len(text), 0.0, ())]
        count = 0
        while heap:
            whole, _, at, own, path = heappop(heap)
            while at:
                first = into[at][0]
                for edge in into[at][1:]:
                    if edge[0] > first[0]:
                        first, edge = edge, first
                    count += 1
                    heappush(heap, (-(edge[0] + own), count, edge[1], own + edge[2][0], (edge[2][1], path)))
                # The best way in keeps the path's score, so nothing in the heap comes before it.
                own, at, path = own + first[2][0], first[1], (first[2][1], path)
            ids: list[int] = []
            while path:
                ids += path[0]
                path = path[1]
            out.append((-whole, tuple(ids)))
            if len(out) == most:
                break
        return out

    def best_two(self, text: str) -> tuple[float, float, list[int]]:
        """A part's best score, what the second loses (the best path through a way that the best path does not take), the best ids."""
        into, best = self.ways(text)
        n, path = len(text), []
        taken: list = [None] * (n + 1)
        at = n
        while at:
            first = into[at][0]
            for edge in into[at]:
                if edge[0] > first[0]:
                    first = edge
            taken[at], at = first, first[1]
            path.append(first[2][1])
        after, second = [-np.inf] * n + [0.0], -np.inf
        for j in range(n, 0, -1):
            rest = after[j]
            for edge in into[j]:
                if edge is not taken[j] and edge[0] + rest > second:
                    second = edge[0] + rest
                if edge[2][0] + rest > after[edge[1]]:
                    after[edge[1]] = edge[2][0] + rest
        return best[n], best[n] - second, [i for piece in reversed(path) for i in piece]

    def edges(self, codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each length the scores of the pieces that begin at (place, part), without a piece minus infinity; and their ids.

        codes[place, part] are the parts' characters, 0 behind their ends.
        """
        flat, abreast = codes.ravel(), codes.shape[1]
        at, node = np.flatnonzero(flat), np.zeros(np.count_nonzero(flat), np.int64)
        worth, ids, ahead = [], [], at
        while True:
            key = node * self.width + flat[ahead]
            step = np.searchsorted(self.steps, key)
            there = self.steps[step] == key
            at, node = at[there], self.after_step[step[there]]
            if not len(at):
                return worth, np.array(ids)
            worth.append(np.full(codes.shape, -np.inf))
            ids.append(np.zeros(codes.shape, np.uint32))
            worth[-1].ravel()[at], ids[-1].ravel()[at] = self.worth[node], self.piece[node]
            ahead = at + len(worth) * abreast
            inside = ahead < len(flat)
            at, node, ahead = at[inside], node[inside], ahead[inside]

    def abreast(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """best_two() of many parts at once, with equal results: scores, losses, how many ids each has, all ids in a row.

        codes[place, part] as for edges(); size: their lengths. Each character has a piece of its own.
        """
        worth, ids = self.edges(codes)
        places, n = codes.shape
        best, back = np.full((places + 1, n), -np.inf), np.zeros((places + 1, n), np.int8)
        best[0] = 0
        for j in range(1, places + 1):
            for length in range(min(j, len(worth)), 0, -1):  # of equal scores the one that comes from farthest
                to = best[j - length] + worth[length - 1][j - length]
                better = to > best[j]
                np.copyto(best[j], to, where=better)
                np.copyto(back[j], length, where=better)
        after, second, at, taken = np.full((places + 1, n), -np.inf), np.full(n, -np.inf), size.copy(), np.zeros((places + 1, n), np.int8)
        after[size, np.arange(n)] = 0
        for j in range(places, 0, -1):
            np.copyto(taken[j], back[j], where=at == j)
            for length in range(1, min(j, len(worth)) + 1):
                own, i = worth[length - 1][j - length], j - length
                through = best[i] + own + after[j]
                through[taken[j] == length] = -np.inf
                np.maximum(second, through, out=second)
                np.maximum(after[i], own + after[j], out=after[i])
            at -= taken[j]
        part, end = np.nonzero(taken.T)
        length = taken[end, part].astype(np.int64)
        score = best[size, np.arange(n)]
        return score, score - second, np.bincount(part, minlength=n), ids[length - 1, end - length, part]

    def learn(self, chunks: list[str]) -> None:
        """Add the digests of new chunks, in this order: cut where no piece crosses, distinct parts searched side by side."""
        text, sizes = "".join(chunks), np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.append(self.codes[np.minimum(points, len(self.codes) - 1)], 0)
        begins = np.cumsum(sizes) - sizes
        cut = np.ones(len(points), bool)
        pair = codes[:-2] * self.width + codes[1:-1]
        cut[1:] = self.crossed[np.searchsorted(self.crossed, pair)] != pair
        cut[begins] = True
        bounds = np.append(np.flatnonzero(cut), len(points))
        ends = bounds[1:].tolist()
        parts: dict[str, int] = defaultdict(count().__next__)
        which = np.fromiter((parts[text[a:b]] for a, b in zip(bounds.tolist(), ends, strict=False)), np.int64, len(ends))
        first = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))
        start, size = bounds[first], np.diff(bounds)[first]
        usual = np.logical_and.reduceat(self.alone[codes[:-1]], bounds[:-1])[first] & (size <= LONGEST)

        # The parts in the order in which they are searched, then their digests in that order.
        order = np.concatenate([np.flatnonzero(usual)[np.argsort(-size[usual], kind="stable")], np.flatnonzero(~usual)])
        n, found, said = int(usual.sum()), [], list(parts)
        for low in range(0, n, ABREAST):
            some = order[low : min(low + ABREAST, n)]
            place = np.arange(size[some[0]])[:, None]
            found.append(self.abreast(np.where(place < size[some], codes[np.minimum(start[some] + place, len(points))], 0), size[some]))
        for k in order[n:].tolist():
            score, loss, ids = self.best_two(said[k])
            found.append((np.array([score]), np.array([loss]), np.array([len(ids)]), np.array(ids, np.uint32)))
        score, loss, length, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))

        of, head = at[which], np.searchsorted(bounds, begins)
        ids, length = ids[ranges((np.cumsum(length) - length)[of], length[of])], np.add.reduceat(length[of], head)
        known, place = self.known, np.cumsum(length) - length
        known.start.add(place + known.ids.size)
        for column, values in ((known.score, np.add.reduceat(score[of], head)), (known.loss, np.minimum.reduceat(loss[of], head)), (known.size, length), (known.ids, ids), (known.same, self.spell(ids, place, chunks, text, points, begins))):
            column.add(values)
        known.characters += len(text)

    def spell(self, ids: np.ndarray, place: np.ndarray, chunks: list[str], text: str, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """spells() of many chunks in a row: their ids, where each one's begin; the chunks, as one text, its characters, where each begins."""
        size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        if b"".join(map(self.raw.__getitem__, ids.tolist())) == text.encode("utf-8", "surrogatepass") and (np.add.reduceat(self.raw_size[ids], place) == np.add.reduceat(size, begins)).all():
            return np.ones(len(chunks), bool)
        return np.array([self.spells(some.tolist(), c) for some, c in zip(np.split(ids, place[1:]), chunks, strict=True)])

    def spells(self, ids: Iterable[int], text: str) -> bool:
        """Whether the ids decode to the chunk: texts are their chunks in a row, so each can be decoded by itself."""
        return b"".join(map(self.raw.__getitem__, ids)) == text.encode("utf-8", "surrogatepass")

    def cuts(self, text: str) -> list[int]:
        """Places where no piece crosses."""
        pairs = self.pairs
        return [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in pairs]

    def chunk(self, text: str) -> Best:
        """The N best of a chunk, cut further where no piece crosses."""
        cuts = self.cuts(text)
        return self.join([self.lattice(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]) if cuts else self.lattice(text)

    def chunks_of(self, text: str) -> list[str]:
        return self.chunks.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def numbers_of(self, chunks: list[str]) -> np.ndarray:
        """The chunks' numbers among the known digests; new ones are learned first."""
        if self.known.characters > CACHE:
            self.known = Digests()
        known = self.known
        numbers = np.fromiter(map(known.number.__getitem__, chunks), np.int64, len(chunks))
        new = len(known.number) - known.score.size
        if new:
            try:
                self.learn([*islice(reversed(known.number), new)][::-1])
            except Exception:
                self.known = Digests()  # not one with chunks that have a number but no digest
                raise
        return numbers

    def join(self, parts: list[Best]) -> Best:
        """The N best sums over the parts' N best lists."""
        total = sum(p[0][0] for p in parts)
        return [(total - loss, tuple(i for k, p in enumerate(parts) for i in p[c.get(k, 0)][1])) for loss, c in self.changes(parts)]

    def changes(self, parts: list[Best]) -> list[tuple[float, dict[int, int]]]:
        """What the N best choices lose against the best, and which parts take another rank there.

        A choice that is among the N best changes at most N - 1 parts, each of them among the N - 1 whose second rank
        loses least, so a search over those parts is exact.
        """
        n = self.n_best
        second = [p[0][0] - p[1][0] if len(p) > 1 else np.inf for p in parts]
        done: list[tuple[float, dict[int, int]]] = [(0.0, {})]
        for k in nsmallest(n - 1, range(len(parts)), key=second.__getitem__):
            p = parts[k]
            options = [(loss + p[0][0] - p[r][0], {**c, k: r} if r else c) for loss, c in done for r in range(len(p))]
            done = sorted(options, key=lambda x: x[0])[:n]
        return done

    def ranked(self, texts: Iterable[str]) -> Iterator[tuple[float, list[tuple[float, bytes]], bool]]:
        """Of each whole text the best score; of its N best segmentations what each loses and its ids as bytes; whether all of
        them decode to the text. Texts are taken together up to AT_ONCE characters.

        Only the N - 1 chunks whose second rank loses least are searched beyond their best.
        """
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= AT_ONCE:
                yield from self.ranked_together(some)
                some, size = [], 0
        yield from self.ranked_together(some)

    def ranked_together(self, texts: list[str]) -> Iterator[tuple[float, list[tuple[float, bytes]], bool]]:
        lists_of = [self.chunks_of(text) for text in texts]
        numbers, known = self.numbers_of(list(chain.from_iterable(lists_of))), self.known
        score, loss, size = (column.room[numbers] for column in (known.score, known.loss, known.size))
        ends = np.append(0, np.cumsum(size))
        wrong = np.append(0, np.cumsum(~known.same.room[numbers])).tolist()
        ids = known.ids.room[ranges(known.start.room[numbers], size)]
        high = 0
        for text, chunks in zip(texts, lists_of, strict=True):
            low, high = high, high + len(chunks)
            few = min(self.n_best - 1, len(chunks))
            cheap = np.argpartition(loss[low:high], few - 1)[:few].tolist() if few else []
            lists = [self.chunk(chunks[k]) for k in cheap]
            same = BLANK not in text and wrong[low] == wrong[high] and all(self.spells(x, chunks[k]) for k, best in zip(cheap, lists, strict=True) for _, x in best)
            out = []
            for lost, changed in self.changes(lists):
                own, at = [], ends[low]
                for k, rank in sorted((cheap[c], lists[c][rank][1]) for c, rank in changed.items()):
                    own += [ids[at : ends[low + k]].tobytes(), packed(rank)]
                    at = ends[low + k + 1]
                out.append((lost, b"".join([*own, ids[at : ends[high]].tobytes()])))
            yield sum(score[low:high].tolist()), out, same

    def best(self, text: str) -> Best:
        """The N best (score, ids) of a whole text; an empty text has one empty segmentation."""
        score, ranks, _ = next(self.ranked([text]))
        return [(score - loss, struct.unpack(f"<{len(ids) // 4}I", ids)) for loss, ids in ranks]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD. The first blank goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


def packed(ids: Sequence[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def by_rank(pieces: list[tuple[str, int, float]]) -> list[tuple[str, int, float]]:
    """The pieces with log-probabilities of their ranks where the scores are ranks (whole numbers, no two alike), else as they are.

    Scores that forbid a piece (below -1e8) stay.
    """
    scores = [s for *_, s in pieces if s > -1e8]
    if len(set(scores)) < len(scores) or any(s > 0 or s != int(s) for s in scores):
        return pieces
    rank = {s: k for k, s in enumerate(sorted(scores, reverse=True), 1 + FLAT)}
    total = log(sum(1 / k for k in rank.values())) if rank else 0.0
    return [(p, i, -log(rank[s]) - total if s in rank else s) for p, i, s in pieces]


@lru_cache(2)
def load(path: str, n_best: int = N_BEST) -> Pieces:
    """The piece table of a SentencePiece model file; control and unknown pieces never occur in a segmentation."""
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = {int(m.id_to_piece(i)[3:-1], 16): i for i in range(m.get_piece_size()) if m.is_byte(i)}
    usual = ((m.id_to_piece(i), i, m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)))
    return Pieces(by_rank(list(usual)), spelled, n_best)


RESULT = "doc_id long, ids binary, best_score double, others array<binary>, losses array<double>, round_trip boolean"


def segment_documents(docs: DataFrame, model: str | None = None, n_best: int = N_BEST) -> DataFrame:
    """Per row of `docs` (doc_id, text) the best segmentation's ids and score, the ids of the second to the N-th best and what
    each loses against the best, best first (fewer where a text has fewer), and whether decoding all gives the text back.

    Ids are little-endian unsigned 32-bit numbers in a row; encode_documents() gives arrays. Null text counts as empty,
    which has one empty segmentation. A text that itself has U+2581 decodes to a blank there, so its round trip fails.
    Equal scores keep a fixed order. Rows that repeat are segmented alike. Other columns are not read.
    """
    bounded_batches(docs.sparkSession, 256)
    path = model or public_tokenizers.path(MODEL)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = load(path, n_best)
        columns: list[list] = [[] for _ in range(5)]
        for score, ranks, same in table.ranked(raw.decode("utf-8", "replace") for raw in texts_of(batch.column(1))):
            for column, value in zip(columns, (ranks[0][1], score, [ids for _, ids in ranks[1:]], [loss for loss, _ in ranks[1:]], same), strict=True):
                column.append(value)
        kinds = [pa.binary(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.float64()), pa.bool_()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], [x.split()[0] for x in RESULT.split(", ")])

    return each_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), of, RESULT)


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and the best segmentation's `ids` as an array for each row of `docs` (doc_id, text); rows as in segment_documents()."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = list(texts_of(batch.column(1)))
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))], ["doc_id", "ids"])

    return each_batch(segment_documents(docs, model, 1).select("doc_id", "ids"), of, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str | None = None, column: str = "ids") -> DataFrame:
    """doc_id and text for each row of `encoded` (doc_id, and ids as bytes in `column`): the text that the ids spell.

    Null or empty ids give an empty text; bytes that are no UTF-8 become U+FFFD. An id that the model has no piece for
    raises an error. Other columns are not read.
    """
    bounded_batches(encoded.sparkSession, 256)
    path = model or public_tokenizers.path(MODEL)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = load(path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([table.decode(struct.unpack(f"<{len(x) // 4}I", x)) for x in texts_of(batch.column(1))], pa.string())], ["doc_id", "text"])

    return each_batch(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), column), of, "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is lost by the second and the N-th best segmentation is null where a text has none."""
    second = F.coalesce(F.get("others", F.lit(0)), F.col("ids"))
    count = lambda ids: (F.length(ids) / 4).cast("long")
    return segment_documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id", count("ids").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "best_score", (F.size("others") + 1).alias("n_found"), F.get("losses", F.lit(0)).alias("second_loss"),
        F.get("losses", F.lit(N_BEST - 2)).alias("last_loss"), count(second).alias("second_pieces"), F.crc32(second).alias("second_crc32"), "round_trip")
