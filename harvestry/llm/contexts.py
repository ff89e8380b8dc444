"""Online logistic context mixing of a token's bits over the words before it.

A token is a leaf of a binary tree that halves the training tokens at each node, so its path is its bits. Three predictors
give each bit a probability: the tree itself, the hashed context of the word before, and the hashed context of the two
words before; a context that has seen little leans on the next shorter one. Their stretched probabilities are summed with
weights of a set that is gated by how much the two contexts have seen, and an adaptive table refines the sum.

Tokens are dealt into buckets by the word before them, so all that a context has seen is in one bucket. In a bucket,
contexts come in the order of their hashes: a part is scored with the weights that the parts before it have taught, then
teaches its own training tokens, each down to the first node where its contexts have seen nothing else. A training token is scored without its own share of the counts. A word that stands before
more than BUCKET tokens is split by the word before it; each split is a context of its own, of BUCKET tokens or more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import zstandard

#: Tokens of a bucket on average, of the smallest part that is scored at once, and of the largest table of counts a task holds.
BUCKET, PART, HELD = 1 << 18, 32_000, 3_000_000
#: What a context that has seen nothing counts of the shorter one's probability; levels of what contexts have seen.
LEAN, SEEN, LEVELS = 0.5, 8, 33
#: Distinct tokens in their contexts that teach the weights of a bucket before anything in it is scored.
LESSON = 8_000
INPUTS = 4


@dataclass
class Tree:
    """By level: each leaf's node (-1 below its end) and its bit there; by node: the order-0 probability of a one."""

    node: list[np.ndarray]
    bit: list[np.ndarray]
    one: np.ndarray

    @cached_property
    def order0(self) -> tuple[np.ndarray, np.ndarray]:
        """By node: the order-0 probability of a one, bounded; and stretched."""
        p = bounded(self.one.copy())
        return p, stretch(p)

    @classmethod
    def of(cls, counts: np.ndarray) -> Tree:
        """For leaves with these counts (1 at least), neighbours staying together; a split is as even as it can be."""
        total = np.concatenate([[0.0], np.cumsum(np.maximum(counts, 1))])
        low, high = np.array([0]), np.array([len(counts)])
        node, bit, ones, first = [], [], [], 0
        while True:
            open_ = high - low > 1
            low, high = low[open_], high[open_]
            if not len(low):
                return cls(node, bit, np.concatenate(ones) if ones else np.zeros(0, np.float32))
            middle = np.clip(np.searchsorted(total, (total[low] + total[high]) / 2), low + 1, high - 1)
            ones.append(((total[high] - total[middle]) / (total[high] - total[low])).astype(np.float32))
            at, set_ = np.full(len(counts), -1, np.int32), np.zeros(len(counts), bool)
            sizes = high - low
            inside = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            at[inside] = np.repeat(np.arange(first, first + len(low), dtype=np.int32), sizes)
            set_[inside] = inside >= np.repeat(middle, sizes)
            node.append(at)
            bit.append(set_)
            first += len(low)
            low, high = np.stack([low, middle], 1).ravel(), np.stack([middle, high], 1).ravel()


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 32-bit hash of each number."""
    x = (x.astype(np.uint64) + np.uint64(salt) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32)


def contexts(words: np.ndarray, first: np.ndarray, parts: np.ndarray, begins: int, texts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the hashed context of the word before it, and the word before that, from word numbers and text starts.

    parts[w] is how many contexts the word w < len(parts) is split into, `begins` the same for the start of a text. `texts` are
    the texts' own numbers (ids), 0 where not given: how texts are dealt to batches plays no part.
    """
    start = np.uint32(0xFFFFFFFF)
    one = np.concatenate([[start], words[:-1]]).astype(np.uint32)[: len(words)]
    one[first] = start
    two = np.concatenate([[start], one[:-1]]).astype(np.uint32)[: len(words)]
    two[first] = start
    split = np.ones(len(words), np.int64)
    known = one < len(parts)
    split[known] = parts[one[known]]
    by = mixed(two)
    # All texts begin alike, so there it is a text's number that splits.
    split[first], by[first] = begins, mixed(np.zeros(len(first)) if texts is None else texts)
    short = mixed(one.astype(np.uint64) << np.uint64(24) | (by % split).astype(np.uint64))
    return short, two


def longer(short: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The hashed context of two words."""
    return mixed(short.astype(np.uint64) << np.uint64(32) | two, 7)


def packed(columns: list[np.ndarray], press: zstandard.ZstdCompressor) -> bytes:
    """Columns of 32-bit numbers of one length, compressed byte by byte."""
    return press.compress(np.ascontiguousarray(np.stack(columns).view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1)).tobytes())


def unpacked(data: bytes, columns: int, press: zstandard.ZstdDecompressor) -> np.ndarray:
    flat = np.frombuffer(press.decompress(data), np.uint8).reshape(columns, 4, -1)
    return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(np.uint32)[:, :, 0]


class Mixer:
    """Gated weights, what they have been taught so far, and the refining table."""

    def __init__(self) -> None:
        gates = SEEN * SEEN
        self.weights = np.tile([0.0, 0.3, 0.7, 0.0], (gates, 1))
        self.taught = np.tile(np.eye(INPUTS) * 20, (gates, 1, 1))
        centre = 1 / (1 + np.exp(-(np.arange(LEVELS) / 2 - 8)))
        self.refined = np.stack([1 - centre, centre])[:, None, :] * np.full((2, gates, 1), 20.0)
        self.settle()

    def settle(self) -> None:
        """Single-precision forms of the weights, by input, and of the refining table, by gate and level; nothing is noted."""
        gates = SEEN * SEEN
        self.slope, self.bent, self.places = np.zeros((gates, INPUTS)), np.zeros((gates, INPUTS * (INPUTS + 1) // 2)), np.zeros((2, gates, LEVELS))
        self.ready = np.ascontiguousarray(self.weights.T, np.float32)
        self.table = (self.refined[1] / self.refined.sum(0)).astype(np.float32).ravel()

    def predict(self, gate: np.ndarray, inputs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The refined probability of a one, that of the weights alone, and its place in the refining table."""
        x = self.ready[-1][gate]
        for w, v in zip(self.ready, inputs, strict=False):
            x += w[gate] * v
        p = 1 / (1 + np.exp(-np.clip(x, -15, 15, out=x)))
        at = gate * LEVELS + np.clip(np.rint(x * 2 + 16), 0, LEVELS - 1).astype(np.int64)
        return (p + self.table[at]) / 2, p, at

    def note(self, gate: np.ndarray, inputs: list[np.ndarray], at: np.ndarray, bit: np.ndarray, p: np.ndarray, times: np.ndarray) -> None:
        """Add what rows of a level teach to the sums that the next step is made of; the last input is 1."""
        gates, size = SEEN * SEEN, SEEN * SEEN * LEVELS
        self.places += np.bincount(at + size * (bit > 0), times, minlength=2 * size).reshape(2, gates, LEVELS)
        # By gate, so that each sum is over one piece of an array.
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        gate = gate[order]
        starts = np.flatnonzero(runs([gate]))
        which, slope, bent = gate[starts], [], []
        error, curve, inputs = ((bit - p) * times)[order], (p * (1 - p) * times)[order], [x[order] for x in inputs]
        for i in range(INPUTS):
            slope.append(np.add.reduceat(error * inputs[i] if i < len(inputs) else error, starts))
            own = curve * inputs[i] if i < len(inputs) else curve
            bent += [np.add.reduceat(own * inputs[j] if j < len(inputs) else own, starts) for j in range(i + 1)]
        self.slope[which] += np.stack(slope, 1)
        self.bent[which] += np.stack(bent, 1)

    def teach(self) -> None:
        """A Newton step for each gate by what has been noted."""
        low = np.tril_indices(INPUTS)
        self.taught[:, low[0], low[1]] += self.bent
        self.taught[:, low[1], low[0]] = self.taught[:, low[0], low[1]]
        self.refined += self.places
        self.weights += np.linalg.solve(self.taught, self.slope[:, :, None])[:, :, 0]
        self.settle()


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def bounded(p: np.ndarray) -> np.ndarray:
    """Probabilities that are never quite 0 or 1; no input of the mixer has more to say."""
    return np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6), out=p)


def runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where a run of rows with equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = keys[0][1:] != keys[0][:-1]
        for k in keys[1:]:
            new[1:] |= k[1:] != k[:-1]
    return new


def ordered(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by two columns of unsigned numbers, and where a run of equal rows begins.

    Rows that leave room for their places in 64 bits are sorted together with these, as plain numbers, which takes a third of the time.
    """
    size = len(high).bit_length()
    shift = int(low.max(initial=0)).bit_length()
    key = high.astype(np.uint64) << np.uint64(shift) | low
    if int(high.max(initial=0)).bit_length() + shift + size > 64:
        order = np.argsort(key)
        return order, runs([key[order]])
    key = key << np.uint64(size) | np.arange(len(key), dtype=np.uint64)
    key.sort()
    return (key & np.uint64((1 << size) - 1)).astype(np.int64), runs([key >> np.uint64(size)])


def counted(new: np.ndarray, times: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run its sums, and of each row its run; how many rows a run has."""
    starts = np.flatnonzero(new)
    return np.add.reduceat(times, starts), np.add.reduceat(ones, starts), np.cumsum(new) - 1, np.diff(starts, append=len(new))


def score_part(tree: Tree, mixer: Mixer, columns: list[np.ndarray]) -> np.ndarray:
    """log2 of the probability of each row's leaf, and a lesson; rows are sorted by (short, long, leaf, train), whole contexts of one word."""
    found = score_levels(tree, mixer, *columns)
    mixer.teach()
    return found


def score_levels(tree: Tree, mixer: Mixer, short: np.ndarray, long: np.ndarray, leaf: np.ndarray, train: np.ndarray, times: np.ndarray) -> np.ndarray:
    """score_part() level by level; what the rows teach is noted.

    Rows of one kind, a leaf after one word and whether it is to be learned, differ only in what their two words have seen. A row
    from whose node on that is nothing else goes with its kind: what the kind's path adds from there on is the row's too.
    """
    out = np.zeros(len(leaf))
    own = train.astype(np.float32)
    w = times.astype(np.float32) * own  # counts stay below 2^24, so single precision has them whole
    lean = np.float32(LEAN)
    turn, new = ordered(np.cumsum(runs([short])).astype(np.uint64), leaf.astype(np.uint64) << np.uint64(1) | train.astype(np.uint64))
    kind = np.empty(len(leaf), np.int64)
    kind[turn] = np.cumsum(new) - 1
    at = turn[new]
    leaf1, own1, w1 = leaf[at], own[at], np.add.reduceat(w[turn], np.flatnonzero(new))
    first = np.cumsum(runs([short[at]])) << 32
    sums, which = np.zeros(len(at)), np.arange(len(at))  # what each kind's path has added, and the kinds whose path goes on
    over = np.zeros(len(at), bool)  # kinds whose contexts have seen nothing from some node on
    some, joined = np.zeros(len(at), bool), np.zeros(len(at), np.float32)  # kinds that rows go with, and what these count
    rows, up, second = np.arange(len(leaf)), kind, np.cumsum(runs([short, long])) << 32  # rows that something else has been seen with in their two words' context, their kinds, and that
    unseen = []  # kinds, nodes and bits where contexts have seen nothing
    order0, stretched0 = tree.order0

    def join(stay: np.ndarray) -> None:
        """Rows that don't stay go with their kinds from here on."""
        nonlocal rows, up, second, w, own
        go, stay = np.flatnonzero(~stay), np.flatnonzero(stay)
        if len(go):
            to = up[go]
            out[rows[go]] -= sums[which[to]]
            some[to] = True
            np.add(joined, np.bincount(to, w[go], minlength=len(joined)), out=joined, casting="unsafe")
            rows, up, second, w, own = (x[stay] for x in (rows, up, second, w, own))

    total, _, of, size = counted(runs([second]), w, w)
    join((total[of] > own) | ((total > 0) & (size > 1))[of])
    for node_at, bit_at in zip(tree.node, tree.bit, strict=True):
        node1 = node_at[leaf1]
        open_ = node1 >= 0
        if not open_.all():  # kinds whose path ends here go, and their rows
            if len(rows):
                ends = ~open_[up]
                out[rows[ends]] -= sums[which[up[ends]]]
                left = np.flatnonzero(~ends)
                rows, up, second, w, own = (x[left] for x in (rows, up, second, w, own))
                up = (np.cumsum(open_) - 1)[up]
            left = np.flatnonzero(open_)
            leaf1, node1, own1, w1, first, which, over, some, joined = (x[left] for x in (leaf1, node1, own1, w1, first, which, over, some, joined))
        if not len(leaf1):
            break
        bit1 = bit_at[leaf1]
        if over.any():
            unseen.append((which[over], node1[over], bit1[over]))
        bit1 = bit1.astype(np.float32)
        total, ones, of, _ = counted(runs([first | node1]), w1, w1 * bit1)
        t1 = total[of] - own1
        p1 = bounded((ones[of] - bit1 * own1 + lean * order0[node1]) / (t1 + lean))
        s0, s1, gate1 = stretched0[node1], stretch(p1), level(t1) * SEEN
        with_ = np.flatnonzero(some & ~over)
        gate, bit, n, inputs = gate1[with_], bit1[with_], joined[with_], [s0[with_], s1[with_]]
        inputs.append(inputs[1])
        if len(rows):
            b = bit1[up]
            total, ones, of, size = counted(runs([second | node1[up]]), w, w * b)
            t2 = total[of] - own
            p2 = bounded((ones[of] - b * own + lean * p1[up]) / (t2 + lean))
            stay = (t2 > 0) | ((total > 0) & (size > 1))[of]
            both = lambda x, y: np.concatenate([x, y])
            gate, bit, n = both(gate, gate1[up] + level(t2)), both(bit, b), both(n, w * ~over[up])
            inputs = [both(inputs[0], s0[up]), both(inputs[1], s1[up]), both(inputs[2], stretch(p2))]
        if not len(gate):
            over |= t1 == 0
            continue
        refined, p, at = mixer.predict(gate, inputs)
        found = np.log2(np.abs(refined - (1 - bit)))
        sums[which[with_]] += found[: len(with_)]
        mixer.note(gate, inputs, at, bit, p, n)
        if len(rows):
            out[rows] += found[len(with_) :] * ~over[up]
            join(stay)
        over |= t1 == 0
    out[rows] -= sums[which[up]]
    if unseen:
        which, node, bit = map(np.concatenate, zip(*unseen, strict=True))
        p = mixer.predict(np.zeros(len(node), np.int64), [stretched0[node]] * 3)[0]
        sums += np.bincount(which, np.log2(np.abs(p - (1 - bit.astype(np.float32)))), len(sums))
    out += sums[kind]
    return out


def level(t: np.ndarray) -> np.ndarray:
    """0 for a count of 0, then one more for each doubling: its binary exponent."""
    return np.clip((t.astype(np.float32).view(np.int32) >> 23) - 126, 0, SEEN - 1).astype(np.int64)


def score_rows(tree: Tree, short: np.ndarray, long: np.ndarray, leaf: np.ndarray, train: np.ndarray, times: np.ndarray) -> np.ndarray:
    """log10 of the probability of each distinct row, in the order of all columns, which stands for `times` tokens.

    The first contexts teach the weights once before anything is scored; after that every part teaches once it is scored.
    """
    leaf, train, times = leaf.astype(np.int64), train.astype(np.float64), times.astype(np.float64)
    ends = np.append(np.flatnonzero(short[1:] != short[:-1]) + 1, len(short))
    mixer, found, low = Mixer(), np.zeros(len(short)), 0
    while low < len(short):
        high = int(ends[np.searchsorted(ends, min(low + PART, len(short)))])
        part = [x[low:high] for x in (short, long, leaf, train, times)]
        if not low:
            first = int(ends[np.searchsorted(ends, min(LESSON, len(short)))])
            score_part(tree, mixer, [x[:first] for x in part])
        found[low:high] = score_part(tree, mixer, part)
        low = high
    return found * np.log10(2)


def distinct(columns: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows of some tokens' columns, in order, how many tokens each stands for, and each token's row."""
    short, long, leaf, train = columns
    first, new = ordered(short, long)
    then, new = ordered(np.cumsum(new).astype(np.uint64), (leaf << np.uint32(1) | train)[first])
    order, starts = first[then], np.flatnonzero(new)
    of = np.empty(len(short), np.int64)
    of[order] = np.cumsum(new) - 1
    return np.take(columns, order[starts], axis=1), np.add.reduceat(times[order], starts) if len(starts) else times, of


def score_bucket(tree: Tree, columns: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token of a bucket, from its columns: both contexts, leaf, and 1 for training tokens.

    The order of the tokens plays no part.
    """
    rows, times, of = distinct(columns, np.ones(columns.shape[1], np.int64))
    return score_rows(tree, *rows, times)[of]


def score_slices(tree: Tree, slices_of: Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(texts, log10 of the probability of each token) of each slice (texts, columns) of a bucket too large to be held as tokens.

    The slices' distinct rows are gathered first, so every token is scored from the counts of the whole bucket; what is held is
    the distinct rows and one slice.
    """
    rows, times = None, None
    for _, columns in slices_of():
        some, n, _ = distinct(columns, np.ones(columns.shape[1], np.int64))
        rows, times = (some, n) if rows is None else distinct(np.concatenate([rows, some], axis=1), np.concatenate([times, n]))[:2]
    if rows is None:
        return
    found = score_rows(tree, *rows, times)
    for texts, columns in slices_of():
        # A slice's distinct rows are among the bucket's: side by side with them they fall into the same rows.
        some, _, of = distinct(columns, np.ones(columns.shape[1], np.int64))
        place = distinct(np.concatenate([rows, some], axis=1), np.ones(rows.shape[1] + some.shape[1], np.int64))[2][rows.shape[1] :]
        yield texts, found[place][of]


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of blobs with at most HELD tokens together (or one blob): a larger bucket is read in such slices."""
    low, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > HELD:
            yield low, i
            low, held = i, 0
        held += n
    if low < len(sizes):
        yield low, len(sizes)
