"""Language-model scores of whole texts by logistic context mixing.

A text is its tokens (words, A-Z lower-cased, then one end, the empty token). The corpus gives exact counts of all
training tokens, and of what follows each word and each two words (module `contexts`): there the bits of every token of
the running text are predicted by hashed contexts, mixed by gated weights and refined, each training token without its
own share of the counts. The `FREQUENT` most frequent tokens are leaves of the tree that gives a token its bits; one more
leaf stands for all others.

Such another token is told apart by its spelling, its bytes and a closing blank, again bit by bit: predictors of several
orders look their context's hash up in tables of bit counts over all distinct training tokens, and are mixed and refined
in the same way. Its probability within that leaf is (c - D + D V s) / R if it is seen c times, D V s / R if not; s is its
spelling's probability, R and V are all such tokens and the distinct ones. All tokens' probabilities sum to 1.

Two totals come from it. `spelled_score` and bits_per_byte are of the text letter by letter. `score` is over the tokens of
the base score, the training tokens and one class of all others: that class has what is left of 1.

All of it learns from every training token. A byte's spelling hangs on the four bytes before it in its token alone, so the
distinct training tokens are counted as grams (those four and the byte): bit counts are sums over grams, and the mixing weights
and the refining table of spellings are fitted in `PASSES` Newton steps, each a sum over all grams, where a byte's bits are taken
off the counts before they are predicted.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm.common import bounded_batches, fold_id, give_back, keep, read_table, segments, texts_of, words_of
from harvestry.llm.contexts import BUCKET, Tree, contexts, longer, ordered, packed, score_bucket, score_slices, slices, unpacked
from harvestry.sources.tables import discard

FOLDS, HELD_OUT, DISCOUNT = 7, 2, 0.75
ORDERS, BITS, BLOCK = (1, 2, 4), 20, 14
FREQUENT, PASSES = 200_000, 3
#: Grams that a task counts the bits of, on average; tasks at most.
GRAMS, TASKS = 250_000, 256
#: Bytes of tokens that are taken apart at once.
BYTES = 1 << 20
GATES, LEVELS = 64, 33
#: Tokens that a task holds before it deals them out to their buckets.
CHUNK, LN10 = 1 << 20, float(np.log(10))
#: Rows of texts that are dealt or counted at once, fewer where they have so many bytes.
DEAL, COUNT = (1024, 3 << 20), (8192, 12 << 20)
#: Bits of a text's place in its part; above them is the part.
PLACE = 32
#: Texts whose sums a task holds, over all its buckets, before they go out.
SUMS = 2_000_000


def grams_of(tokens: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In parts of about BYTES: each token's first byte's place, and of all bytes, closing blanks too, the gram: up to four bytes before it in the token (0 where there is none) and itself."""
    at = 0
    while at < len(tokens):
        size, stop = 0, at
        while stop < len(tokens) and size < BYTES:
            size += len(tokens[stop]) + 1
            stop += 1
        lengths = np.fromiter((len(t) + 1 for t in tokens[at:stop]), np.int64, stop - at)
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b" ".join(tokens[at:stop]) + b" ", np.uint8).astype(np.uint64)
        inside = np.arange(len(data)) - np.repeat(starts, lengths)
        grams = data.copy()
        for back in range(1, max(ORDERS) + 1):
            before = np.zeros(len(data), np.uint64)
            before[back:] = data[:-back]
            before[inside < back] = 0
            grams |= before << np.uint64(8 * back)
        yield starts, grams
        at = stop


def split_grams(grams: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each gram's byte, and a context hash per order."""
    contexts, h = [], np.zeros(len(grams), np.uint32)
    for back in range(1, max(ORDERS) + 1):
        h = h * np.uint32(0x2F0B4C47) + (grams >> np.uint64(8 * back) & np.uint64(255)).astype(np.uint32) + np.uint32(1)
        if back in ORDERS:
            contexts.append(h * np.uint32(0x9E3779B1) + np.uint32(back))
    return (grams & np.uint64(255)).astype(np.uint8), contexts


def spelled(tokens: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """In parts: each token's first byte's place, all bytes, and a context hash per order and byte."""
    for starts, grams in grams_of(tokens):
        yield starts, *split_grams(grams)


def counted(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of all tokens and how often each comes."""
    parts = [np.unique(grams, return_counts=True) for _, grams in grams_of(tokens)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    x = (context ^ node * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
    return (x ^ x >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)


def bits_of(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight bits from the highest: the bits before it in the byte with a leading one, and the bit."""
    wide = data.astype(np.uint32)
    for b in range(8):
        yield np.uint32(1) << np.uint32(b) | wide >> np.uint32(8 - b), wide >> np.uint32(7 - b) & np.uint32(1)


def bit_counts(tokens: list[bytes], table: np.ndarray) -> None:
    """Add the tokens' bits to table[order, bit, slot]."""
    add_bits(*counted(tokens), table)


def add_bits(grams: np.ndarray, n: np.ndarray, table: np.ndarray) -> None:
    """Add the bits of grams that come n times each to table[order, bit, slot]."""
    data, contexts = split_grams(grams)
    for node, bit in bits_of(data):
        for k, context in enumerate(contexts):
            np.add.at(table[k].reshape(-1), slots(context, node) | bit << np.uint32(BITS), n.astype(table.dtype))


def seen(n: np.ndarray) -> np.ndarray:
    """0 to 7 by the logarithm of a count."""
    return np.minimum(np.log2(n + 1), 7).astype(np.int64)


@dataclass
class Mixer:
    stretch: np.ndarray
    known: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    @staticmethod
    def level(x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((x + 8) * 2), 0, LEVELS - 1).astype(np.int64)

    def log10(self, tokens: list[bytes]) -> np.ndarray:
        """Of each token's spelling."""
        out = []
        for starts, grams in grams_of(tokens):
            own, at = np.unique(grams, return_inverse=True)
            out.append(np.add.reduceat(self.of_grams(own)[at], starts))
        return np.concatenate(out) if out else np.zeros(0)

    def of_grams(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's byte after the four before it."""
        data, contexts = split_grams(grams)
        total = np.zeros(len(data))
        for b, (node, bit) in enumerate(bits_of(data)):
            at = [slots(c, node) for c in contexts]
            gate = self.known[-1][at[-1]].astype(np.int64) * 8 + self.known[-3][at[-3]]
            x = self.weights[gate, -1].copy()
            for k, s in enumerate(at):
                x += self.weights[gate, k] * self.stretch[k][s]
            p = (1 / (1 + np.exp(-np.clip(x, -20, 20))) + self.refined[b, gate // 8, self.level(x)]) / 2
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return total


WIDTH = len(ORDERS) + 1
#: Of each gate the slope and the curve of its weights, then how often each level of the refining table has a zero and a one.
LESSON = GATES * WIDTH * (1 + WIDTH), 2 * 8 * 8 * LEVELS


def lesson(table: np.ndarray, weights: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What grams that come n times each teach, as sums; each byte's own bits are taken off the counts."""
    slope, curve, refined = np.zeros((GATES, WIDTH)), np.zeros((GATES, WIDTH, WIDTH)), np.zeros((2, 8, 8 * LEVELS))
    data, contexts = split_grams(grams)
    for b, (node, bit) in enumerate(bits_of(data)):
        inputs, known = [], []
        for j, context in enumerate(contexts):
            s = slots(context, node)
            one = np.maximum(table[j, 1, s].astype(float) - bit, 0)
            zero = np.maximum(table[j, 0, s].astype(float) - (1 - bit.astype(float)), 0)
            inputs.append(np.log((one + 0.4) / (zero + 0.4)))
            known.append(seen(one + zero))
        gate = known[-1] * 8 + known[-3]
        inputs.append(np.ones(len(gate)))
        x = sum(weights[gate, j] * v for j, v in enumerate(inputs))
        p = 1 / (1 + np.exp(-np.clip(x, -20, 20)))
        for i, v in enumerate(inputs):
            slope[:, i] += np.bincount(gate, (bit - p) * n * v, minlength=GATES)
            for j, w in enumerate(inputs):
                curve[:, i, j] += np.bincount(gate, p * (1 - p) * n * v * w, minlength=GATES)
        at = (gate // 8) * LEVELS + Mixer.level(x)
        for v in (0, 1):
            refined[v, b] += np.bincount(at, n * (bit == v), minlength=8 * LEVELS)
    return np.concatenate([slope.ravel(), curve.ravel(), refined.ravel()])


def fitted(table: np.ndarray, sums: Callable[[np.ndarray], np.ndarray]) -> Mixer:
    """Weights by Newton steps, then the refining table under them; sums(weights) is lesson() over all grams."""
    weights = np.zeros((GATES, WIDTH))
    weights[:, :-1] = 0.3
    for _ in range(PASSES):
        slope, curve = np.split(sums(weights)[: LESSON[0]], [GATES * WIDTH])
        step = np.linalg.solve(curve.reshape(GATES, WIDTH, WIDTH) + np.eye(WIDTH) * 20, slope.reshape(GATES, WIDTH, 1))[:, :, 0]
        # Far from its end a step may go too far; the weights of a gate move by 1 at most.
        weights += step / np.maximum(1, np.abs(step).max(1, keepdims=True))
    refined = sums(weights)[LESSON[0] :].reshape(2, 8, 8, LEVELS)
    centre = 1 / (1 + np.exp(-(np.arange(LEVELS) / 2 - 8)))
    refined += np.stack([(1 - centre) * 4, centre * 4])[:, None, None]
    stretch = np.log((table[:, 1] + np.float32(0.4)) / (table[:, 0] + np.float32(0.4))).astype(np.float32)
    return Mixer(stretch, np.minimum(np.log2(table.sum(1) + 1.0), 7).astype(np.uint8), weights, np.clip(refined[1] / refined.sum(0), 1e-6, 1 - 1e-6))


def learn(table: np.ndarray, tokens: list[bytes]) -> Mixer:
    """A mixer of spellings from a few tokens, as learn_all() gives it from a table of grams."""
    grams, n = counted(tokens)
    return fitted(table, lambda weights: lesson(table, weights, grams, n))


def learn_all(grams: DataFrame, table: np.ndarray) -> Mixer:
    """A mixer of spellings from all grams (gram, n); each pass sums them up in the tasks, whose sums have a fixed size."""
    shared = grams.sparkSession.sparkContext.broadcast(table)

    def sums(weights: np.ndarray) -> np.ndarray:
        def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum(LESSON))
            for some in gathered(batches):
                total += lesson(shared.value, weights, some.column(0).to_numpy().view(np.uint64), some.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["sums"])

        parts = sorted(texts_of(grams.mapInArrow(over, "sums binary").toArrow().column(0).combine_chunks()))
        return np.sum([np.frombuffer(x, "<f8") for x in parts], axis=0) if parts else np.zeros(sum(LESSON))

    mixer = fitted(table, sums)
    shared.unpersist()
    return mixer


def gathered(batches: Iterable[pa.RecordBatch], rows: int = 1 << 16, most: float = np.inf) -> Iterator[pa.RecordBatch]:
    """The batches put together to about `rows` rows each, fewer where they reach `most` bytes."""
    held, size, bytes_ = [], 0, 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        bytes_ += batch.nbytes
        if size >= rows or bytes_ >= most:
            yield pa.concat_batches(held)
            held, size, bytes_ = [], 0, 0
    if size:
        yield pa.concat_batches(held)


def sums_of(text: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of `text`, in order, and the sums of `found` over each."""
    order, new = ordered(text >> PLACE, (text & (1 << PLACE) - 1).astype(np.uint32))
    starts = np.flatnonzero(new)
    return text[order[starts]], np.add.reduceat(found[order], starts) if len(starts) else found


def token_counts(docs: DataFrame) -> DataFrame:
    """token (binary) and n, its occurrences in rows with `train`; the empty token counts texts. Tokens of other rows have 0."""
    bounded_batches(docs.sparkSession)
    OUT = pa.schema([("token", pa.binary()), ("n", pa.int64())])  # noqa: N806

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, *COUNT):
            words, of_word, _ = words_of(batch.column(0))
            train = np.array([bool(x) for x in batch.column(1).to_pylist()], bool)
            seen, n = pc.value_counts(words.filter(pa.array(train[of_word]))).flatten()
            others = pc.unique(words.filter(pa.array(~train[of_word])))
            zeros, ends = pa.array(np.zeros(len(others), np.int64)), pa.array([b""], pa.large_binary())
            yield from pa.table({"token": pa.chunked_array([seen, others, ends]), "n": pa.chunked_array([n, zeros, pa.array([int(train.sum())])])}).cast(OUT).to_batches(max_chunksize=1 << 16)

    return docs.select("text", "train").mapInArrow(over, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def gram_counts(types: DataFrame) -> DataFrame:
    """gram (long) and n, how often it comes in the distinct tokens of `types` (token)."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in gathered(batches):
            grams, n = counted(some.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], ["gram", "n"])

    return types.mapInArrow(over, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def bit_table(grams: DataFrame, n: int) -> np.ndarray:
    """Bit counts over `n` grams (gram, n): counted by at most TASKS tasks, summed block by block; the table's size is fixed."""
    spark = grams.sparkSession
    shape = (len(ORDERS), 2, 1 << BITS)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(shape, np.uint32)
        for some in gathered(batches):
            add_bits(some.column(0).to_numpy().view(np.uint64), some.column(1).to_numpy(), table)
        flat, press = table.reshape(-1, 1 << BLOCK), zstandard.ZstdCompressor(level=1)
        full = np.flatnonzero(flat.any(1))
        for at in range(0, len(full), 64):
            some = full[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([press.compress(flat[i].tobytes()) for i in some], pa.binary())], ["block", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, unpress = np.zeros(1 << BLOCK, np.uint64), zstandard.ZstdDecompressor()
        for batch in batches:
            for x in texts_of(batch.column(1)):
                total += np.frombuffer(unpress.decompress(x), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], ["block", "counts"])

    parts = grams.coalesce(min(TASKS, max(6, -(-n // GRAMS)))).mapInArrow(count, "block int, counts binary")
    sums = parts.groupBy("block").applyInArrow(add, "block int, counts binary").toArrow()
    table = np.zeros(shape, np.uint32)
    flat = table.reshape(-1, 1 << BLOCK)
    for block, counts in zip(sums.column(0).to_pylist(), texts_of(sums.column(1).combine_chunks()), strict=True):
        flat[block] = np.frombuffer(counts, np.uint32)
    return table


def score_documents(docs: DataFrame, frequent: int = FREQUENT, sample: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, spelled_score, bits_per_byte for each row of `docs` (doc_id, text, train).

    Null text counts as empty: its one token is the end. Rows without `train` true add nothing to the model. Rows that
    repeat a doc_id, or have none, are scored as rows of their own. Without training rows N and V are 0, the base score's
    terms are log10(1), and the score is that of one class for every token. Other columns are not read. `sample` plays no
    part any more: spellings are learned from all distinct tokens.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tokens = keep(token_counts(docs), "tokens")
    n, v = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    types = tokens.where("n > 0")
    grams = keep(gram_counts(types.select("token")), "grams")
    table = bit_table(grams, grams.count())
    mixer = spark.sparkContext.broadcast(learn_all(grams, table))
    del table
    give_back()

    top = types.orderBy(F.desc("n"), "token").limit(frequent).toArrow().sort_by("token")
    names, counts = list(texts_of(top.column("token").combine_chunks())), top.column("n").to_numpy().astype(float)
    rest, kinds = n - int(counts.sum()), v - len(names)
    tree = Tree.of(np.append(counts, max(rest, 1)))
    parts = np.maximum(1, np.ceil(counts / BUCKET)).astype(np.int64)
    buckets, begins = max(1, -(-n // BUCKET)), max(1, -(-int(counts[names.index(b"")] if b"" in names else 0) // BUCKET))
    common = spark.sparkContext.broadcast((dict(zip(names, range(len(names)), strict=True)), np.append(np.log10((counts + 1) / (n + 1 * (v + 1))), 0.0), parts))
    left = DISCOUNT * kinds if rest else 1.0  # the discounted mass, of `rest`, that spellings share out
    taken = np.logaddexp.reduce(mixer.value.log10(names) * LN10) if names else -np.inf
    free = float(np.log1p(-min(np.exp(taken), 1 - 1e-9)))  # of all spellings those that are not frequent tokens'

    def price(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_words = pa.array(common.value[0], pa.binary())
        for batch in gathered(batches):
            batch = batch.filter(pc.invert(pc.is_in(batch.column("token"), value_set=frequent_words)))
            if not batch.num_rows:
                continue
            c = batch.column("n").to_numpy().astype(float)
            own = mixer.value.log10(batch.column("token").to_pylist()) * LN10 - free
            spelled = np.log(left) + own
            known = c > DISCOUNT
            spelled[known] = np.logaddexp(spelled[known], np.log(c[known] - DISCOUNT))
            base = np.log10((c + 1) / (n + 1 * (v + 1)))
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("n"), pa.array(base), pa.array((spelled - np.log(max(rest, 1))) / LN10), pa.array(np.exp(own), pa.float32())], ["token", "n", "base", "spelled", "own"])

    priced = keep(tokens.mapInArrow(price, "token binary, n long, base double, spelled double, own float"), "priced")
    gone = priced.where("n > 0").agg(F.coalesce(F.sum("own"), F.lit(0.0))).first()[0]
    discard(tokens, grams)
    other = float(np.log10(left * max(1 - gone, 1e-12) / max(rest, 1)))
    priced = priced.withColumn("score", F.when(F.col("n") > 0, F.col("spelled")).otherwise(other)).drop("own")

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens in their contexts, packed by bucket; per text a row of its own, and one for each token that is not frequent."""
        ids, base, split = common.value
        known_words, press = pa.array(ids, pa.large_binary()), zstandard.ZstdCompressor(level=1)
        part, row = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            data = np.concatenate(held, axis=1)
            data = np.take(data, np.argsort(data[0].astype(np.uint64) << np.uint64(32) | data[1]), axis=1)
            to = (data[0].astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # rises with the context's hash
            starts = np.append(0, np.flatnonzero(np.diff(to)) + 1)
            ends = np.append(starts[1:], len(to))
            blobs = [packed(list(data[:, x:y]), press) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
            return rows_of(bucket=to[starts], part=np.full(len(ends), part), size=ends - starts, data=pa.array(blobs, pa.binary()))

        for batch in gathered(batches, *DEAL):
            words, of_word, counts = words_of(batch.column(1))
            n_words = counts + 1
            sizes = np.bincount(of_word, pc.binary_length(words).to_numpy(), minlength=len(counts)).astype(np.int64) + n_words
            # The distinct words, then the end, with their numbers; those that are not frequent get one by their hash.
            coded = words.dictionary_encode()
            names, end = pc.fill_null(pc.index_in(coded.dictionary, value_set=known_words), -1).to_numpy(), len(coded.dictionary)
            number = np.append(names, ids.get(b"", -1)).astype(np.int64)
            strange = np.flatnonzero(number < 0)
            spelled = [*coded.dictionary.take(pa.array(strange[strange < end])).to_pylist(), b""][: len(strange)]
            number[strange] = 1 << 31 | np.fromiter(map(zlib.crc32, spelled), np.int64, len(strange)) >> 1
            kind = np.full(len(words) + len(counts), end, np.int64)  # each text's end, where no word is put
            kind[np.arange(len(words)) + of_word] = coded.indices.to_numpy()
            text_of = np.repeat(np.arange(len(n_words)), n_words)
            word = number[kind].astype(np.uint32)
            missed = np.flatnonzero(word >= 1 << 31)
            pairs, times = np.unique(text_of[missed] * (end + 1) + kind[missed], return_counts=True)
            leaf = np.minimum(word, np.uint32(len(ids)))
            short, two = contexts(word, np.cumsum(n_words) - n_words, split, begins, batch.column(0).fill_null(0).to_numpy())
            train = np.array([bool(x) for x in batch.column(2).to_pylist()], np.uint32)
            held.append(np.stack([short, two, leaf << np.uint32(1) | train[text_of], (row + text_of).astype(np.uint32)]))
            size += len(word)
            known = np.bincount(text_of, leaf < len(ids), minlength=len(n_words)).astype(np.int64)
            of = (part << PLACE) + row + np.arange(len(n_words))
            yield rows_of(part=np.full(len(of), part), row=of, doc_id=batch.column(0), n_tokens=n_words, n_known=known, base_score=np.bincount(text_of, base[leaf], minlength=len(n_words)), n_bytes=np.array(sizes))
            if len(pairs):
                columns = [(row + pairs // (end + 1)).astype(np.uint32), times.astype(np.uint32)]
                said = b" ".join(map(spelled.__getitem__, np.searchsorted(strange, pairs % (end + 1)).tolist()))
                yield rows_of(part=[part], size=[len(pairs)], data=pa.array([packed(columns, press)], pa.binary()), token=pa.array([press.compress(said)], pa.binary()))
            row += len(n_words)
            if size >= CHUNK:
                yield out()
                held, size = [], 0
                give_back(False)
        if size:
            yield out()

    def mix(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of texts as they are; tokens that are not frequent, unpacked; of each bucket, the sum of its tokens' scores by text."""
        press = zstandard.ZstdDecompressor()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        since = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            return sums_of(*map(np.concatenate, zip(*held, strict=True)))

        for some in segments(batches, ["bucket"]):
            from_, sizes, blobs = some.column("part").to_numpy(), some.column("size").fill_null(0).to_numpy(), some.column("data")
            if some.column("bucket")[0].as_py() < 0:
                yield from some.filter(pc.is_null(blobs)).to_batches()
                for part, data, names in zip(from_.tolist(), texts_of(blobs.combine_chunks()), texts_of(some.column("token").combine_chunks()), strict=True):
                    if data:
                        of, times = unpacked(data, 2, press).astype(np.int64)
                        yield rows_of(row=(part << PLACE) + of, size=times, token=pa.array(press.decompress(names).split(b" "), pa.binary()))
                continue
            def tokens(some: tuple, from_=from_, sizes=sizes, blobs=blobs) -> tuple[np.ndarray, np.ndarray]:
                low, high = some
                data = np.concatenate([unpacked(blobs[i].as_py(), 4, press) for i in range(low, high)], axis=1)
                text = (np.repeat(from_[low:high], sizes[low:high]) << PLACE) + data[3].astype(np.int64)
                return text, np.stack([data[0], longer(data[0], data[1]), data[2] >> np.uint32(1), data[2] & np.uint32(1)])

            cut = list(slices(sizes))
            if len(cut) == 1:
                text, columns = tokens(cut[0])
                scored = iter([(text, score_bucket(shared.value, columns))])
            else:
                scored = score_slices(shared.value, lambda cut=cut, tokens=tokens: map(tokens, cut))
            for text, found in scored:
                held.append(sums_of(text, found))
                if sum(len(x) for x, _ in held) > SUMS:
                    held = [summed()]
                    if len(held[0][0]) > SUMS // 2:
                        of, sums = held.pop()
                        yield rows_of(row=of, score=sums)
                since += len(text)
                if since > CHUNK:
                    del text, found
                    give_back(False)
                    since = 0
        if held:
            of, sums = summed()
            yield rows_of(row=of, score=sums)

    shared = spark.sparkContext.broadcast(tree)
    spread = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("part", "row", "data"), F.lit(buckets)))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "train").mapInArrow(deal, ROWS).withColumn("bucket", spread)
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket", "part")
    sums = keep(dealt.mapInArrow(mix, ROWS), "sums").drop("bucket", "part", "data")
    rare_sums = sums.where("token is not null").select("row", "token", "size").join(priced, "token").select(
        "row", F.when(F.col("n") > 0, F.col("size")).otherwise(0).alias("n_known"), (F.col("base") * F.col("size")).alias("base_score"), (F.col("score") * F.col("size")).alias("score"), (F.col("spelled") * F.col("size")).alias("spelled_score"))
    all_ = sums.where("token is null").select("row", "doc_id", "n_tokens", "n_known", "base_score", F.col("score").cast("double").alias("score"), F.col("score").cast("double").alias("spelled_score"), "n_bytes").unionByName(rare_sums, allowMissingColumns=True)
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    whole = all_.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("n_bytes").alias("n_bytes"), *map(total, ("n_known", "base_score", "score", "spelled_score")))
    return whole.select("doc_id", "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "spelled_score", (-F.col("spelled_score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))


#: What the first pass over the texts hands on; a row has a bucket's packed tokens, a text's sums, a rare token, or a score.
COLUMNS = {"bucket": pa.int64(), "part": pa.int64(), "size": pa.int64(), "data": pa.binary(), "row": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "n_bytes": pa.int64(), "token": pa.binary(), "score": pa.float64()}
ROWS = ", ".join(f"{name} {({pa.int64(): 'long', pa.float64(): 'double'}).get(kind, 'binary')}" for name, kind in COLUMNS.items())


def rows_of(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """A batch of ROWS; columns that are not given are null."""
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) if name in columns and not isinstance(columns[name], pa.Array) else columns.get(name, pa.nulls(size, kind)) for name, kind in COLUMNS.items()], list(COLUMNS))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(fold_id("doc_id", FOLDS) != HELD_OUT, F.lit(False)).alias("train"))
    return score_documents(docs).withColumn("held_out", fold_id("doc_id", FOLDS) == HELD_OUT)
