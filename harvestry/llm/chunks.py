"""Cutting texts where no token of two tokenizers can cross, and encoding what lies between.

The byte-level tokenizer splits a text by a pattern before it merges; the piece tokenizer merges only what stands next to each
other inside some piece. Where a word ends before a blank, a line break or a mark, both start anew, whatever stands around.
So a text's tokens are its chunks' tokens, one after the other, and a chunk that comes again need not be encoded again.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import sentencepiece
import tokenizers

BLANK = "▁"
#: A line break: in no piece, so what follows it is encoded by itself.
GUARD = "\n"
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True
#: ASCII white space, and the separators that some patterns count among it.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
MARKS = np.zeros(256, bool)
MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
#: First bytes of characters that may be white space beyond ASCII.
WIDE_SPACES = (0xC2, 0xE1, 0xE2, 0xE3)


class Both:
    """Both tokenizers, the length of each token in bytes, and the pairs of ASCII characters that stand together in a piece."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        self.a = tokenizers.Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = {c: b for b, c in byte_letters().items()}
        self.a_bytes = [bytes(letters.get(c, 0) for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int32) for side in (self.a_bytes, self.b_bytes))
        self.lead = self.b.encode(GUARD)
        self.together = np.zeros((128, 128), bool)
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i):
                continue
            assert GUARD not in piece, "no guard character for this piece table"
            assert BLANK not in piece.lstrip(BLANK), "a piece crosses a blank of this piece table"
            for x, y in zip(piece, piece[1:], strict=False):
                if x.isascii() and y.isascii():
                    self.together[ord(x), ord(y)] = True

    def encode(self, chunks: list[bytes]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of each chunk by both tokenizers, and whether each gives the chunk's bytes back."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        k = len(self.lead)
        b = [x[k:] for x in self.b.encode([GUARD + t for t in texts], num_threads=1)]
        same = b"".join(chunks)
        if all(b"".join([raw[i] for x in ids for i in x]) == same for ids, raw in ((a, self.a_bytes), (b, self.b_bytes))) and self.fits(a, b, chunks):
            return a, b, [True] * len(chunks)
        whole = [b"".join([self.a_bytes[i] for i in x]) == c == b"".join([self.b_bytes[i] for i in y]) for x, y, c in zip(a, b, chunks, strict=True)]
        return a, b, whole


    def fits(self, a: list[list[int]], b: list[list[int]], chunks: list[bytes]) -> bool:
        """Whether the tokens of each chunk are as long as it; with equal bytes in all, each chunk's bytes are then its own."""
        length = np.array([len(c) for c in chunks])
        for ids, own in ((a, self.a_length), (b, self.b_length)):
            n = np.array([len(x) for x in ids])
            sums = np.concatenate([[0], np.cumsum(own[np.fromiter(chain.from_iterable(ids), np.int64)])])
            end = np.cumsum(n)
            if (sums[end] - sums[end - n] != length).any():
                return False
        return True


@lru_cache(1)
def both(byte_level: str, pieces: str) -> Both:
    return Both(byte_level, pieces)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[1:-1], 16)]) if is_byte else piece.replace(BLANK, " ").encode("utf-8", "surrogatepass")


def cuts(data: np.ndarray, together: np.ndarray) -> np.ndarray:
    """Where chunks begin in `data` (UTF-8 bytes), beside its start: for each place, whether one does.

    A cut stands after a character that is not white space, before a blank or a line break; after a single line break before
    something else; and between an ASCII letter and a mark that no piece has together.
    """
    out = np.zeros(len(data), bool)
    if len(data) < 3:
        return out
    solid = ~SPACES[data]
    # Characters that may be wide white space end nothing: their last byte doesn't count as solid.
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        wide = np.isin(data, WIDE_SPACES)
        for k in (1, 2):
            at = high[high >= k]
            solid[at[wide[at - k]]] = False
    before, now = solid[:-1], data[1:]
    out[1:] = before & ((now == 32) | (now == 10))
    starts = solid[2:] & ~np.isin(data[2:], WIDE_SPACES)
    out[2:] |= starts & (data[1:-1] == 10) & solid[:-2]
    out[1:] |= LETTERS[data[:-1]] & MARKS[now] & ~together[data[:-1] & 127, now & 127]
    return out
