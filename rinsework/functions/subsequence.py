"""Longest common subsequences of many pairs of texts at once, by bit vectors.

A text is a row of 64-bit words, one bit a character; for every character, a mask says where the text holds it. One step
for each character of the other text adds and combines whole words: a bit that is zero at the end is a matched character.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_WORD = 64
#: Words that the masks of one block of pairs may take.
_BLOCK = 4_000_000


class Texts:
    """Texts as code numbers, padded, with their lengths."""

    def __init__(self, texts: Sequence[str]):
        self.lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.alphabet, codes = np.unique(points, return_inverse=True)
        self._codes = codes.astype(np.int32)
        self._starts = np.cumsum(self.lengths) - self.lengths

    def rows(self, which: np.ndarray) -> np.ndarray:
        """The code numbers of some texts, padded with the number of no character."""
        width = int(self.lengths[which].max(initial=0))
        place = np.arange(width)
        inside = place < self.lengths[which][:, None]
        at = np.where(inside, self._starts[which][:, None] + place, 0)
        return np.where(inside, self._codes[at] if len(self._codes) else 0, len(self.alphabet))

    def common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each pair of texts, given by their numbers."""
        out = np.zeros(len(left), dtype=np.int64)
        if not len(left):
            return out
        # the longer text of a pair takes the bits; pairs of like lengths share a block
        swap = self.lengths[left] < self.lengths[right]
        bits, steps = np.where(swap, right, left), np.where(swap, left, right)
        words = -(-self.lengths[bits] // _WORD)
        order = np.lexsort((bits, self.lengths[steps], words))
        at = 0
        while at < len(order):
            width = int(max(words[order[at]], 1))
            # a bound on the masks: as many words as texts times characters times words of a text
            limit = max(1, _BLOCK // (width * min(len(self.alphabet) + 1, 256)))
            end = int(min(at + limit, np.searchsorted(words[order], words[order[at]], side="right")))
            block = order[at:end]
            out[block] = self._block(bits[block], steps[block], width)
            at = end
        return out

    def _block(self, bits: np.ndarray, steps: np.ndarray, width: int) -> np.ndarray:
        own, place = np.unique(bits, return_inverse=True)
        told, step = np.unique(steps, return_inverse=True)
        codes, walked = self.rows(own), self.rows(told)
        # characters that only one side has match nothing
        letters, both = np.unique(codes, return_inverse=True)
        codes = both.reshape(codes.shape)
        found = np.searchsorted(letters, walked)
        found = np.minimum(found, len(letters) - 1)
        nothing = len(letters)
        walked = np.where((letters[found] == walked) & (walked < len(self.alphabet)), found, nothing)
        masks = np.zeros((len(own), nothing + 1, width), dtype=np.uint64)
        rows = np.arange(len(own))
        for k in range(codes.shape[1]):
            masks[rows, codes[:, k], k // _WORD] |= np.where(
                k < self.lengths[own], np.uint64(1) << np.uint64(k % _WORD), np.uint64(0))
        state = np.full((width, len(bits)), ~np.uint64(0))
        for k in range(walked.shape[1]):
            letter = walked[step, k]
            live = letter != nothing
            if not live.any():
                continue
            carry = np.zeros(len(bits), dtype=np.uint64)
            for w in range(width):
                mask = masks[place, letter, w]
                hit = state[w] & mask
                total = state[w] + hit
                over = (total < hit).astype(np.uint64)
                if width > 1:
                    total += carry
                    carry = over | (total < carry).astype(np.uint64)
                state[w] = total | (state[w] & ~mask)
        return np.bitwise_count(~state).sum(axis=0).astype(np.int64)


def common_lengths(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Longest-common-subsequence length of each pair of texts."""
    known = {t: i for i, t in enumerate(dict.fromkeys([*left, *right]))}
    texts = Texts(list(known))
    return texts.common(*(np.array([known[t] for t in side], dtype=np.int64) for side in (left, right)))
