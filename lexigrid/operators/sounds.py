"""The three likenesses of words by sound, for many pairs of a task's words at once: what `functions/phonetic.py` says of one pair.

Scale: a task holds the numbers of its words, and those of AT_ONCE pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexigrid.functions import phonetic
from lexigrid.operators import edits

#: What is returned for each pair.
PAIRS = "a string, b string, by_phonemes double, by_vectors double, by_characters double"
#: Pairs that are scored at once.
AT_ONCE = 1 << 15


def _padded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of lists' texts, equal ones for equal texts, padded with zeros; and how many they are."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), int(sizes.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False) + 1
    return (out.astype(np.uint8) if out.max(initial=0) < 256 else out), sizes


def _wide(codes: np.ndarray, size: int) -> np.ndarray:
    """Just so many columns."""
    return np.pad(codes[:, :size], ((0, 0), (0, max(size - codes.shape[1], 0))))


def _last(codes: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """The last n numbers of each row, from the end; zeros for none."""
    at = sizes[:, None] - 1 - np.arange(n)
    if not codes.shape[1]:
        return np.zeros((len(codes), n), codes.dtype)
    return np.where(at >= 0, np.take_along_axis(codes, np.maximum(at, 0), axis=1), 0)


def _same(codes: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
    return (codes[l] == codes[r]).sum(axis=1)


class Sounds:
    """Words with their phonemes, as a list and joined, stress, numbers of syllables and IPA."""

    def __init__(self, phonemes: pa.ListArray, joined: list[str], stress: list[str], syllables: np.ndarray, ipa: list[str]):
        self.phonemes, self.sizes = _padded(phonemes)
        self.ends, self.first = _last(self.phonemes, self.sizes, phonetic.RHYME_LENGTH), _wide(self.phonemes, phonetic.FIXED_LENGTH)
        self.sound_sizes = np.array([len(s) for s in joined], np.int64)
        self.ipa, self.ipa_sizes = edits.small_codes(ipa)
        self.ipa_ends = _last(self.ipa, self.ipa_sizes, 3)
        self.syllables = syllables.astype(np.float64)
        signs, self.stress_sizes = edits._codes(stress)
        self.stress = np.where(signs == 0, ord("0"), signs)
        self.digits, self.digit_sizes = edits._codes([re.sub("[^012]", "", s) for s in stress])
        vectors = _wide(signs, phonetic.FIXED_LENGTH)
        self.vectors = np.where(vectors == ord("1"), 1.0, np.where(vectors == ord("2"), 0.5, 0.0))
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))

    def agree(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
        """Whether the last phonemes are equal, from the end; not where one has none."""
        return (self.ends[l] == self.ends[r]) & (self.ends[l] > 0)

    def _syllabic(self, l: np.ndarray, r: np.ndarray, none: float) -> np.ndarray:  # noqa: E741
        a, b = self.syllables[l], self.syllables[r]
        most = np.maximum(a, b)
        return np.where(most == 0, none, 1.0 - np.abs(a - b) / np.where(most == 0, 1, most))

    def by_phonemes(self, l: np.ndarray, r: np.ndarray, needed: np.ndarray) -> np.ndarray:  # noqa: E741
        """needed: the edits of the joined phonemes."""
        least = np.minimum(np.minimum(self.sizes[l], self.sizes[r]), phonetic.RHYME_LENGTH)
        longer = np.maximum(self.sound_sizes[l], self.sound_sizes[r])
        far = np.where(least == 0, 1.0, needed / np.maximum(longer, 1))
        size = np.maximum(self.stress_sizes[l], self.stress_sizes[r])
        places = _same(self.stress, l, r) - (self.stress.shape[1] - size)
        stressed = np.where((self.stress_sizes[l] == 0) | (self.stress_sizes[r] == 0), 0.0, places / np.maximum(size, 1))
        return phonetic.overall(far, stressed, np.where(least == 0, 0.0, self.agree(l, r).sum(axis=1) / np.maximum(least, 1)), self._syllabic(l, r, 1.0))

    def by_vectors(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
        same = _same(self.first, l, r) / phonetic.FIXED_LENGTH
        norms = self.norms[l] * self.norms[r]
        stressed = np.where(norms > 0, np.einsum("ij,ij->i", self.vectors[l], self.vectors[r]) / np.where(norms > 0, norms, 1), 0.0) if norms.any() else np.zeros(len(l))
        return phonetic.overall(1 - same, stressed, _same(self.ends, l, r) / phonetic.RHYME_LENGTH, self._syllabic(l, r, 1.0))

    def by_characters(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
        m, n = self.ipa_sizes[l], self.ipa_sizes[r]
        none = (m == 0) | (n == 0)
        far = np.where(none, 1.0, edits.full(self.ipa, self.ipa_sizes, l, r) / np.maximum(np.maximum(m, n), 1))
        p, q = self.digit_sizes[l], self.digit_sizes[r]
        places = _same(self.digits, l, r) - (self.digits.shape[1] - np.maximum(p, q))
        stressed = np.where(np.minimum(p, q) == 0, 0.0, places / np.maximum(np.maximum(p, q), 1))
        alike = ((self.ipa_ends[l] == self.ipa_ends[r]) & (self.ipa_ends[l] > 0)).sum(axis=1)
        rhymed = np.where(none, 0.0, alike / np.maximum(np.maximum(np.minimum(m, 3), np.minimum(n, 3)), 1))
        some = (self.syllables[l] > 0) & (self.syllables[r] > 0)
        return phonetic.overall(far, stressed, rhymed, np.where(some, self._syllabic(l, r, 0.0), 0.0))


def told(threshold: float, groups: list[tuple[int, ...]]) -> Callable:
    """What is said of the close pairs of a task's words: PAIRS of those that reach the threshold by phonemes, once each.

    A pair meets under each group of places from the end, counted from one, at which its phonemes agree; it is returned under the first of these.
    Rows have `at`, the place of their group, and `few`: whether one of a pair has to have fewer than three phonemes.
    """

    def said(rows: pa.Table) -> Callable[[np.ndarray, np.ndarray], list[pa.Array]]:
        column = lambda n: c.combine_chunks() if isinstance(c := rows[n], pa.ChunkedArray) else c
        own = Sounds(column("phonemes"), rows["text"].to_pylist(), rows["stress"].to_pylist(), rows["syllables"].to_numpy(), rows["ipa"].to_pylist())
        words, at, few = column("word"), rows["at"][0].as_py(), rows["few"][0].as_py()
        rank = pc.rank(words, tiebreaker="dense").to_numpy().astype(np.int64)
        mine = [(p,) for p in range(1, phonetic.RHYME_LENGTH + 1)] if few else groups

        def tell(l: np.ndarray, r: np.ndarray, needed: np.ndarray) -> list[pa.Array]:  # noqa: E741
            found = [pairs_of(*(x[k : k + AT_ONCE] for x in (l, r, needed))) for k in range(0, len(l), AT_ONCE)]
            return [pa.concat_arrays(c) for c in zip(*found, strict=True)]

        def pairs_of(l: np.ndarray, r: np.ndarray, needed: np.ndarray) -> list[pa.Array]:  # noqa: E741
            l, r = np.where(rank[l] < rank[r], l, r), np.where(rank[l] < rank[r], r, l)  # noqa: E741
            agree, earlier, here = own.agree(l, r), np.zeros(len(l), bool), np.zeros(len(l), bool)
            for k, places in enumerate(mine[: at + 1]):
                earlier, here = earlier | here, agree[:, [p - 1 for p in places]].all(axis=1)
            short = (own.sizes[l] < 3) | (own.sizes[r] < 3)
            keep = (rank[l] != rank[r]) & here & ~earlier & (short == few)
            l, r = l[keep], r[keep]  # noqa: E741
            score = own.by_phonemes(l, r, needed[keep])
            keep = score >= threshold - 1e-9
            l, r, score = l[keep], r[keep], score[keep]  # noqa: E741
            return [words.take(pa.array(l)), words.take(pa.array(r)), pa.array(score), pa.array(own.by_vectors(l, r)), pa.array(own.by_characters(l, r))]

        return tell

    return said
