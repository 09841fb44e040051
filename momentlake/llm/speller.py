"""Whole texts to ids by their words: a batch is split at single spaces, each different word is encoded once.

`Speller` holds for encoders of which a text's ids are those of its words, one after another.  Words and ids stay in
Arrow and numpy arrays: splitting, finding the different words and putting their ids together cost no Python object a
word, only words not met before do.  Where an encoder cuts words further, their parts are what is remembered and asked for:
texts have fewer of them than words.  The memory is bounded in bytes; a slice of a batch holds at most PART bytes of
text, or one text that is longer.

Rows that hold a word which `regular` refuses go to `whole`, so an encoder may leave any odd text to its library.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from momentlake.llm.common import release, slices

#: Bytes of whole texts whose words are held at a time.
PART = 3_000_000
#: Bytes of words and ids that are remembered from slice to slice, about.
REMEMBERED = 24_000_000

Runs = tuple[np.ndarray, np.ndarray]
#: Words to their ids, one after another, and how many each has.
Encode = Callable[[list[str]], Runs]
#: Words to parts of which their ids are those, one after another: the parts of all words, and how many each has.
Cut = Callable[[pa.Array], tuple[pa.Array, np.ndarray]]


def gathered(ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ids that begin at start and have count ids, one after another, and where each begins there."""
    out = np.cumsum(count) - count
    return ids[np.repeat(start - out, count) + np.arange(int(count.sum()))], out


def joined(runs: list[np.ndarray]) -> Runs:
    return (np.concatenate(runs) if runs else np.zeros(0, np.uint32)), np.fromiter(map(len, runs), np.int64, len(runs))


class Memory:
    """The ids of words met before, or of their parts."""

    def __init__(self, encode: Encode, most: int = REMEMBERED, cut: Cut | None = None):
        self.encode, self.most, self.cut = encode, most, cut
        self.words = pa.array([], pa.large_string())
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __call__(self, words: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and count of each word's ids, and the ids; often: how often each word occurs."""
        if self.cut is None or not len(words):
            return self._known(words, often)
        parts, n = self.cut(words)
        coded = parts.dictionary_encode()
        which = np.asarray(coded.indices)
        start, count, ids = self._known(coded.dictionary, np.bincount(which, np.repeat(often, n)))
        length = count[which]
        ids, _ = gathered(ids, start[which], length)
        total = np.add.reduceat(length, np.cumsum(n) - n)
        return np.cumsum(total) - total, total, ids

    def _known(self, words: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = pc.index_in(words, value_set=self.words)
        new = np.asarray(at.is_null())
        at = np.asarray(at.fill_null(0)).astype(np.int64)
        at[new] = len(self.words) + np.arange(int(new.sum()))
        fresh = words.filter(pa.array(new))
        ids, count = self.encode(fresh.to_pylist())
        start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        count, ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])
        words_ = pa.concat_arrays([self.words, fresh])
        if words_.nbytes + ids.nbytes + 16 * len(words_) <= self.most:
            self.words, self.start, self.count, self.ids = words_, start, count, ids
        else:  # begin anew with what isn't rare
            again = often > 1
            k = at[again]
            self.words, self.count = words.filter(pa.array(again)), count[k]
            self.ids, self.start = gathered(ids, start[k], self.count)
        return start[at], count[at], ids


class Speller:
    """heads encodes the first word of a text, if that differs; regular says which words may be encoded alone; words gets the parts that cut makes of words, if there is one."""

    def __init__(
        self, words: Encode, heads: Encode | None, whole: Encode, regular: Callable[[pa.Array], np.ndarray], remembered: int = REMEMBERED, part: int | None = None, cut: Cut | None = None
    ):
        self.part = part
        self.memory, self.heads, self.whole, self.regular = Memory(words, remembered, cut), heads, whole, regular

    def __call__(self, column: pa.Array, ids: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
        """For one slice of rows after another: first row, end, ids per row, and with `ids` the ids themselves."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        size = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
        for a, z in slices(np.concatenate([[0], np.cumsum(size)]), self.part or PART):
            gc.disable()  # many small objects, none in a cycle
            try:
                count, flat = self._spell(column.slice(a, z - a).fill_null("").cast(pa.large_string()), ids)
            finally:
                gc.enable()
            release()
            yield a, z, count, flat

    def _spell(self, texts: pa.Array, wanted: bool) -> tuple[np.ndarray, np.ndarray | None]:
        parts = pc.split_pattern(texts, " ")
        off = np.asarray(parts.offsets).astype(np.int64)
        first = off[:-1] - off[0]
        n = int(off[-1] - off[0])
        coded = parts.flatten().dictionary_encode()
        words, which = coded.dictionary, np.asarray(coded.indices)
        odd, asked = np.zeros(len(texts), bool), np.ones(n, bool)
        regular = self.regular(words)
        if not regular.all():
            row = np.repeat(np.arange(len(texts)), np.diff(off))
            odd[row[~regular[which]]] = True
            asked = ~odd[row]
        if self.heads:
            asked[first] = False
        often = np.bincount(which[asked], minlength=len(words))
        used = np.flatnonzero(often)
        start, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        start[used], count[used], ids = self.memory(words.take(pa.array(used)), often[used])
        begin, length = start[which], count[which]
        length[~asked] = 0
        more, at = [ids], len(ids)
        if self.heads and not odd.all():
            rows = np.flatnonzero(~odd)
            heads, k = np.unique(which[first[rows]], return_inverse=True)
            some, counts = self.heads(words.take(pa.array(heads)).to_pylist())
            begin[first[rows]], length[first[rows]] = (at + np.cumsum(counts) - counts)[k], counts[k]
            more.append(some)
            at += len(some)
        if odd.any():
            rows = np.flatnonzero(odd)
            some, counts = self.whole(texts.take(pa.array(rows)).to_pylist())
            begin[first[rows]], length[first[rows]] = at + np.cumsum(counts) - counts, counts
            more.append(some)
        per_row = np.add.reduceat(length, first) if n else np.zeros(len(texts), np.int64)
        if not wanted:
            return per_row, None
        return per_row, gathered(np.concatenate(more), begin, length)[0]
