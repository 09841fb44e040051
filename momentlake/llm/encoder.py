"""A byte-level BPE encoder for whole texts: the tokenizers library, asked once for each different part of a word.

The pre-tokenizer of such vocabularies always begins a new piece at a single space between two non-space
characters, so a text is the sum of its words there, each but the first with its space.  Texts with other runs of
white space go to the library whole.

It also begins one where letters, digits and other characters meet (but for letters after an apostrophe) and around a
single line break, so that a word is the sum of its parts there.  Cuts are made only between characters whose kind no
version of Unicode changes: printable ASCII and the letters from U+00C0 to U+017F; others stay with what is beside them.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from momentlake.llm.common import utf8
from momentlake.llm.speller import Runs, Speller, joined

#: Words or texts that the library gets at a time: what it returns for each is much larger than the ids.
ASKED = 10_000
#: Bytes of words and ids that are remembered: the library is the dear part, so more than elsewhere.
REMEMBERED = 64_000_000
#: Bytes of texts in a slice; in larger slices more words are equal.
PART = 8_000_000

#: Kinds of characters by their byte; 0: unknown, not cut from what is beside it.
LETTER, DIGIT, MARK, BREAK = 1, 2, 3, 4
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = MARK
KIND[[*range(0x30, 0x3A)]] = DIGIT
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
APOSTROPHE, NEWLINE = 0x27, 0x0A

_encoders: dict[str, WordEncoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; its memory of words outlives a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _regular(words: pa.Array) -> np.ndarray:
    """Neither empty nor with white space at an end."""
    return np.asarray(pc.and_(pc.equal(pc.utf8_trim_whitespace(words), words), pc.greater(pc.binary_length(words), 0)))


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Where parts begin inside of words, which are the UTF-8 bytes of one after another, each with a space before it."""
    kind = KIND[raw]
    lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC5))  # U+00C0 to U+017F
    lead = lead[(raw[lead] != 0xC3) | ((raw[lead + 1] | 0x20) != 0xB7)]  # without the signs of multiplication and division
    kind[lead] = kind[lead + 1] = LETTER
    lines = np.flatnonzero(raw == NEWLINE)
    around = np.concatenate([kind, [0]])
    kind[lines[(around[lines - 1] > 0) & (around[lines + 1] > 0)]] = BREAK
    a, b = kind[:-1], kind[1:]
    return np.flatnonzero((a != b) & (a > 0) & (b > 0) & ((raw[:-1] != APOSTROPHE) | (b != LETTER))) + 1


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.newline = self._one("\n")
        # words may be encoded as lines of one text only where a line break is always a token of its own
        self.by_line = len(self.newline) == 1 and all(
            self._one(f"{a}\n{b}") == self._one(a) + self.newline + self._one(b) for a in ("a", ".", "1", "'s", "é") for b in ("b", " b", "'s", " .", "1")
        )
        self.by_part = self._cuts_hold()
        self.spell = Speller(self._words, self._words, self._texts, _regular, REMEMBERED, PART, self._parts)

    def _one(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _cuts_hold(self) -> bool:
        """Does the pre-tokenizer of this vocabulary cut where _cuts does?"""
        if self.library.normalizer is not None or self.library.pre_tokenizer is None:
            return False
        pieces = lambda text: [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        some = ["a", "Z", "s", "é", "ſ", "0", "7", *(chr(c) for c in range(0x21, 0x7F) if KIND[c] == MARK)]
        for a in some:
            for b in some:
                for pair in (f" {a}{b}", f" {a}\n{b}"):
                    at = _cuts(np.frombuffer(pair.encode(), np.uint8))
                    raw = [x.tobytes().decode() for x in np.split(np.frombuffer(pair.encode(), np.uint8), at)]
                    if pieces(pair) != [x for part in raw for x in pieces(part)]:
                        return False
        return True

    def _parts(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words, each with a space before it, cut where the pre-tokenizer always cuts; none that holds an added token."""
        words = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), words, pa.scalar("", pa.large_string()))
        if not self.by_part:
            return words, np.ones(len(words), np.int64)
        raw, off = utf8(words)
        at = _cuts(raw)
        for t in self.added:
            holds = np.asarray(pc.match_substring(words, t))
            if holds.any():
                at = at[~holds[np.searchsorted(off, at, "right") - 1]]
        starts = np.sort(np.concatenate([off[:-1], at]))
        ends = np.concatenate([starts, off[-1:]])
        return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(raw)), np.diff(np.searchsorted(ends, off))

    def _texts(self, texts: list[str]) -> Runs:
        out: list[np.ndarray] = []
        for k in range(0, len(texts), ASKED):
            out += [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts[k : k + ASKED], add_special_tokens=False)]
        return joined(out)

    def _words(self, words: list[str]) -> Runs:
        """Words or parts without white space at their ends, but for the space that some begin with, or line breaks."""
        every = "".join(words)
        added = [t for t in self.added if t in every]
        alone = range(len(words)) if not self.by_line else [k for k, w in enumerate(words) if "\n" in w or any(t in w for t in added)] if added or "\n" in every else []
        rest = set(alone)
        lines = [w for k, w in enumerate(words) if k not in rest] if rest else words
        flat, count = [], [np.zeros(0, np.int64)]
        for k in range(0, len(lines), ASKED):
            some = lines[k : k + ASKED]
            ids = np.array(self.library.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == self.newline[0])
            if len(at) != len(some) - 1:
                raise ValueError("line breaks aren't tokens of their own in this vocabulary")
            count.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
            flat.append(np.delete(ids, at))
        ids, count = np.concatenate([np.zeros(0, np.uint32), *flat]), np.concatenate(count)
        if not rest:
            return ids, count
        some, counts = self._texts([words[k] for k in alone])
        line = np.ones(len(words), bool)
        line[list(alone)] = False
        both = np.empty(len(words), np.int64)
        both[line], both[~line] = count, counts
        out, by_line = np.empty(len(ids) + len(some), np.uint32), np.repeat(line, both)
        out[by_line], out[~by_line] = ids, some
        return out, both

    def encode(self, column: pa.Array):
        """Slices of the rows of a string array: first row, end, how many ids each has, and all ids (uint32); null counts as empty."""
        return self.spell(column)

    def lengths(self, column: pa.Array) -> np.ndarray:
        """How many ids each whole text has."""
        return np.concatenate([np.zeros(0, np.int64), *(n for _, _, n, _ in self.spell(column, ids=False))])
