"""SentencePiece encoding and decoding (10) by a shared-prefix forward pass.

Marked words (a run of marks U+2581 and what follows up to the next mark) are sorted, which makes their common
prefixes neighbours, and walked depth-first as a trie: the forward state of a prefix is computed once and reused by
every word that starts with it.  What the forward state is depends on the model:

* unigram: the best sum of piece scores over all segmentations of the prefix (Viterbi), and its last piece;
* BPE: the last piece of the prefix's own encoding.  Sums of scores don't give SentencePiece's result for such
  models, but this does: a sequence of pieces is the encoding of its text exactly if every two neighbours are the
  encoding of theirs, so of all pieces that end at a place exactly one fits the state where it starts.

The pieces that end at a place are read off an automaton over the characters, whose state is part of what a prefix
shares.  Characters that no piece covers become byte pieces, or the unknown piece if the model has none.
Normalisation other than `identity` is not offered.

Defined results: null and empty texts have no pieces and decode to an empty text; the words of a batch are encoded
once each however often they repeat, and memory of words is bounded; very long words cost time in proportion.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.llm.common import extended, ship, table
from momentlake.llm.speller import Runs, Speller, joined

MARK = "▁"
#: Pairs of pieces that are remembered, and steps of the automaton; some tens of MB.
PAIRS, STEPS = 400_000, 200_000
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_models: dict[str, PieceModel] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel.load(path)
    return _models[path]


class PieceModel:
    """Pieces with scores, and the two directions between text and ids."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], unknown: int, bpe: bool, plain: set[int], add_prefix: bool = True):
        self.pieces, self.scores, self.bpe, self.unknown, self.add_prefix = pieces, scores, bpe, unknown, add_prefix
        self.byte_ids = byte_ids
        self.index = {pieces[i]: i for i in plain}
        self.fits: dict[int, bool] = {}
        self.bad_score = min(scores, default=0.0) - 10.0
        self._automaton()
        raw = [p.encode("utf-8") for p in pieces]
        for b, i in byte_ids.items():
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        marked = lambda words: self.encode_words([MARK + w for w in words])
        self.spell = Speller(marked, None if add_prefix else self.encode_words, self._whole, _regular)

    def _automaton(self) -> None:
        """go: the next state by character; fail: that of the longest proper suffix; ends: (length, id) of the pieces that end here, longest first."""
        self.go: list[dict[str, int]] = [{}]
        self.fail, own = [0], [None]
        for p, i in self.index.items():
            s = 0
            for c in p:
                t = self.go[s].get(c)
                if t is None:
                    t = self.go[s][c] = len(self.go)
                    self.go.append({})
                    self.fail.append(0)
                    own.append(None)
                s = t
            own[s] = (len(p), i)
        self.ends: list[tuple] = [()] * len(self.go)
        todo = list(self.go[0].values())
        for s in todo:  # breadth first: the list grows
            self.ends[s] = ((own[s],) if own[s] else ()) + self.ends[self.fail[s]]
            for c, t in self.go[s].items():
                f = self.fail[s]
                while f and c not in self.go[f]:
                    f = self.fail[f]
                self.fail[t] = self.go[f].get(c, 0)
                todo.append(t)
        for s in self.go[0].values():
            self.ends[s] = (own[s],) if own[s] else ()
        self.steps = 0

    def _step(self, s: int, c: str) -> int:
        """The state after c where go has none; remembered there."""
        f = s
        while f and c not in self.go[f]:
            f = self.fail[f]
        t = self.go[f].get(c, 0)
        if self.steps < STEPS:
            self.steps += 1
            self.go[s][c] = t
        return t

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with identity normalisation are offered")
        if m.trainer_spec.model_type not in (pb.TrainerSpec.UNIGRAM, pb.TrainerSpec.BPE):
            raise ValueError("only unigram and BPE models are offered")
        pieces = [p.piece for p in m.pieces]
        plain = {i for i, p in enumerate(m.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        if any(re.search(f"[^{MARK}]{MARK}", pieces[i]) for i in plain):
            raise ValueError("a piece spans words")
        byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        unknown = next(i for i, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN)
        return cls(pieces, [p.score for p in m.pieces], byte_ids, unknown, m.trainer_spec.model_type == pb.TrainerSpec.BPE, plain, m.normalizer_spec.add_dummy_prefix)

    # -- BPE: whether two pieces stay as they are next to each other

    def _merge(self, symbols: list[str]) -> list[str]:
        """The merges of neighbours, best score first and leftmost of equals."""
        index, scores = self.index, self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = index.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _pair(self, a: int, b: int) -> bool:
        """Whether a and b stay as they are beside each other; a = -1: whether b alone encodes to itself."""
        key = a * len(self.pieces) + b
        known = self.fits.get(key)
        if known is None:
            q = self.pieces[b]
            p = self.pieces[a] if a >= 0 else ""
            known = self._merge(list(p + q)) == ([p, q] if p else [q])
            if len(self.fits) < PAIRS:
                self.fits[key] = known
        return known

    # -- the forward pass

    def encode_words(self, words: list[str]) -> Runs:
        """ids of each word, by a depth-first walk of the trie of the sorted words."""
        found: list[list[int]] = [[]] * len(words)
        # per prefix length: state of the automaton, last piece (-1: a character without piece), where it starts, best score
        state, last, back, best = [0], [-1], [0], [0.0]
        go, ends, fits, bpe, scores, n_pieces = self.go, self.ends, self.fits, self.bpe, self.scores, len(self.pieces)
        before = ""
        for k in sorted(range(len(words)), key=words.__getitem__):
            w = words[k]
            common = 0
            for x, y in zip(before, w):  # noqa: B905
                if x != y:
                    break
                common += 1
            del state[common + 1 :], last[common + 1 :], back[common + 1 :], best[common + 1 :]
            s = state[common]
            for end in range(common + 1, len(w) + 1):
                c = w[end - 1]
                t = go[s].get(c)
                if t is None:
                    t = self._step(s, c)
                s = t
                state.append(s)
                piece, start = -1, end - 1
                if bpe:
                    for n, i in ends[s]:
                        a = last[end - n]
                        ok = fits.get(a * n_pieces + i)
                        if ok is None:
                            ok = (a < 0 or self._pair(-1, i)) and self._pair(a, i)
                        if ok:
                            piece, start = i, end - n
                            break
                else:
                    top = best[end - 1] + self.bad_score
                    for n, i in ends[s]:
                        total = best[end - n] + scores[i]
                        if total > top:
                            piece, start, top = i, end - n, total
                    best.append(top)
                last.append(piece)
                back.append(start)
            ids: list[int] = []
            end = len(w)
            while end:
                if last[end] >= 0:
                    ids.append(last[end])
                elif self.byte_ids:
                    ids += [self.byte_ids[b] for b in reversed(w[end - 1].encode("utf-8"))]
                else:
                    ids.append(self.unknown)
                end = back[end]
            ids.reverse()
            found[k] = ids
            before = w
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(count.sum())), count

    def _whole(self, texts: list[str]) -> Runs:
        """Texts with marks of their own or odd spaces."""
        parts = [_WORD.findall((MARK if self.add_prefix else "") + t.replace(" ", MARK)) if t else [] for t in texts]
        words = list({w for p in parts for w in p})
        ids, count = self.encode_words(words)
        own = dict(zip(words, np.split(ids, np.cumsum(count)[:-1]), strict=True)) if words else {}
        return joined([np.concatenate([np.zeros(0, np.uint32), *map(own.__getitem__, p)]) for p in parts])

    def encode(self, column: pa.Array):
        """Slices of the rows of a string array: first row, end, how many ids each has, and all ids (uint32)."""
        return self.spell(column)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; undecodable bytes become U+FFFD, one each."""
        size = self.raw_size[ids]
        out = np.cumsum(size) - size
        raw = self.raw[np.repeat(self.raw_start[ids] - out, size) + np.arange(int(size.sum()))]
        text = raw.tobytes().decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.add_prefix and text[:1] == " " else text


def _regular(words: pa.Array) -> np.ndarray:
    """Words of one mark that stands before them."""
    return np.asarray(pc.and_not(pc.greater(pc.binary_length(words), 0), pc.match_substring(words, MARK)))


def encode(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns in keep, then pieces: the ids of the whole text as an array of ints."""
    ship(docs.sparkSession)
    path = path or default_path()
    src = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("__text"))
    schema = extended(src.drop("__text"), pieces="array<int>")

    def run(batches):
        m = model(path)
        for b in batches:
            for a, z, count, ids in m.encode(b.column("__text")):
                off = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                some = pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, z - a) for c in b.columns[:-1]), some], [f.name for f in schema])

    return src.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "pieces")


def decode(rows: DataFrame, keep: list[str], pieces: str = "pieces", path: str | None = None) -> DataFrame:
    """The columns in keep, then text."""
    ship(rows.sparkSession)
    path = path or default_path()
    src = rows.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(pieces).alias("__ids"))
    schema = extended(src.drop("__ids"), text="string")

    def run(batches):
        m = model(path)
        for b in batches:
            texts = [m.decode(np.array(x or [], np.int64)) for x in b.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [f.name for f in schema])

    return src.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")


def digest(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns in keep; n_pieces and ids_crc32 of the encoding; whether decoding gives the text back."""
    ship(docs.sparkSession)
    path = path or default_path()
    src = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("__text"))
    schema = extended(src.drop("__text"), n_pieces="long", ids_crc32="long", round_trip="boolean")

    def run(batches):
        m = model(path)
        for b in batches:
            for a, z, count, ids in m.encode(b.column("__text")):
                own = np.split(ids, np.cumsum(count)[:-1])
                crc = np.fromiter((zlib.crc32(x.astype("<u4", copy=False)) for x in own), np.int64, z - a)
                same = [m.decode(x) == (t or "").replace(MARK, " ") for x, t in zip(own, b.column("__text").slice(a, z - a).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, z - a) for c in b.columns[:-1]), pa.array(count), pa.array(crc), pa.array(same)], [f.name for f in schema])

    return src.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_pieces", "ids_crc32", "round_trip")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), ["doc_id"])


def stage_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: doc_id, source and the pieces of every document; a null or empty text has none, and repeated rows each have theirs."""
    return encode(docs, ["doc_id", "source"])


QUERIES = {"op10_pieces": op10_pieces}
