"""Cross-tokenizer alignment (12) by segment deduplication.

Tokenizer A is a byte-level BPE of the tokenizers library and gets space + text; B is a sentencepiece model, which adds
the space itself.  Space + text is cut before runs of white space whose first character is one that the vocabularies
verifiably can't merge across (`splitters`): A's pre-tokenizer always ends a piece there, and no piece of B holds that
character after another that isn't white space.  Tokens of the whole are then those of the segments, one after another,
and a group never spans two.

1. A task codes a block of documents: its different segments, and every document as numbers of them.
2. The segments of all blocks are sorted, so that equal ones meet; each different one is encoded by both tokenizers and
   aligned once (token ids, and which tokens end where a token of the other ends), and its alignment goes back to each
   block that holds it.
3. Documents are composed in their block: counts are sums over segments, the digest is taken of the segments' groups in
   order, and for every id pair the block counts how many of its documents hold it linked.
4. Those counts are added up corpus-wide and joined back to the blocks' pairs, where they are summed over links.

Nothing is gathered in one place; a block holds PART bytes of texts, or one text that is longer, and its dictionary.  A segment
that all blocks share is one row of each, however often it occurs.

Defined results: null and empty texts have no tokens, zeros and an empty digest, and so have texts that either tokenizer
doesn't give back byte by byte (a text with U+2581, which B takes for a space); strings of special tokens are plain text;
repeated rows and null doc_ids are rows of their own and count as documents of their own.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.llm.common import cut, discard, release, ship, slices, small_side, sweep, table
from momentlake.llm.speller import Runs, joined

MARK = "▁"
#: Bytes of texts in a block.
PART = 24_000_000
#: Links of one group from which its ids are counted before they are paired, and documents' segments that are paired at a time.
MANY, HELD = 4096, 250_000
#: Segments that are decoded at a time.
CODES = 50_000
#: A character that no piece of B holds: what follows it is encoded as if it stood alone.
ANCHOR = "\n"
_pairs: dict[tuple[str, str], TokenizerPair] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable bytes as they are, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    out = np.cumsum(count) - count
    return np.repeat(start - out, count) + np.arange(int(count.sum()))


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The sum of each run of values."""
    total = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(count)
    return total[end] - total[end - count]


class TokenizerPair:
    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        own = {i: bytes(alphabet[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [own.get(i, b"") for i in range(self.a.get_vocab_size())]
        with open(b_path, "rb") as f:
            (m := pb.ModelProto()).ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type in (kinds.CONTROL, kinds.UNKNOWN) else p.piece.replace(MARK, " ").encode() for p in m.pieces]
        plain = [p.piece.replace(MARK, " ") for p in m.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.add_dummy_prefix:
            raise ValueError("B has to keep texts as they are and to add a space before them")
        if any(ANCHOR in p for p in plain) or len(self.b.encode(ANCHOR)) != 2:
            raise ValueError("a piece of B holds a line break")
        self.split = splitters(json.loads(self.a.to_str()), plain)
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.kind = np.dtype("<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4")
        # one space, then no white space: such segments may be encoded as lines of one text
        self.line = re.compile(r" \S+\Z")
        self.a_break, self.b_break = self.a.encode(ANCHOR).ids, self.b.encode(ANCHOR)[1]
        if len(self.a_break) != 1:
            self.line = re.compile(r"(?!)")
        w = re.escape(self.split)
        # white space, then anything up to the next white space that may be cut before
        self.segment = re.compile(rf"\s*\S+(?:(?![{w}])\s+\S*)*|\s+" if w else r"(?s:.+)")

    def segments(self, text: str | None) -> list[str]:
        """The segments of space + text; none of a null or empty text."""
        return self.segment.findall(" " + text) if text else []

    def _lines(self, segments: list[str]) -> tuple[Runs, Runs] | None:
        """The ids of segments of one space and no other white space, encoded as lines."""
        text = ANCHOR + ANCHOR.join(segments)
        out = []
        for ids, mark, first in ((self.a.encode(text, add_special_tokens=False).ids, self.a_break[0], 0), (self.b.encode(text), self.b_break, 1)):
            ids = np.array(ids, np.int64)[first:]
            at = np.flatnonzero(ids == mark)
            if len(at) != len(segments):
                return None
            out.append((np.delete(ids, at), np.diff(np.append(at, len(ids))) - 1))
        return out[0], out[1]

    def _alone(self, segments: list[str]) -> tuple[Runs, Runs]:
        a = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = [np.array(x[2:], np.int64) for x in self.b.encode([ANCHOR + s for s in segments], num_threads=1)]
        return joined(a), joined(b)

    def encode(self, segments: list[str]) -> tuple[Runs, Runs]:
        """Of both tokenizers all ids, one segment after another, and how many each has."""
        line = np.fromiter((self.line.match(s) is not None for s in segments), bool, len(segments))
        rest = np.flatnonzero(~line)
        some = np.flatnonzero(line)
        lines = self._lines([segments[k] for k in some]) if len(some) else None
        if lines is None:
            return self._alone(segments)
        if not len(rest):
            return lines
        order = np.argsort(np.concatenate([some, rest]), kind="stable")
        out = []
        for (x, n), (y, m) in zip(lines, self._alone([segments[k] for k in rest]), strict=True):
            n = np.concatenate([n, m])
            out.append((np.concatenate([x, y])[spread((np.cumsum(n) - n)[order], n[order])], n[order]))
        return out[0], out[1]

    def align(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Per segment its numbers of tokens (-1, 0 if its bytes aren't given back), and the ids of A and of B.  Where tokens
        of both end follows from their sizes (`ends`)."""
        raw = [s.encode() for s in segments]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        (a, n_a), (b, n_b) = self.encode(segments)
        fits = np.ones(len(raw), bool)
        for ids, n, sizes in ((a, n_a, self.a_size), (b, n_b, self.b_size)):
            fits &= _sums(sizes[ids], n) == size
        off_a, off_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        at, bt = a.tolist(), b.tolist()
        xs, ys = self.a_bytes, self.b_bytes
        for k, (i, j) in enumerate(zip(off_a.tolist(), off_b.tolist(), strict=True)):
            if fits[k] and (b"".join([xs[t] for t in at[i : i + n_a[k]]]) != raw[k] or b"".join([ys[t] for t in bt[j : j + n_b[k]]]) != raw[k]):
                fits[k] = False
        keep_a, keep_b = np.repeat(fits, n_a), np.repeat(fits, n_b)
        a, b, n_a, n_b = a[keep_a], b[keep_b], np.where(fits, n_a, 0), np.where(fits, n_b, 0)
        parts = [a.astype(self.kind).tobytes(), b.astype(self.kind).tobytes()]
        w, out = self.kind.itemsize, []
        for i, j, n, m in zip((np.cumsum(n_a) - n_a).tolist(), (np.cumsum(n_b) - n_b).tolist(), n_a.tolist(), n_b.tolist(), strict=True):
            out.append(parts[0][w * i : w * (i + n)] + parts[1][w * j : w * (j + m)])
        return np.where(fits, n_a, -1), n_b, out

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens of A and of B, of segments that both give back, end where one of the other does."""
        x, y = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        meets = lambda p, q: q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p if len(q) else np.zeros(len(p), bool)
        return meets(x, y), meets(y, x)


def splitters(a: dict, pieces: list[str]) -> str:
    """The white space characters before whose runs a text may be cut, for A's file and B's pieces."""
    pre = a.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or a.get("normalizer"):
        return ""  # A isn't known to end a piece where white space begins
    return "".join(c for c in " \n\t" if not any(re.search(rf"\S{re.escape(c)}", p) for p in pieces))


def tokenizer_pair(a_path: str, b_path: str) -> TokenizerPair:
    """The pair of this Python worker."""
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = TokenizerPair(a_path, b_path)
    return _pairs[a_path, b_path]


def code_blocks(docs: DataFrame, paths: tuple[str, str], text: str = "text", part: int = PART) -> DataFrame:
    """A row per block: block, doc_ids, n (segments of each document), codes (zstandard frame of 32 bit numbers of segments)
    and its different segments."""
    ship(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        pair, task, count = tokenizer_pair(*paths), TaskContext.get().partitionId(), 0
        for b in batches:
            texts = b.column(1)
            size = np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64)
            for a, z in slices(np.concatenate([[0], np.cumsum(size)]), part):
                known: dict[str, int] = {}
                codes, n = [], []
                for t in texts.slice(a, z - a).to_pylist():
                    own = np.fromiter([known.setdefault(s, len(known)) for s in pair.segments(t)], np.int32)
                    codes.append(own)
                    n.append(len(own))
                flat = np.concatenate(codes)
                order = np.argsort(-np.bincount(flat, minlength=len(known)), kind="stable")  # the commonest get the least numbers
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order))
                words = pa.array(list(known), pa.string()).take(pa.array(order))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(task << 32) + count]), pa.array([b.column(0).slice(a, z - a).to_pylist()], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int32())), pa.array([_squeezed(place[flat])]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)],
                    ["block", "doc_ids", "n", "codes", "segments"],
                )
                count += 1
                del known, codes
                release()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return cut(src.mapInArrow(run, "block long, doc_ids array<long>, n array<int>, codes binary, segments array<string>"), "blocks", "zstd")


def align_segments(segments: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """block, code, n_a, n_b and body (see TokenizerPair.align) of rows (block, code, segment): equal segments are sorted
    together and aligned once (twice where a batch ends between them)."""

    def run(batches):
        pair = tokenizer_pair(*paths)
        for batch in batches:
            column = batch.column(2)
            size = np.asarray(pc.binary_length(column)).astype(np.int64)
            for lo, hi in slices(np.concatenate([[0], np.cumsum(size)]), 250_000):
                coded = column.slice(lo, hi - lo).dictionary_encode()
                n_a, n_b, body = pair.align(coded.dictionary.to_pylist())
                k = coded.indices
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *(pa.array(x, t).take(k) for x, t in ((n_a, pa.int32()), (n_b, pa.int32()), (body, pa.binary())))], ["block", "code", "n_a", "n_b", "body"])
            release()

    return segments.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "block long, code int, n_a int, n_b int, body binary")


def _ints(raw: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Little-endian unsigned integers at byte positions."""
    out = np.zeros(len(at), np.int64)
    for k in range(width):
        out |= raw[at + k].astype(np.int64) << (8 * k)
    return out


class _Segments:
    """What a block needs of its segments, in the order of their codes; decoded CODES at a time.

    fits, n_a, n_b, n_groups and n_links by code; texts: its groups as text; ids: the different id pairs (a << 32 | b); the
    linked ones of code c are number[at[c] : at[c + 1]], each linked as often as `often` says."""

    def __init__(self, t: pa.Table, pair: TokenizerPair):
        order = np.argsort(t["code"].to_numpy())
        n_a = t["n_a"].to_numpy()[order].astype(np.int64)
        self.fits, self.n_a, self.n_b = n_a >= 0, np.maximum(n_a, 0), t["n_b"].to_numpy()[order].astype(np.int64)
        self.n_groups, self.n_links = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        texts = [pa.array([], pa.large_string())]
        packed, often, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(order), CODES):
            body = t["body"].take(pa.array(order[lo : lo + CODES])).combine_chunks()
            p, o, c, said = self._decode(body.cast(pa.large_binary()), slice(lo, lo + CODES), pair)
            texts.append(said)
            packed.append(p)
            often.append(o)
            count.append(c)
        self.texts = pa.concat_arrays(texts)
        self.ids, number = np.unique(np.concatenate(packed), return_inverse=True)
        self.number, self.often = number.astype(np.int32), np.concatenate(often)
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(count))])

    def _decode(self, body: pa.Array, codes: slice, pair: TokenizerPair) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """The linked id pairs of some codes, how often each is linked, how many each code has, and its groups as text."""
        n_a, n_b, w = self.n_a[codes], self.n_b[codes], pair.kind.itemsize
        raw = np.frombuffer(body.buffers()[2], np.uint8) if body.buffers()[2] is not None else np.zeros(0, np.uint8)
        start = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body)]
        places = lambda base, n, width: np.repeat(base, n) + width * spread(np.zeros(len(n), np.int64), n)
        a, b = _ints(raw, places(start, n_a, w), w), _ints(raw, places(start + w * n_a, n_b, w), w)
        ends_a, ends_b = pair.ends(a, b)
        groups = self.n_groups[codes] = _sums(ends_a, n_a)
        stop_a, stop_b = np.flatnonzero(ends_a) + 1, np.flatnonzero(ends_b) + 1
        size_a, size_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        links = size_a * size_b
        self.n_links[codes] = _sums(links, groups)

        def said(ids, stop):
            return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], stop])), pa.array(ids).cast(pa.large_string())), pa.scalar(",", pa.large_string()))

        both = pc.binary_join_element_wise(said(a, stop_a), said(b, stop_b), pa.scalar("|", pa.large_string()))
        texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(groups)])), both), pa.scalar(";", pa.large_string()))
        code = np.repeat(np.arange(len(groups)), groups)
        few = links <= MANY
        g = np.repeat(np.flatnonzero(few), size_a[few])  # the group of each token of A
        i = spread((stop_a - size_a)[few], size_a[few])
        own = [(code[np.repeat(g, size_b[g])], np.repeat(a[i], size_b[g]) << 32 | b[spread((stop_b - size_b)[g], size_b[g])])]
        many = [np.ones(len(own[0][0]), np.int64)]
        for k in np.flatnonzero(~few).tolist():
            x, n = np.unique(a[stop_a[k] - size_a[k] : stop_a[k]], return_counts=True)
            y, m = np.unique(b[stop_b[k] - size_b[k] : stop_b[k]], return_counts=True)
            own.append((np.full(len(x) * len(y), code[k]), (x[:, None] << 32 | y[None, :]).ravel()))
            many.append(np.outer(n, m).ravel())
        codes_, packed, many = np.concatenate([c for c, _ in own]), np.concatenate([p for _, p in own]), np.concatenate(many)
        order = np.lexsort((packed, codes_))
        codes_, packed, many = codes_[order], packed[order], many[order]
        head = np.flatnonzero(np.r_[True, (codes_[1:] != codes_[:-1]) | (packed[1:] != packed[:-1])]) if len(order) else order
        return packed[head], np.add.reduceat(many, head) if len(head) else many, np.bincount(codes_[head], minlength=len(groups)), texts


def _per_document(values: np.ndarray, codes: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values[codes])])
    return total[off[1:]] - total[off[:-1]]


def _coded(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's codes and where each document's begin."""
    n = np.array(block["n"][0].as_py(), np.int64)
    return _plain(block["codes"][0].as_py(), np.int32), np.concatenate([[0], np.cumsum(n)])


def _squeezed(x: np.ndarray) -> bytes:
    """A zstandard frame of an array's bytes, the first of all numbers first, then the second, which compresses better."""
    import zstandard

    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=9).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _plain(raw: bytes, kind) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _packed(*arrays: np.ndarray) -> bytes:
    return b"".join(len(z).to_bytes(8, "little") + z for z in map(_squeezed, arrays))


def _unpacked(raw: bytes, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(_plain(raw[at + 8 : at + 8 + n], kind))
        at += 8 + n
    return out


COMPOSED = "block long, k long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, n long, packed binary"


def compose(blocks: DataFrame, alignments: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Per document its counts and digest (k: its place in the block); then, with null k, per id pair how many documents of
    the block hold it linked, and a row with what sums over links need."""

    def run(key, left, right):
        block, (codes, off) = key[0].as_py(), _coded(left)
        n, docs = np.diff(off), len(off) - 1
        own = _Segments(right, tokenizer_pair(*paths))
        del right
        ids, width = own.ids, max(1, len(own.fits))
        bad, digests, sums, held = np.zeros(docs, bool), [], [np.zeros(docs, np.int64) for _ in range(4)], np.zeros(len(ids), np.int64)
        first = 0
        while first < docs:  # some documents at a time
            last = max(first + 1, int(np.searchsorted(off, off[first] + HELD, "right")) - 1)
            some, mine = slice(first, last), codes[off[first] : off[last]].astype(np.int64)
            begin = off[first : last + 1] - off[first]
            bad[some] = _per_document((~own.fits).astype(np.int64), mine, begin) > 0
            for total, x in zip(sums, (own.n_a, own.n_b, own.n_groups, own.n_links), strict=True):
                total[some] = np.where(bad[some], 0, _per_document(x, mine, begin))
            said = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(begin), own.texts.take(pa.array(mine))), pa.scalar(";", pa.large_string()))
            digests += ["" if bad[first + k] or begin[k] == begin[k + 1] else hashlib.sha256(t.as_buffer()).hexdigest() for k, t in enumerate(said)]
            del said
            doc = np.repeat(np.arange(last - first), n[some])
            once = np.unique((doc * width + mine)[~bad[some][doc]])
            doc, code = once // width, once % width
            count = own.at[code + 1] - own.at[code]
            links = np.unique(np.repeat(doc, count) * max(1, len(ids)) + own.number[spread(own.at[code], count)])
            held += np.bincount(links % max(1, len(ids)), minlength=len(ids))[: len(ids)]
            first = last
        there = np.flatnonzero(held)
        pack = _packed(codes, n, bad, ids, own.number, own.often, np.diff(own.at))
        kinds = [pa.int64()] * 7 + [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        nothing = lambda count, which: [pa.nulls(count, kinds[i]) for i in which]
        rows = [
            [pa.array(np.full(docs, block)), pa.array(np.arange(docs)), pa.array(left["doc_ids"][0].as_py(), pa.int64()), *map(pa.array, sums), pa.array(digests, pa.string()), *nothing(docs, range(8, 12))],
            [pa.array(np.full(len(there), block)), *nothing(len(there), range(1, 8)), pa.array(ids[there] >> 32, pa.int32()), pa.array(ids[there] & 0xFFFFFFFF, pa.int32()), pa.array(held[there]), *nothing(len(there), [11])],
            [pa.array([block]), *nothing(1, range(1, 11)), pa.array([pack], pa.binary())],
        ]
        del own, codes
        release()
        return pa.concat_tables([pa.Table.from_arrays(r, [c.split()[0] for c in COMPOSED.split(", ")]) for r in rows])

    return blocks.select("block", "doc_ids", "n", "codes").groupBy("block").cogroup(alignments.groupBy("block")).applyInArrow(run, COMPOSED)


def _weigh(key, left, right):
    """n_best and count_sum of a block's documents, from what compose packed and the corpus-wide counts of its pairs."""
    codes, n, bad, ids, number, often, pairs = _unpacked(left["packed"][0].as_py(), np.int32, np.int64, bool, np.int64, np.int32, np.int64, np.int64)
    off = np.concatenate([[0], np.cumsum(n)])
    k = np.searchsorted(ids, right["a"].to_numpy().astype(np.int64) << 32 | right["b"].to_numpy())
    count, best = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    count[k], best[k] = right["c"].to_numpy(), right["best"].to_numpy()
    sums = [np.where(bad, 0, _per_document(_sums(x[number] * often, pairs), codes, off)) for x in (best, count)]
    return pa.Table.from_arrays([pa.array(np.full(len(bad), key[0].as_py())), pa.array(np.arange(len(bad))), *map(pa.array, sums)], ["block", "k", "n_best", "count_sum"])


def align(docs: DataFrame, text: str = "text", paths: tuple[str, str] | None = None, part: int = PART) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    paths = paths or default_paths()
    blocks = code_blocks(docs, paths, text, part)
    segments = blocks.select("block", F.posexplode("segments").alias("code", "segment"))
    rows = cut(compose(blocks, align_segments(segments, paths), paths), "composed", "zstd")
    discard(blocks)
    sweep(docs.sparkSession)
    pairs = rows.filter(F.col("n").isNotNull()).select("block", "a", "b", "n")
    counts = cut(pairs.groupBy("a", "b").agg(F.sum("n").alias("c")), "counts", "zstd")
    top = counts.groupBy("a").agg(F.max("c").alias("top"))
    weights = counts.join(top, "a").select("a", "b", "c", (F.col("c") == F.col("top")).cast("long").alias("best"))
    known = pairs.select("block", "a", "b").join(small_side(weights), ["a", "b"])
    packed = rows.filter(F.col("packed").isNotNull()).select(F.col("block").alias("block"), "packed")
    weighed = packed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_weigh, "block long, k long, n_best long, count_sum long")
    out = rows.filter(F.col("k").isNotNull()).drop("packed", "a", "b", "n").join(weighed, ["block", "k"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op12_alignment": op12_alignment}
