"""The alignment of two tokenizers against a plain one, text by text."""

import hashlib
import random

import numpy as np
import pytest

from momentlake.llm import alignment

ODD = [None, "", " ", "  ", "a", " a", "a ", "a\nb", "a\n\nb \n", "\n", "\t x", "a\r\nb;\r\n c", "x▁y", "<|endoftext|> <s> </s> <0x0A>", "日本語 の テキスト", "é é ﬁ", "a  b　 c", "a\x00b \x01", "🙂 🙂🙂 x", "don't I'll 's", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa " * 20, "   lots    of   space   ", "a\x1c b\x85 c", "1234567 890,12.5%"]


def plain_alignment(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of whole texts, without segments."""
    pair = alignment.TokenizerPair(*alignment.default_paths())
    groups = []
    for t in texts:
        if not t:
            groups.append([])
            continue
        raw = (" " + t).encode()
        a, b = pair.a.encode(" " + t, add_special_tokens=False).ids, pair.b.encode(t)
        x, y = (np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in ((pair.a_bytes, a), (pair.b_bytes, b)))
        if b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
            groups.append([])
            continue
        ends = sorted(set(x) & set(y))
        groups.append([([i for i, z in zip(a, x, strict=True) if lo < z <= hi], [i for i, z in zip(b, y, strict=True) if lo < z <= hi]) for lo, hi in zip([0, *ends], ends, strict=False)])
    links = [[(i, j) for p, q in g for i in p for j in q] for g in groups]
    count, top = {}, {}
    for own in links:
        for p in set(own):
            count[p] = count.get(p, 0) + 1
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for g, own in zip(groups, links, strict=True):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), len(own), sum(count[p] == top[p[0]] for p in own), sum(count[p] for p in own), digest))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = ["the", "a", "It's", "naïve", "zürich", "x1", "foo_bar", ",", "日本", "don't", "3.14", "supercalifragilistic", "\n", "\t", "  ", "\r\n", "▁", " "]
    mixed = [r.choice(["", " "]) + r.choice(["", " ", "\n"]).join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(150)]
    return ODD + mixed + ["the naïve " * 3000] + ["copy of one text"] * 40


@pytest.mark.parametrize("part", [4_000_000, 500])
def test_alignment_matches_whole_texts(spark, texts, part):
    rows = [(i if i % 7 else None, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, k int").repartition(5)
    got = [tuple(r) for r in alignment.align(docs, part=part).collect()]
    want = [(i if i % 7 else None, *w) for i, w in enumerate(plain_alignment(texts))]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert any(w[5] < w[4] for w in want) and sum(not w[1] for w in want) > 5


def test_alignment_without_documents(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = alignment.align(spark.createDataFrame([(1, None), (1, ""), (None, None)], "doc_id long, text string")).collect()
    assert sorted(tuple(r)[1:] for r in only) == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_splitters_follow_the_vocabularies():
    a = {"pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}, "normalizer": None}
    assert alignment.splitters(a, ["x", " y"]) == " \n\t"
    assert alignment.splitters(a, ["x y", "\t\t"]) == "\n\t"
    assert alignment.splitters(a | {"pre_tokenizer": {"type": "Whitespace"}}, ["x"]) == ""
    pair = alignment.TokenizerPair(*alignment.default_paths())
    assert pair.split == " \n\t"
    for t in ODD:
        assert "".join(pair.segments(t)) == (" " + t if t else "")
