"""Every operator against brute force on small tables with nulls, empties, long texts, ties, repeats and clashing names."""

import json
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from momentlake.llm import embedding_dedup, encoder, html_text, language_id, minhash_dedup, mixing, pieces, quality, token_counts, token_files, topk
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(7)
VOCAB = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]


def sentence(r, n):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def documents():
    r = random.Random(3)
    out = []
    for i in range(60):
        out.append((i, sentence(r, r.randint(1, 120)), r.choice(["en", "de", None]), r.choice(["a", "b", "ü", None]), 1))
    base = sentence(r, 80)
    out += [(100, base, "en", "a", 1), (101, base, "en", "a", 1), (102, base.upper(), "en", "b", 1)]
    w = base.split()
    for k in range(12):
        x = list(w)
        for _ in range(k % 4):
            x[r.randrange(len(x))] = "changed"
        out.append((110 + k, "  ".join(x), "de", "a", 1))
    out += [(200, None, "en", "a", 1), (201, "", "en", None, 1), (202, " \t\n ", "en", "a", 1), (203, "one", "en", "a", 1), (204, "ONE", "en", "a", 1), (205, "12 34 ?", "en", "b", 1)]
    out += [(300, sentence(r, 20_000), "en", "a", 1), (301, "x" * 50_000, "en", "a", 1), (302, "a\u0000b <|endoftext|> ▁c\n\n d  e", "en", "b", 1)]
    return out + out[:3]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOC).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_token_counts(spark, docs, empty):
    lib = encoder.encoder(encoder.default_path()).library
    lens = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in documents()]
    sums = token_counts.token_counts(docs.withColumn("t", F.lit(1)).withColumn("n_tokens", F.lit("x"))).cache()
    got = {r.n_tokens: r for r in sums.collect()}
    count = Counter(lens)
    assert {k: r.n_docs for k, r in got.items()} == dict(count)
    for n, r in got.items():
        assert r.docs_at_least == sum(x >= n for x in lens)
        assert r.tokens_at_least == sum(x for x in lens if x >= n)
        assert r.truncated_total == sum(min(x, n) for x in lens)
    assert token_counts.total(sums) == sum(lens)
    for limit in (0, 1, 17, 100, 10**6):
        assert token_counts.truncated_total(sums, limit) == sum(min(x, limit) for x in lens)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        want = min(n for n in count if sum(x <= n for x in lens) >= q * len(lens))
        assert token_counts.quantile(sums, q) == want
    none = token_counts.token_counts(empty)
    assert none.count() == 0 and token_counts.total(none) == 0 and token_counts.quantile(none, 0.5) is None


def spelled(spell, texts):
    """The ids of every text, from the slices of a speller."""
    import pyarrow as pa

    return [x.tolist() for a, z, n, ids in spell(pa.array(texts, pa.string())) for x in np.split(ids, np.cumsum(n)[:-1])]


ODD = ["a  b", " a", "a ", "it's 's", "\n", "a\nb", "a\n b", "a \nb", "x\r\ny", "<|endoftext|> a<|endoftext|>b", "\u00a0x y\u2003", "a\u0085 b", "\x1cq \x1f r", " ", "  ", "a\tb c\t", "1 2.5 's 'll"]


@pytest.mark.parametrize("remembered", [64_000_000, 400])
@pytest.mark.parametrize("part", [4_000_000, 300])
def test_encoder_matches_the_library(monkeypatch, remembered, part):
    monkeypatch.setattr(encoder, "PART", part)
    enc = encoder.WordEncoder(encoder.default_path())
    enc.spell.memory.most = remembered
    r = random.Random(5)
    mixed = ["".join(r.choice(["a", "It", "'s", " ", " ", " ", "\n", "\t", "7", ",", "é", "\u00a0", "<|endoftext|>", "日"]) for _ in range(r.randint(0, 30))) for _ in range(400)]
    texts = [t for _, t, *_ in documents()] + ODD + mixed
    want = [enc.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert spelled(enc.encode, texts) == want
    import pyarrow as pa

    assert enc.lengths(pa.array(texts)).tolist() == [len(x) for x in want]
    assert enc.lengths(pa.array([], pa.string())).tolist() == []


class Asked:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, library):
        self.library, self.texts = library, []

    def encode_batch_fast(self, texts, **more):
        self.texts += texts
        return self.library.encode_batch_fast(texts, **more)


def test_encoder_asks_for_parts_of_words():
    """op8_token_files: each word with its marks and the line after it was asked for, many times what there are of parts."""
    r = random.Random(8)
    stems = ["".join(r.choice("abcdefgéñßœ") for _ in range(9)) for _ in range(120)]
    ends = [",", ".", "###", "7", "'s,", ".\nÜb", "\n", "!?)", "\n("]
    texts = [f"Z {a}{e}{b} {b}{e}x" for a in stems for e in ends for b in r.sample(stems, 3)]
    enc = encoder.WordEncoder(encoder.default_path())
    want = [enc.library.encode(t, add_special_tokens=False).ids for t in texts]
    enc.library = Asked(enc.library)
    assert spelled(enc.encode, texts) == want
    different = {w for t in texts for w in t.split(" ")}
    assert len("\n".join(enc.library.texts)) < sum(map(len, different)) / 4


@pytest.mark.parametrize("remembered", [64_000_000, 300])
def test_encoder_cuts_where_the_library_does(remembered):
    enc = encoder.WordEncoder(encoder.default_path())
    enc.spell.memory.most = remembered
    r = random.Random(9)
    some = ["a", "Zz", "s", "'", "'s", "'ll", "_", ",", ".", "|>", "<|", "<|endoftext|>", "7", "42", "\n", "\r", "\t", "é", "ß", "×", "÷", "À", "ÿ", "ŉ", "ſ", "ƀ", "¿", "ª", "²", "٣", "…", "’", "e\u0301", "\u00a0", "\u2028", "\x7f", "\x1f", "\0", "日", "я", "😀"]
    texts = ["".join(r.choices([*some, " "], k=r.randint(1, 12))) for _ in range(4000)]
    texts += [f"w {a}{b}{c} w" for a in some for b in some for c in ("", "\nA", "\n's", "'t")]
    assert spelled(enc.encode, texts) == [enc.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_of_a_vocabulary_without_cuts_in_words(tmp_path):
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(encoder.default_path())
    other.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(r" ?\S+|\s+(?!\S)|\s+"), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    other.save(str(tmp_path / "other.json"))
    enc = encoder.WordEncoder(str(tmp_path / "other.json"))
    texts = [t for _, t, *_ in documents()] + ["x word.It's 12ab (c)\nd,e f"]
    assert not enc.by_part
    assert spelled(enc.encode, texts) == [enc.library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (5, None, 0), (5, 0, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    ev = quality.evidence(docs.withColumn("c0", F.lit(1)), model).drop("text").cache()
    rate = quality.base_rate(model)
    site = quality.sites(ev.select(F.col("source").alias("host"), F.col("lang").alias("path"), "__llr"), rate)
    out = quality.posterior(ev, site, rate, F.col("source"), F.col("lang")).toPandas()
    assert len(out) == len(documents()) and out["__good"].between(0, 1).all() and out["__path_rate"].between(0, 1).all()
    # posteriors against plain sums
    p = 1 - 1 / (1 + rate / (1 - rate) * np.exp(out["__llr"]))
    sites = {(r.host, r.path): r for r in site.collect()}
    for (host, path), rows in out.assign(p=p).groupby([out["source"].fillna("-"), out["lang"].fillna("-")]):
        r = sites[None if host == "-" else host, None if path == "-" else path]
        assert r.n == len(rows) and r.good == pytest.approx(rows["p"].sum())
        want = (r.good - rows["p"] + r.strength * r.host_rate) / (r.n - 1 + r.strength)
        assert np.allclose(rows["__path_rate"], want.clip(1e-6, 1 - 1e-6))
    flat = quality.fit(empty, labels)
    assert quality.base_rate(flat) == 0.5 and quality.evidence(empty, flat).count() == 0


def plain_posteriors(rows, model):
    """Of each row (doc_id, text, lang, source, ...) its posterior, host rate and path rate, by plain sums."""
    mean, scale, w, prior = model
    rate = quality.base_rate(model)
    llr = []
    for _, t, *_ in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        x = quality.measures(raw, np.array([0, len(raw)]))
        llr.append(float(np.clip((x - mean) / scale @ w[:-1] + w[-1] - prior, -20, 20)[0]))
    p = [1 - 1 / (1 + rate / (1 - rate) * np.exp(x)) for x in llr]

    def strength(groups):  # (rate, n, around): the method of moments for a Beta prior
        m = [a * (1 - a) for _, _, a in groups]
        spread = sum(n * (r - a) ** 2 for r, n, a in groups) - sum(m)
        v = max(spread / sum(n for _, n, _ in groups), 1e-9)
        return min(max(np.mean(m) / v - 1, 2.0), 1000.0)

    hosts, paths = {}, {}
    for (_, _, lang, source, *_), x in zip(rows, p, strict=True):
        hosts.setdefault(source, []).append(x)
        paths.setdefault((source, lang), []).append(x)
    mu = min(max(sum(p) / len(p), 1e-6), 1 - 1e-6)
    a = strength([(np.mean(x), len(x), mu) for x in hosts.values()])
    host_rate = {k: (sum(x) + a * mu) / (len(x) + a) for k, x in hosts.items()}
    b = strength([(np.mean(x), len(x), host_rate[k[0]]) for k, x in paths.items()])
    out = []
    for (_, _, lang, source, *_), x, r in zip(rows, p, llr, strict=True):
        own = paths[source, lang]
        path = (sum(own) - x + b * host_rate[source]) / (len(own) - 1 + b)
        path = min(max(path, 1e-6), 1 - 1e-6)
        out.append((1 - 1 / (1 + path / (1 - path) * np.exp(r)), host_rate[source], path))
    return out


def test_quality_equals_plain_sums(spark):
    """Hosts of one document to hundreds, so that sparse ones are pulled to the global rate and dense ones aren't."""
    r = random.Random(14)
    rows = []
    for h, (n, bad) in enumerate([(1, 1.0), (1, 0.0), (2, 1.0), (3, 0.5), (40, 0.9), (150, 0.05), (60, 0.5)]):
        for _ in range(n):
            t = sentence(r, 40)
            rows.append((len(rows), " ".join(w.upper() + "!" * r.randint(0, 2) for w in t.split()) if r.random() < bad else t, r.choice(["en", "de", None]), f"host{h}" if h else None, 1))
    rows += [(1000, None, "en", "host5", 1), (1001, "", None, None, 1), rows[7], rows[7]]
    df = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, int(t == t.lower()), 0) for i, t, *_ in rows[::2] if t], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    want = plain_posteriors(rows, model)
    got = quality.judged(df.withColumn("host", F.lit("clash")).withColumn("good", F.lit("clash")), labels, ["doc_id", "host"]).collect()
    key = lambda x: [round(float(v), 9) for v in x]
    assert sorted((i, *key(w)) for (i, *_), w in zip(rows, want, strict=True)) == sorted((x.doc_id, *key((x["__good"], x["__host_rate"], x["__path_rate"]))) for x in got)
    rates = {x["source"]: x["__host_rate"] for x in got}
    assert max(rates.values()) - min(rates.values()) > 0.2  # hosts differ
    assert {x["__words"] for x in got if x.doc_id in (1000, 1001)} == {0} and all(x["__words"] == 40 for x in got if x.doc_id < 250)


def test_quality_measures_and_held_out_accuracy(spark):
    r = random.Random(5)
    rows = [(i, sentence(r, 60) if i % 2 else " ".join(w.upper() + "!!" for w in sentence(r, 60).split()), None, None, 1) for i in range(400)]
    d = spark.createDataFrame(rows, DOC)
    model = quality.fit(d, spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int"))
    got = {x.doc_id: x["__llr"] > 0 for x in quality.evidence(d, model).collect()}
    assert all(got[i] == bool(i % 2) for i in range(200, 400))
    off = np.array([0, 11, 11])
    m = quality.measures(np.frombuffer(b"aa aa bb A1", np.uint8), off)
    assert m[0, 10] == pytest.approx(3 / 4) and m[0, 11] == pytest.approx(1 / 4) and m[1, 8] == 0


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li>Menu</li></ul></nav><div class="ad">buy</div>
<div class=teaser><span>Every page says this</span></div>{}<footer>&copy; me</footer><script>var a="</p>";</script></body>"""


def test_html(spark):
    article = "<article><h1>T &amp; &lt;x&gt;</h1><p>One<br>two <b>three<p>Four  &#233;\n five<div class='comments'><p>no</p></div><aside>no</aside></article>"
    rows = [(i, f"http://h.org/{i}?q#f", PAGE.format(f"<div><p>Own text {i}</p></div>")) for i in range(20)]
    rows += [(30, "https://other.org/", PAGE.format(article)), (31, None, None), (32, "x", ""), (33, "h", "plain <b>text"), (34, "http://h.org/a", PAGE.format(article)), (34, "http://h.org/a", PAGE.format(article))]
    rows += [(40 + i, "http://copies.org/", PAGE.format("<article><p>The same story</p></article>")) for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("key", F.lit(2))
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect()]
    assert all(n == len(t) for _, t, n in got)
    by = dict((i, t) for i, t, _ in got)
    assert len(got) == len(rows) and by[3] == "Own text 3"
    assert by[30] == by[34] == "T & <x>\nOne two three\nFour é five"
    assert by[31] == by[32] == "" and by[33] == "plain text" and by[44] == "The same story"
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_leaves_out_articles_that_are_none():
    page = """<body><article class="post has-comments"><p>Story</p><article class="comment"><p>Nice</p></article><p>End</p></article>
<article class="teaser related"><p>More</p></article></body>"""
    assert html_text.main_text(html_text.parse(page)) == "Story\nEnd"


def test_html_names_are_whole_and_spare_the_main_text():
    read = lambda x: html_text.main_text(html_text.parse(x))
    story = "<article><p>The story of the day</p></article>"
    for wrapper in ('div class="page with-sidebar"', 'div id="content" class="no-sidebar"', 'div class="sidebar"', 'div class="widget" role="dialog"', "form id=aspnetForm", 'section class="header"'):
        assert read(f"<body><div {wrapper.split(' ', 1)[1]}>{story}</div></body>") == read(f"<body><{wrapper}>{story}</{wrapper.split()[0]}></body>") == "The story of the day"
        assert read(f"<body><{wrapper}>{story.replace('article', 'main')}</{wrapper.split()[0]}></body>") == "The story of the day"
    inner = '<section id="related-work"><p>A</p></section><h2 id="sharing-data">B</h2><div class="article-notice-text">C</div>'
    assert read(f"<article>{inner}</article>") == "A\nB\nC"
    assert read('<article><div class="widget"><p>Most of the text is here</p></div><p>End</p></article>') == "Most of the text is here\nEnd"
    assert read('<article class="post widget"><p>The only one</p></article><p>Much more text than there is in the article</p>') == "The only one"
    small = '<div class="cookie-banner">x</div><div class="nav main">y</div><div id="sidebar"><article>z</article></div><div class="comments">' + "Nice! " * 20 + "</div>"
    assert read(f"<body>{story}{small}</body>") == read(f"<body><main>{story}{small}</main></body>") == "The story of the day"


def test_html_counts_templates_inside_articles(spark):
    own = lambda i: " ".join(f"{w}{i}" for w in "each has a text of its own that no other page of this host repeats".split())
    page = '<body><{0}><div class="x7">Subscribe now</div><p>Story {1} with <i>in vitro</i> data: {2}</p><p class="x8">This text stands under all of them.</p><p>A licence line of the author ends it.</p><h2>Results</h2><p>Yes.</p></{0}></body>'
    rows = [(i, f"http://h.org/{i}", page.format(("article", "main")[i % 2], i, own(i))) for i in range(24)]
    story = "<article><div>Once upon a time there was a story.</div><p>It was told on every page of a host.</p></article><div>{}</div>"
    rows += [(100 + i, f"http://copies.org/{i}", story.format(i)) for i in range(24)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} with in vitro data: {own(i)}\nA licence line of the author ends it.\nResults\nYes." for i in range(24))
    assert all(got[100 + i] == "Once upon a time there was a story.\nIt was told on every page of a host." for i in range(24))


def test_html_templates_by_different_bodies_whatever_the_hosts_size(spark):
    rows = [(i, f"http://copies.org/{i % 2}", "<body><div><p>One page that was stored more than once</p></div></body>") for i in range(25)]
    rows += [(100 + i, None, "<body><div><p>A page without any address at all</p></div></body>") for i in range(25)]
    menu = '<body><div class="x7">A notice of one section</div>{}</body>'
    rows += [(200 + i, f"http://large.org/{i}", (menu if i < 30 else "<body>{}</body>").format(f"<p>The text of page {i} of a large host</p>")) for i in range(400)]
    counter = "<body><div><p>" + "</p><p>".join(f"Sentence {k} of a long story with a counter" for k in range(40)) + "</p></div><p>{} have read it up to now</p></body>"
    rows += [(1000 + i, f"http://near.org/{i}", counter.format(i)) for i in range(30)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "One page that was stored more than once" for i in range(25))
    assert all(got[100 + i] == "A page without any address at all" for i in range(25))
    assert all(got[200 + i] == f"The text of page {i} of a large host" for i in range(400))
    assert all(len(got[1000 + i].split("\n")) == 41 for i in range(30))


def test_html_count_equals_plain_sets(spark):
    """The whole operator against counts in plain dictionaries; and the count changes what is returned."""
    r = random.Random(21)
    block = lambda k: f'<div class="x{k}"><p>Notice number {k} stands on many pages.</p></div>'
    rows = []
    for i in range(160):
        host = r.choice(["a.org", "b.org", "c.org"])
        parts = [f"<p>Sentence {r.random()} of page {i} alone.</p>" for _ in range(r.randint(1, 4))] + [block(k) for k in range(6) if r.random() < (0.3 if host == "a.org" else 0.08)]
        r.shuffle(parts)
        rows.append((i, f"https://{host}/{i}", f"<html><body><article>{''.join(parts)}</article></body></html>"))
    rows += [(900 + k, "https://b.org/same", rows[0][2]) for k in range(20)] + [(950, None, None), (951, "", ""), (952, "https://a.org/x", None)]
    hosts, seen = {}, {}
    for i, url, h in rows:
        host = (url or "").partition("://")[2].partition("/")[0]
        trees = html_text.subtrees(html_text.parse(h or ""))
        hosts[i] = host
        for t, *body in trees.values():
            seen.setdefault((host, t), set()).add(tuple(body))
    own = {k: np.mean([len(set(least)) for least in list(zip(*bodies, strict=True))[1:]]) for k, bodies in seen.items()}
    template = {k for k, bodies in seen.items() if len(bodies) >= html_text.MIN_BODIES and own[k] >= html_text.OWN_SHARE * len(bodies)}
    want, plain = {}, {}
    for i, _, h in rows:
        root = html_text.parse(h or "")
        trees = html_text.subtrees(root)
        want[i] = html_text.main_text(root, {t for t, *_ in trees.values() if (hosts[i], t) in template}, trees)
        plain[i] = html_text.main_text(root)
    got = {x.page_id: x for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("key", F.lit(1)).repartition(6)).collect()}
    assert {i: x.text for i, x in got.items()} == want and all(x.n_chars == len(x.text) for x in got.values())
    changed = {i for i in want if want[i] != plain[i]}
    notes = lambda texts, host: sum("Notice" in t for i, t in texts.items() if hosts[i] == host)
    assert len(changed) > 20 and notes(want, "a.org") < notes(plain, "a.org") / 4 and notes(want, "c.org") > 0


def test_html_takes_a_long_notice_from_short_pages(spark):
    notice = "<div><p>" + "</p><p>".join(f"Sentence {k} of a notice that is longer than all else." for k in range(12)) + "</p></div>"
    rows = [(i, f"http://h.org/{i}", f"<body>{notice}<p>{sentence(random.Random(i), 8)}</p></body>") for i in range(24)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: sentence(random.Random(i), 8) for i in range(24)}


def test_html_counts_what_names_drop_too():
    """Menus and footers are counted as any other subtree; a list of links that has no name is deleted by the count alone."""
    page = html_text.parse("<body><nav><ul><li><a href=/a>Products of ours and prices</a></li></ul></nav><article><p>Text</p></article><footer>Printed by a printer</footer></body>")
    trees = html_text.subtrees(page)
    tags = {x.tag for x in walk(page) if id(x) in trees}
    assert {"nav", "ul", "footer"} <= tags and "p" not in tags


def walk(node):
    yield node
    for x in node.items:
        if not isinstance(x, str):
            yield from walk(x)


@pytest.mark.parametrize("text", ["<b>" * 150_000 + "</i>" * 150_000, "<a b=\"" * 150_000, "<a b='\"" * 100_001, "<div>" * 100_000 + "<li>x" * 100_000, "<![CDATA[" * 100_000, "<!--" * 200_000, "<" * 500_000, "<p a=\"" + "x" * 900_000, "<article>x</article>" * 40_000, "<i><div>" * 50_000 + "<b>" * 50_000 + "</i>" * 50_000])
def test_html_of_a_megabyte_takes_seconds(text):
    began = time.process_time()
    root = html_text.parse(text)
    html_text.main_text(root, {1}, html_text.subtrees(root))
    assert time.process_time() - began < 8


def test_html_without_broadcast(spark, monkeypatch):
    rows = [(i, f"http://h.org/{i}", PAGE.format(f"<div><p>Own text {i}</p></div>")) for i in range(20)]
    monkeypatch.setattr(html_text, "broadcast_rows", lambda _: 0)
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own text {i}" for i in range(20)}


def vectors(n=400, dims=8):
    g = np.random.default_rng(2)
    v = g.normal(size=(n, dims))
    v[50:120] = v[49] + g.normal(size=(70, dims)) * 0.15
    v[120:150] = v[119]
    rows = [(i, [float(np.float32(x)) for x in v[i]], int(i % 3) if i < 49 else 1) for i in range(n)]
    rows[7] = (7, None, 1)
    rows[8] = (8, [0.0] * dims, 1)
    rows[9] = (9, [float("nan")] + [0.0] * (dims - 1), 1)
    rows[10] = (10, [None] + [1.0] * (dims - 1), 1)
    rows[11] = (11, [float("inf")] + [1.0] * (dims - 1), 1)
    rows[12] = (12, rows[13][1], None)
    rows[14] = (14, [1.0, 2.0], 1)
    rows[15] = (15, [2.0, 4.0], 1)
    rows[16] = (16, [], 1)
    return rows


E = "vec_id long, embedding array<float>, label int"


def test_topk(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, E).withColumn("v", F.lit("clash")).withColumn("dims", F.lit(0))
    out = topk.top_k(df, F.col("vec_id") % 20 == 0, 5, q_block=7, v_block=90)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect())
    ok = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int)) for i, v, _ in rows if v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for a, (q, x) in enumerate(ok):
        if q is not None and q % 20 == 0:
            s = sorted((-int(x @ y), i is None, i or 0, i) for b, (i, y) in enumerate(ok) if a != b and len(x) == len(y))[:5]
            want += [(q, k + 1, t[3], -t[0]) for k, t in enumerate(s)]
    assert got == sorted(want, key=lambda t: t[:2]) or sorted(map(repr, got)) == sorted(map(repr, want))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_takes_every_row(spark):
    rows = [(50, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.9, 0.0]), (None, [2.0, 0.0]), (None, None), (50, [1.0, 0.0]), (0, []), (3, [])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
    got = sorted((r.query_id, r["rank"], r.score, r.vec_id) for r in out.collect())
    one = [(1, 131072, None), (2, 65536, 1), (3, 65536, 50), (4, 58880, 2), (5, 32768, 1)]
    assert got == [(0, 1, 0, 3)] + sorted((50, k, s, v) for k, s, v in one for _ in range(2))


def test_topk_block_reads_lists_and_stops():
    g = np.random.default_rng(4)
    v = np.floor(256 * g.normal(size=(3000, 6)))
    q = np.floor(256 * g.normal(size=(20, 6)))
    a, b, s = topk.search_block(np.arange(20) + 10_000, q, np.arange(3000), np.arange(3000), v, 5)
    for k in range(20):
        full = sorted(zip((-(v @ q[k])).astype(int).tolist(), range(3000), strict=True))[:5]
        assert sorted(zip((-s[a == k]).tolist(), b[a == k].tolist(), strict=True)) == full


def test_topk_block_scores_only_what_the_bounds_leave():
    g = np.random.default_rng(4)
    v = np.floor(256 * g.normal(size=(3000, 2)))
    v[1000:1100] = 2000.0  # more equal ones than FEW: no bound can leave fewer
    scored = []
    _, b, s = topk.search_block(np.array([9000]), np.array([[3.0, 5.0]]), np.arange(3000), np.arange(3000), v, 5, scored=scored)
    assert b.tolist() == [1000, 1001, 1002, 1003, 1004] and set(s) == {16000} and scored == [100]
    v = np.floor(256 * g.normal(size=(2000, 64)))
    scored = []
    topk.search_block(np.arange(40), v[:40], np.arange(2000), np.arange(2000), v, 5, scored=scored)
    assert len(scored) == 40 and max(scored) <= topk.FEW  # before, all 1,999


def components_of(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("block", "leaf", "group"), [(40, 128, 64), (20, 4, 2)])
def test_embedding_dedup(spark, block, leaf, group):
    rows = vectors()
    df = spark.createDataFrame(rows, E).withColumn("v", F.lit(1)).withColumn("rep", F.lit(1)).withColumn("h1", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, block=block, leaf=leaf, group=group).collect()}
    n = len(rows)

    def cos(a, b):
        (_, v, la), (_, w, lb) = rows[a], rows[b]
        if la is None or la != lb or not v or not w or len(v) != len(w) or None in v or None in w:
            return -1
        v, w = np.float32(v).astype(float), np.float32(w).astype(float)
        if not np.isfinite(v).all() or not np.isfinite(w).all() or not v.any() or not w.any():
            return -1
        return v @ w / (np.linalg.norm(v) * np.linalg.norm(w))

    links = [(a, b) for a in range(n) for b in range(a) if cos(a, b) >= 0.98]
    comp = components_of(n, links)
    deg = Counter(x for p in links for x in p)
    assert len(links) > 500
    assert got == {i: (deg[i], comp[i], comp[i] == i) for i in range(n)}
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], E)).count() == 0


def test_topk_beyond_exact_floats(spark):
    rows = [(50, [2.0**40, 1.0, 3.0], 1), (1, [2.0**40, 2.0, 1.0], 1), (2, [2.0**40, 2.0, 2.0], 1), (3, [-(2.0**40), 0.0, 0.0], 1), (4, [1e300, 0.0, 0.0], 1), (5, [-1e300, 0.0, 0.0], 1)]
    got = [(r["rank"], r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    q = [int(256 * x) for x in rows[0][1]]
    score = lambda v: min(max(sum(a * int(np.floor(256 * b)) for a, b in zip(q, v, strict=True)), -(2**63)), 2**63 - 1)
    assert got == [(k, i, s) for k, (s, i) in enumerate(sorted(((score(v), i) for i, v, _ in rows[1:]), key=lambda x: (-x[0], x[1])), 1)]


def test_mixing_targets_of_many_sources(spark):
    r = random.Random(6)
    size = {f"s{k:04d}": r.choice([0, 1, 7, 50, 400]) for k in range(500)} | {None: 90}
    rows = spark.createDataFrame([(s, n) for s, n in size.items()], "source string, source_size long").repartition(7)
    got = {x.source: x.target for x in mixing.targets(rows).collect()}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    want, free, total = {}, set(order), sum(size.values())
    while True:  # those above their limit stop there, the rest shares what is left
        level = (total - sum(want.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > mixing.MOST * size[s]}
        want |= {s: mixing.MOST * size[s] for s in over}
        free -= over
        if not over or not free:
            break
    want |= {s: weight[s] * level for s in free}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(total)
    assert mixing.targets(rows.limit(0)).collect() == []


def test_token_files_of_one_id_and_by_hadoops_schemes(spark, tmp_path):
    rows = [(7, f"text {i}", 1) for i in range(300)] + [(None, f"none {i}", 1) for i in range(300)] + [(1, None, 1), (9, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small shards
    shards = token_files.write_shards(df, f"file://{tmp_path}/tokens")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.count() > 2
    got = sorted(token_files.read_shards(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 300 + [1] + [7] * 300 + [9]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert token_files.SCHEMES["s3a"] == "s3"


def test_embedding_dedup_of_tiny_and_huge_components(spark):
    g = np.random.default_rng(5)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(g.normal(size=(300, 4)))]
    rows += [(400, [1e-170] * 4, 1), (401, [2e-170] * 4, 1), (402, [1e200] * 4, 1), (403, [2e200] * 4, 1), (404, [5e-324] * 4, 1), (405, [1e300, -1e300, 1e300, -1e300], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = lambda v: np.ldexp(v, -np.frexp(np.abs(v).max())[1]) / np.linalg.norm(np.ldexp(v, -np.frexp(np.abs(v).max())[1]))
    u = {i: unit(np.array(v)) for i, v, _ in rows}
    linked = {i: [j for j in u if j != i and u[i] @ u[j] >= 0.98] for i in u}
    assert {i: n for i, (n, _) in got.items()} == {i: len(x) for i, x in linked.items()}
    assert {400, 401, 402, 403, 404} <= set(linked[400]) | {400} and got[403][1] == got[400][1] and got[405][0] == len(linked[405])


def test_blocks_are_joined_recursively():
    """Intervals that are provably far apart are skipped, others are halved down to the leaf; no pair is lost."""
    g = np.random.default_rng(3)
    centres = g.normal(size=(12, 6))
    x = np.concatenate([c + 0.05 * g.normal(size=(25, 6)) for c in centres])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    p = u[:, :3]
    order = np.lexsort(np.floor(p / 0.2).T[::-1])
    x, p = x[order], p[order]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.98), strict=True) if i < j}
    compared = []
    for leaf in (4, 32):
        found = list(embedding_dedup.join_blocks(x, p, x, p, True, 0.98, leaf, compared))
        assert {(int(i), int(j)) for a, b in found for i, j in zip(a, b, strict=True)} == want and len(want) > 300
    assert 0 < compared[0] < len(x) ** 2 / 6  # of about half of all pairs, most lie in skipped intervals


def test_embedding_dedup_of_more_lengths_than_get_directions(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "FITTED", 1)
    g = np.random.default_rng(3)
    rows = []
    for d in (3, 12, 20):
        v = g.normal(size=(30, d))
        v[10:20] = v[:10] * 2 + 0.001
        rows += [(100 * d + i, x.tolist(), 1) for i, x in enumerate(v)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, E), block=8).collect()}
    ids = [i for i, *_ in rows]
    unit = [np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for _, v, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    comp, deg = components_of(len(rows), links), Counter(x for p in links for x in p)
    assert len(links) >= 30 and got == {ids[i]: (deg[i], ids[comp[i]]) for i in range(len(rows))}


def test_language_id(spark, docs, empty):
    r = random.Random(1)
    words = {"en": ["the", "house", "with", "nothing"], "fr": ["été", "maison", "rien", "avec"]}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(20)), k, k, 1) for i in range(300) for k in [("en", "fr")[i % 2]]] + [(900, None, None, None, 1), (901, "12 3 !!", "en", None, 1), (902, "", "fr", None, 1)]
    d = spark.createDataFrame(rows, DOC).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))
    model = language_id.fit(d, ~language_id.held_out())
    assert model[0] == ["en", "fr"]
    got = {x[0]: (x[1], x[2]) for x in language_id.predict(d, model, ["doc_id"]).collect()}
    assert all(got[i][0] == ("en", "fr")[i % 2] for i in range(300)) and got[900] == got[901] == got[902] == ("und", 0.0)
    held = {x.doc_id: x.h for x in d.select("doc_id", language_id.held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items())
    # scores are those of the plain formula
    langs, m = model
    text = rows[0][1]
    grams = language_id.ngrams([text])[0]
    s = np.float32(m).astype(float)[grams].sum(0)
    assert got[0][1] == pytest.approx(1 / np.exp(s - s.max()).sum())
    assert set(language_id.predict(docs, language_id.fit(empty, F.lit(True)), ["doc_id"]).toPandas()["lang_pred"]) == {"und"}
    assert language_id.predict(empty, model, ["doc_id"]).count() == 0
    # marks alone are no letters; letters of late planes are
    odd = spark.createDataFrame([(0, "\u0301\u0302 1"), (1, "\U00030000"), (2, "\U000323ac 2"), (3, "\U0001f600"), (4, "e\u0301")], "doc_id long, text string")
    got = {x[0]: x[1] for x in language_id.predict(odd, model, ["doc_id", "text"]).select("doc_id", "lang_pred").collect()}
    assert got[0] == got[3] == "und" and "und" not in (got[1], got[2], got[4])


def test_language_id_refuses_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGS", 3)
    d = spark.createDataFrame([(i, "word", str(i), None, 1) for i in range(4)], DOC)
    with pytest.raises(ValueError):
        language_id.fit(d, F.lit(True))


def test_language_stage_rejects_languages_that_were_not_learned(spark):
    r = random.Random(2)
    words = {k: ["".join(r.choice(s) for s in (c, v, c, v)[: r.randint(2, 4)]) for _ in range(200)] for k, c, v in (("aa", "bdgklmnprst", "aeiou"), ("bb", "cfhjqvwxz", "äéíöü"))}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(r.choice((3, 40)))), k, None, 1) for i in range(300) for k in [("aa", "bb")[i % 2]]]
    foreign = ["Это предложение написано на русском языке, и его никто не должен принять за другой.", "これは日本語で書かれた文章です。誰も他の言語と間違えてはいけません。", "strengths thy rhythm crypt pschtt hymns nymphs " * 5]
    foreign.append(" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)))
    rows += [(1000 + i, t, None, None, 1) for i, t in enumerate(foreign)] + [(2000, "12 ?", None, None, 1)]
    kept = {x.doc_id for x in language_id.stage_language_id(spark, spark.createDataFrame(rows, DOC), "").collect()}
    assert kept == set(range(300))


def plain_sets(rows, words):
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset([tuple(w)] if 0 < len(w) < words else [tuple(w[k : k + words]) for k in range(len(w) - words + 1)] if w else [])))
    return out


@pytest.mark.parametrize("words", [4, 5])
def test_minhash(spark, docs, empty, words):
    rows = documents()
    sets = plain_sets(rows, words)
    ids = sorted({i for i, _ in sets})
    pos = {i: k for k, i in enumerate(ids)}
    links = [(pos[i], pos[j]) for i, a in sets for j, b in sets if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b)]
    comp = components_of(len(ids), links)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.duplicates(docs.withColumn("sig", F.lit(1)), words=words, chunk=4).collect())
    assert got == sorted((i, len(s), ids[comp[pos[i]]], ids[comp[pos[i]]] == i) for i, s in sets)
    assert minhash_dedup.duplicates(empty).count() == 0


def test_minhash_large_families(spark):
    """Stars of one text, a chain whose ends aren't similar, and texts that share bands without a link, in small chunks."""
    r = random.Random(11)
    rows, base = [], sentence(r, 90).split()
    for k in range(40):  # near copies of one text, linked with it or only with each other
        x = list(base)
        for at in r.sample(range(90), k % 6):
            x[at] = f"w{k}x{at}"
        rows.append((1000 - k, " ".join(x), "en", "a", 1))
    chain = list(base)
    for k in range(40):  # each differs from the one before by a word
        chain[(2 * k) % 90] = f"c{k}"
        rows.append((2000 + (k * 7) % 40, " ".join(chain), "en", "a", 1))
    other = base[:60] + sentence(r, 40).split()
    for k in range(20):  # a star of its own that shares two thirds with the first
        x = list(other)
        x[r.randrange(70, 100)] = f"o{k}"
        rows.append((3000 + k, " ".join(x), "en", "a", 1))
    sets = plain_sets(rows, 5)
    ids = sorted(i for i, _ in sets)
    pos = {i: k for k, i in enumerate(ids)}
    linked = [(pos[i], pos[j]) for i, a in sets for j, b in sets if i < j and 100 * len(a & b) >= 80 * len(a | b)]
    comp = components_of(len(ids), linked)
    df = spark.createDataFrame(rows, DOC).repartition(3)
    for chunk in (3, 8):
        got = {x.doc_id: x.component_id for x in minhash_dedup.duplicates(df, chunk=chunk).collect()}
        assert got == {i: ids[comp[pos[i]]] for i in ids}
    assert len(set(comp)) > 1


def test_minhash_cutoffs():
    """No pair of similarity 0.8 is pruned with more than the chosen chance in a batch."""
    from math import comb

    for n, m in zip(range(16, 97, 16), minhash_dedup.cutoffs(0.8), strict=True):
        assert sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m)) < 1e-5
    assert minhash_dedup.cutoffs(0.8)[-1] > 40


def test_token_files(spark, docs, empty, tmp_path):
    lib = encoder.encoder(encoder.default_path()).library
    shards = token_files.write_shards(docs, f"file://{tmp_path}")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_shards(shards).collect())
    want, start = [], 0
    for i, t, *_ in sorted(documents(), key=lambda x: (x[0], x[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.read_shards(token_files.write_shards(empty, f"file://{tmp_path}/none")).count() == 0
    # one document alone; a damaged frame is noticed; other decoders read the frames
    import pyarrow as pa
    import zstandard

    path = sorted(tmp_path.glob("*.tok"))[0]
    raw = bytearray(path.read_bytes())
    reader = token_files.ShardReader(pa.BufferReader(bytes(raw)))
    k = len(reader.doc_ids) - 1
    assert reader.read(k)[-1] == 0
    assert zstandard.ZstdDecompressor().decompress(bytes(raw[: int(reader.sizes[0])])) == reader.read(0).astype("<u2").tobytes()
    raw[int(reader.starts[k]) + int(reader.sizes[k]) - 1] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.ShardReader(pa.BufferReader(bytes(raw))).read(k)


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, free = float(sum(sizes.values())), dict.fromkeys(sizes, 0.0), set(sizes)
    while free:
        rest = total - sum(target[s] for s in sizes if s not in free)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        target |= share
        for s in over:
            target[s] = 3.0 * sizes[s]
        if not over:
            break
        free -= over
    return target


MIX = r"""
WITH k AS (SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / w AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS wt FROM s),
v AS (SELECT *, 3 * source_size / wt AS ratio FROM w),
x AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0)) / (sum(wt) OVER () - coalesce(sum(wt) OVER b, 0)) AS lev
      FROM v WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT first(lev ORDER BY ratio, source NULLS LAST) AS lev FROM x WHERE lev <= ratio),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, l.lev * wt) AS target FROM v, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size + 1e-9)) ELSE 0 END AS epochs FROM t),
c AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id::VARCHAR NULLS FIRST, k.size, k.r ROWS UNBOUNDED PRECEDING) AS run
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs + CASE WHEN epochs < 3 AND run - size / 2.0 <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM c
"""


def mixed_by_sql(rows):
    """What the mix is by plain SQL, one running sum a source: rows of doc_id, source, size, weight."""
    import duckdb
    import pandas as pd

    d = pd.DataFrame([(k, *r) for k, r in enumerate(rows)], columns=["r", "doc_id", "source", "size", "w"]).astype({"doc_id": "Int64"})
    c = duckdb.connect()
    c.register("given", d)
    c.execute("CREATE TABLE d AS SELECT r, doc_id, source, size::BIGINT AS size, w::DOUBLE AS w FROM given")
    return c.execute(MIX).fetchall()


def mixed(spark, rows):
    df = spark.createDataFrame([r for r in rows], "doc_id long, source string, size long, w double").withColumn("target", F.lit("clash")).withColumn("last", F.lit("clash")).repartition(7)
    out = mixing.mix(df, F.col("size"), F.col("w"))
    return [(r.doc_id, r["size"], r["__source_size"], r["__target"], r["__copies"]) for r in out.collect()]


def same_mix(a, b):
    r = lambda x: sorted(repr((*t[:3], round(float(t[3]), 6), t[4])) for t in x)
    return r(a) == r(b)


def test_mixing_against_sql(spark):
    r = random.Random(8)
    rows = [(i, r.choice(["a", "b", "b", "ü", None]), r.choice([0, 1, r.randint(1, 500)]), r.choice([1.0, 0.5, round(r.random(), 4) + 1e-4])) for i in range(800)]
    rows += rows[:40]
    assert same_mix(mixed(spark, rows), mixed_by_sql(rows))
    # repeated rows, and rows without an id, are taken one by one; a tie may end the mix in its middle
    hot = [(7, "a", 10, 0.5)] * 600 + [(None, "b", 3, 1.0)] * 500 + [(i, "c", 40, 1.0) for i in range(100, 150)] + [(8, "a", 0, 1.0)] * 30
    got = mixed(spark, hot)
    assert same_mix(got, mixed_by_sql(hot))
    assert {t[4] for t in got if t[0] == 7} == {0, 1} or {t[4] for t in got if t[0] == 7} == {1, 2}
    words = lambda i: sum(t[1] * t[4] for t in got if t[0] == i)
    assert abs(words(7) - next(t[3] for t in got if t[0] == 7)) <= 10
    assert mixed(spark, []) == [] and all(t[4] == 0 for t in mixed(spark, [(1, "a", 0, 1.0)]) if t[1])


def test_mixing(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")

    def run():
        seen = quality.judged(docs.withColumn("__n", F.lit(0)).withColumn("source_size", F.lit("clash")), labels, ["doc_id", "source"])
        return mixing.mix(seen, F.col("__words"), F.col("__good")).toPandas()

    out, again = run(), run()
    key = ["doc_id", "source", "__size", "__copies"]
    assert sorted(map(repr, out[key].values.tolist())) == sorted(map(repr, again[key].values.tolist()))
    rows = documents()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").encode().split())
    target = water(sizes)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for s, part in out.groupby(out["source"].fillna("-")):
        s = None if s == "-" else s
        assert set(part["__source_size"]) == {sizes[s]} and part["__target"].iloc[0] == pytest.approx(target[s])
        taken = (part["__size"] * part["__copies"]).sum()
        assert part["__copies"].max() <= 3 and abs(taken - target[s]) <= part["__size"].max()
        assert part["__copies"].max() - part["__copies"].min() <= 1  # complete epochs come first
    assert len(out) == len(rows)
    assert mixing.mix(quality.judged(empty, labels, ["doc_id", "source"]), F.col("__words"), F.col("__good")).count() == 0


def test_mixing_prefers_heavy_documents():
    """Over many seeds a key -ln(u)/w comes first with a chance in proportion to w."""
    g = np.random.default_rng(0)
    w = np.array([1.0, 3.0])
    first = (-np.log(g.random((20_000, 2))) / w).argmin(1).mean()
    assert first == pytest.approx(0.75, abs=0.02)


def test_pieces(spark, docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    rows = [t for _, t, *_ in documents()] + ODD + [" a", "a ", "  ", "x  y", "日本 語", "😀", "▁", "a▁b", "aaaa" * 30]
    m = pieces.PieceModel.load(pieces.default_path())
    for remembered in (400, 64_000_000):
        m.spell.memory.most = remembered
        got = spelled(m.encode, rows)
        assert got == [sp.encode(t or "") for t in rows]
    assert [m.decode(np.array(x, np.int64)) for x in got] == [sp.decode(x) for x in got]
    out = pieces.digest(docs.withColumn("n_pieces", F.lit("clash")), ["doc_id"])
    assert out.count() == len(documents())
    back = pieces.decode(pieces.encode(docs, ["doc_id"]), ["doc_id"]).toPandas()
    want = {i: (t or "").replace("▁", " ") for i, t, *_ in documents()}
    assert all(want[i] == t for i, t in zip(back["doc_id"], back["text"], strict=True))
    assert pieces.digest(empty, ["doc_id"]).count() == 0


def test_pieces_unigram_is_the_best_sum():
    plain = {"▁": -3.0, "▁a": -2.0, "a": -2.5, "b": -2.5, "ab": -3.0, "▁ab": -6.0, "ba": -4.6, "bab": -7.2}
    names = ["<unk>", *plain]
    m = pieces.PieceModel(names, [0.0, *plain.values()], {}, 0, False, set(range(1, len(names))))

    def best(w):
        if not w:
            return 0.0, []
        return max((plain[w[:n]] + best(w[n:])[0], [w[:n], *best(w[n:])[1]]) for n in range(1, len(w) + 1) if w[:n] in plain)

    for t in ("ab", "abab", "a ba bab", "babab aab"):
        ids = spelled(m.encode, [t])[0]
        score = sum(m.scores[i] for i in ids)
        assert "".join(names[i] for i in ids) == "▁" + t.replace(" ", "▁")
        assert score == pytest.approx(sum(best("▁" + w)[0] for w in t.split(" ")))


def test_components(spark):
    from momentlake.llm.components import components

    r = random.Random(2)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(500, 500 + k) for k in range(100)] + [(700 + k, 701 + k) for k in range(60)]
    comp = components_of(800, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: comp[i] for i in touched}


def plain_pipeline(spark, rows, labels):
    """What the pipeline returns, by plain loops, the library and one SQL statement."""
    import sentencepiece

    frame = lambda x: spark.createDataFrame(x, DOC)
    langs, m = language_id.fit(frame(rows), ~language_id.held_out())
    m = np.asfortranarray(m, np.float32)
    best, p, mean, n = language_id.evidence([t or "" for _, t, *_ in rows], langs, m)
    ok = (best >= 0) & (p >= 0.5) & language_id.Clear(m)(best, mean, n)
    first = [x for x, k in zip(rows, ok, strict=True) if k]
    good = plain_posteriors(first, quality.fit(frame(first), labels))
    second = [x for x, (g, *_) in zip(first, good, strict=True) if g >= quality.KEEP]
    sets = [s for _, s in plain_sets(second, 5)]
    links = [(a, b) for a in range(len(second)) for b in range(a) if sets[a] and sets[b] and (second[a][0] == second[b][0] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))]
    links = [(a, b) for a, b in links if second[a][0] is not None and second[b][0] is not None]
    comp = components_of(len(second), links)
    groups = {}
    for k, c in enumerate(comp):
        groups.setdefault(c, []).append(k)
    third = [second[min(g, key=lambda k: (second[k][0] is None, second[k][0] or 0))] for g in groups.values()]
    weights = plain_posteriors(third, quality.fit(frame(third), labels))
    size = [len((t or "").encode().split()) for _, t, *_ in third]
    rounded = [max(np.floor(g / mixing.LEAST + 0.5) * mixing.LEAST, mixing.LEAST) for g, *_ in weights]
    copies = {(r[0], r[1]): r[4] for r in mixed_by_sql([(x[0], x[3], s, w) for x, s, w in zip(third, size, rounded, strict=True)])}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    return [(x[0], x[3], sp.encode(x[1] or "")) for x, s in zip(third, size, strict=True) for _ in range(copies[x[0], s])]


def test_pipeline_equals_plain_loops(spark, tmp_path):
    import corpus_pipeline

    d = f"file://{tmp_path}"
    r = random.Random(31)
    rows = [x for x in documents() if x[0] not in (300, 301)] + [(400 + k, " ".join(w.upper() + "!!" for w in sentence(r, 50).split()), "en", r.choice(["a", "b", "ü"]), 1) for k in range(30)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(400 + k, 0, 0) for k in range(15)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(rows, DOC).repartition(4).write.parquet(f"{d}/documents.parquet")
    got = [(x.doc_id, x.source, list(x.pieces)) for x in corpus_pipeline.run(spark, d).collect()]
    want = plain_pipeline(spark, rows, labels)
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and 0 < len({x[0] for x in got}) < len(rows)
    assert not {200, 201, 202, 205} & {x[0] for x in got}  # no letter, no language
    assert not {400 + k for k in range(30)} & {x[0] for x in got}  # shouting, as the labels say
    assert {100, 101, 102} & {x[0] for x in got} == {100}


def test_stages_handle_odd_tables(spark, tmp_path):
    import corpus_pipeline

    d = f"file://{tmp_path}"
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    names = ["c0", "k0", "source_size", "target", "score", "lang_pred", "n_shingles", "component_id", "kept", "rank", "step", "host", "path", "__gone"]
    r = random.Random(2)
    rows = [(None if i % 9 == 0 else i, None if i % 11 == 0 else sentence(r, 30), "en", None if i % 7 == 0 else "s", 1) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:5], DOC)
    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, df.limit(0), d)
        assert none.count() == 0, name
        out = stage(spark, df, d)
        if name != "pieces":
            assert out.columns == df.columns and none.columns == df.columns and set(out.select("target").distinct().toPandas()["target"]) <= {"clash"}, name
        assert out.filter("doc_id IS NULL").count() > 0, name  # rows without an id go their way
    once = corpus_pipeline.STAGES[2][1](spark, df, d).filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").count()
    assert once == 0


def test_pipeline_stages(spark, docs, empty, tmp_path):
    import corpus_pipeline

    d = f"file://{tmp_path}"
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs.write.parquet(f"{d}/documents.parquet")
    out = corpus_pipeline.run(spark, d)
    assert out.columns == ["doc_id", "source", "pieces"] and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "minhash_dedup", "mixing", "pieces"]
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, d).columns == docs.columns
    once = [r.doc_id for r in minhash_dedup.stage_dedup(spark, docs, d).collect()]
    assert len(once) == len(set(once)) and {100, 101} & set(once) == {100}
    assert json.dumps(out.schema.jsonValue())
