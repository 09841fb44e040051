"""HTML extraction (3) by site template removal.

1. Every page is parsed into a tree.  Each block's subtree, whatever it is called, is hashed (tag, attributes, text and the
   hashes of its children), and Spark counts per host in how many different bodies each hash occurs: a body is the text
   that is read of a page, without the subtree itself.
2. Subtrees that occur in at least MIN_BODIES different bodies of their host are the site's template and are deleted.
   What a page's own count can't tell, such as a menu with other entries on each page, is deleted by what it is:
   navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, by tag, role, or a
   whole class or id.  No name drops what holds the page's main, its only articles or most of its text.
3. What is left of the article (or of the body, where a page has no article or main element) is read as blocks.

Plain prose of an article (a paragraph or quotation without class and id) is never counted: an author's or licence line
recurs on a host without being its template.  A story that a host publishes on many pages is no template either: around
each of its parts the body is the same.  Near copies of it have bodies that differ, but have most shingles (three words of
a string) in common; so bodies are also counted by the least hash of their shingles, by the mean over HASHES hashes, which
bodies of similarity s share with a chance of s: of MIN_BODIES bodies or more, a quarter are to differ in it.

Defined results: null or empty html gives an empty text; a null url makes a host of its own; repeated rows count
once; unclosed and stray tags are repaired as browsers do in the common cases, elements more than DEPTH deep are siblings;
parsing takes time in proportion to the page; character references are decoded once; other columns are ignored.
"""

from __future__ import annotations

import html as H
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.llm.common import broadcast_rows, cut, ship, table

#: A subtree is template if it occurs in so many different bodies of its host, whatever the host's size.
MIN_BODIES = 10
#: Of the different bodies, this share is to differ in the least hash of its shingles too, in the mean over HASHES.
OWN_SHARE = 1 / 4
HASHES = 8
_TURNS = np.random.default_rng(3).integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
#: Prose and blocks without a name are counted if they have so many characters.
MIN_CHARS = 20

#: Elements stand in one another at most so deep.
DEPTH = 512

_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_IN_TAG = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li", "legend", "figcaption"}
#: Blocks that may be template as a whole; those of prose are only counted if they are long enough.
_UNITS = _BLOCK - set("html body article main h1 h2 h3 h4 h5 h6 hgroup hr caption td th tr tbody thead tfoot li dt dd figcaption legend summary".split())
_PROSE = {"p", "pre", "blockquote", "address", "center"}
#: An opening tag ends these if one is open within the given bounds.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_DROP_TAGS = set("head nav header footer aside form script style noscript template iframe svg button select input textarea option dialog embed audio video applet menu noembed noframes xmp title".split())
_DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_DROP_WORDS = set(
    "ad ads advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond replies share sharing social related recommended recommendations widget pagination pager toolbar skip".split()
)
#: Words of what readers write, which may well be longer than the article.
_REPLIES = {"comment", "comments", "commentlist", "disqus", "respond", "replies"}
_SPLIT = re.compile(r"[^a-z0-9]+")


class _Node:
    """size: characters of text, without what is boilerplate by its tag; holds: 2 a main, 1 an article, 0 neither."""

    __slots__ = ("tag", "attrs", "items", "size", "holds", "drops")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.items = tag, attrs, []
        self.size = self.holds = 0
        self.drops: list[bool | None] = [None, None]  # what boilerplate() said, without and with spare


def _measured(root: _Node) -> _Node:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.items if isinstance(x, _Node)]
    for node in reversed(order):  # children before parents
        node.holds = {"main": 2, "article": 1}.get(node.tag, 0)
        for x in node.items:
            if isinstance(x, str):
                node.size += len(" ".join(x.split()))
            elif x.tag not in _DROP_TAGS or x.tag == "form":
                node.size += x.size
                node.holds = max(node.holds, x.holds)
    return root


class _Scanner:
    """The tags of a text, one after another; every character is looked at a bounded number of times."""

    def __init__(self, text: str):
        self.text, self.last = text, {q: text.rfind(q) for q in ("\"", "'", "]]>", "-->")}

    def end(self, at: int) -> int:
        """Where the tag's > is, beyond quoted values; -1 without one.  A quote that isn't closed is a character."""
        text = self.text
        while m := _IN_TAG.search(text, at):
            q = m[0]
            if q == ">":
                return m.start()
            at = text.index(q, m.end()) + 1 if m.start() < self.last[q] else m.end()
        return -1

    def skip(self, at: int) -> int:
        """Where the comment, declaration or section that begins at `at` ends; -1 if it takes the rest."""
        text = self.text
        for mark, close in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if text.startswith(mark, at):
                if at < self.last[close]:
                    return text.index(close, at) + 3
                if mark == "<!--":
                    return -1
        return text.find(">", at) + 1 or -1


class _Stack:
    """The elements that are open, and how many there are of each tag."""

    def __init__(self, root: _Node):
        self.nodes, self.open = [root], Counter()

    def push(self, node: _Node) -> None:
        if len(self.nodes) <= DEPTH:
            self.nodes.append(node)
            self.open[node.tag] += 1

    def cut(self, k: int) -> None:
        self.open.subtract(x.tag for x in self.nodes[k:])
        del self.nodes[k:]

    def close(self, tag: str) -> None:
        """An end tag; an inline one doesn't end the block that it stands in."""
        if self.open[tag] <= 0:
            return
        for k in range(len(self.nodes) - 1, 0, -1):
            if self.nodes[k].tag == tag:
                return self.cut(k)
            if tag not in _BLOCK and self.nodes[k].tag in _BLOCK:
                return

    def begin(self, tag: str) -> None:
        """What an opening tag ends."""
        if tag in _CLOSES_P and self.open["p"] > 0:
            for k in range(len(self.nodes) - 1, 0, -1):
                if self.nodes[k].tag == "p":
                    self.cut(k)
                    break
                if self.nodes[k].tag in _BLOCK:
                    break
        if tag in _ENDS:
            ended, bounds = _ENDS[tag]
            for k in range(len(self.nodes) - 1, 0, -1):
                if self.nodes[k].tag in bounds or not any(self.open[x] > 0 for x in ended):
                    break
                if self.nodes[k].tag in ended:
                    self.cut(k)


def parse(text: str) -> _Node:
    """A tree of nodes whose items are strings (decoded) and nodes."""
    root = _Node("", "")
    stack, scan = _Stack(root), _Scanner(text)
    at, end = 0, len(text)
    while at < end:
        top = stack.nodes[-1]
        m = _OPEN.search(text, at)
        if m is None:
            top.items.append(H.unescape(text[at:]))
            break
        if m.start() > at:
            top.items.append(H.unescape(text[at : m.start()]))
        at = m.end()
        name = _NAME.match(text, at)
        if name is None:  # a comment, a declaration, or an end tag without a name
            at = scan.skip(m.start())
            if at < 0:
                break
            continue
        close, tag = name[1], name[2].lower()
        stop = scan.end(name.end())
        if stop < 0:
            break
        at = stop + 1
        if close:
            stack.close(tag)
            continue
        stack.begin(tag)
        node = _Node(tag, text[name.end() : stop].strip())
        stack.nodes[-1].items.append(node)
        if tag in _VOID or node.attrs.endswith("/") and tag not in _BLOCK and tag not in _RAW:
            continue
        if tag in _RAW:
            closed = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(text, at)
            stop = closed.start() if closed else end
            raw = text[at:stop]
            node.items.append(H.unescape(raw) if tag in ("title", "textarea") else raw)
            at = text.find(">", stop) + 1 if closed else end
            at = at or end
            continue
        if tag == "plaintext":
            node.items.append(text[at:])
            break
        stack.push(node)
    return _measured(root)


def attributes(node: _Node) -> dict[str, str]:
    return {k.lower(): H.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(node.attrs)}


def named(names: str) -> bool:
    """Whether a class or id of these is a listed word as a whole, or made of such words only (cookie-banner)."""
    for token in names.lower().split():
        parts = [x for x in _SPLIT.split(token) if x]
        if parts and _DROP_WORDS.issuperset(parts):
            return True
    return False


def boilerplate(node: _Node, root: _Node, spare: bool = False) -> bool:
    """As _boilerplate, asked once."""
    known = node.drops[spare]
    if known is None:
        known = node.drops[spare] = _boilerplate(node, root, spare)
    return known


def _boilerplate(node: _Node, root: _Node, spare: bool) -> bool:
    """Whether the element is none of the article by its tag, role, class or id.

    No name drops an element that holds a main or more than half of the page's text (readers' comments may be more
    than half), nor, with spare, one that holds an article.  A form may be around a whole page, so it counts as a name.
    """
    if node.tag in _DROP_TAGS and node.tag != "form":
        return True
    if node.tag in ("html", "body", "main") or not node.attrs and node.tag != "form":
        return False
    a = attributes(node) if node.attrs else {}
    names = f"{a.get('class', '')} {a.get('id', '')}"
    role = a.get("role", "").lower()
    if node.tag == "article":  # a comment, a teaser or an advert
        by_name = named(f"{role} {names}")
    else:
        by_name = node.tag == "form" or role in _DROP_ROLES or named(names)
    if not by_name or node.holds == 2 or spare and node.holds:
        return False
    return 2 * node.size <= root.size or not _REPLIES.isdisjoint(_SPLIT.split(names.lower()))


def heads_of(root: _Node) -> tuple[list[_Node], bool]:
    """The outermost article and main elements that are read, and whether names had to spare what holds an article.

    They have to where there would be no article or main else.  Without any the page is read as a whole.
    """
    for spare in (False, True):
        heads: list[_Node] = []
        todo = [root]
        while todo:
            node = todo.pop()
            if node is not root and boilerplate(node, root, spare):
                continue
            if node.tag in ("article", "main"):
                heads.append(node)
                continue
            todo += [x for x in reversed(node.items) if isinstance(x, _Node)]
        if heads or not root.holds:
            break
    return heads, spare


def subtrees(root: _Node, bodies: bool = True) -> dict[int, tuple]:
    """id(node) -> (hash, hash of the surrounding body, and HASHES least hashes of its shingles) of each element subtree
    that the count may delete, also of those that a name drops.  Without bodies: (hash,).

    These are whole blocks, no phrases, headings, cells or items: a term set in italics, a section title or a table's
    zero recurs in different articles without being template; nor is plain prose inside of an article.  Blocks without
    class and id are to have MIN_CHARS characters.  The body is the text that is read of the page, without what is
    boilerplate by its name and without the subtree; its hash is a sum over its strings, from which a subtree's own part can
    be taken away, and strings are in the order in which a subtree's are neighbours, so that the least hash beside them is
    that of what stands before and of what comes after.
    """
    heads, spare = heads_of(root)
    tops = {id(x) for x in heads}
    strings: list[int] = []  # hashes of what is read, in the order of the page
    hashes: list[int] = []  # and of their words, those of string k from begins[k]
    begins: list[int] = []
    found: dict[int, tuple[int, int, int]] = {}  # hash, and where the strings that are read begin and end
    size: dict[int, int] = {}
    holds: set[int] = set()
    candidates: list[tuple[_Node, bool]] = []
    todo: list = [(root, False, not heads, None)]  # node, inside an article, read, its begin once its children are done
    while todo:
        node, inside, read, begin = todo.pop()
        if begin is None:
            if node is not root and read and boilerplate(node, root, spare):
                read = False
            elif id(node) in tops:
                inside = read = True
            todo.append((node, inside, read, len(strings)))
            for x in reversed(node.items):
                todo.append((x, inside, read, None) if isinstance(x, _Node) else (x, inside, read, -1))
            continue
        if begin < 0:
            if not read or not bodies:
                continue
            words = node.encode("utf-8", "surrogatepass").split()
            if words:
                strings.append(xxhash.xxh64_intdigest(b" ".join(words)))
                begins.append(len(hashes))
                hashes += map(xxhash.xxh32_intdigest, words)
            continue
        h = xxhash.xxh64(f"<{node.tag} {node.attrs}>")
        n = 0
        for x in node.items:
            if isinstance(x, str):
                t = " ".join(x.split())
                if t:
                    n += len(t)
                    h.update(xxhash.xxh64_digest(t.encode("utf-8", "surrogatepass")))
            else:
                n += size[id(x)]
                h.update(found[id(x)][0].to_bytes(8, "little"))
                if id(x) in holds or x.tag in ("article", "main"):
                    holds.add(id(node))
        size[id(node)] = n
        found[id(node)] = h.intdigest(), begin, len(strings)
        if n and id(node) not in holds and _counted(node, n, inside):
            candidates.append((node, inside))
    if not candidates or not bodies:
        return {id(node): found[id(node)][:1] for node, _ in candidates}
    m = len(strings)
    total = [0]
    for x in strings:
        total.append(total[-1] + x)
    # least hashes by string, and of the strings before each and from each on
    none = np.full((1, HASHES), 2**32, np.uint64)
    least = np.minimum.reduceat((_shingles(hashes, begins)[:, None] * _TURNS) >> np.uint64(32), begins) if m else none[:0]
    before = np.concatenate([none, np.minimum.accumulate(least)])
    after = np.concatenate([np.minimum.accumulate(least[::-1])[::-1], none])
    out = {}
    for node, _ in candidates:
        h, a, z = found[id(node)]
        out[id(node)] = h, (total[m] - total[z] + total[a]) % 2**64, *np.minimum(before[a], after[z]).tolist()
    return out


def _shingles(words: list[int], begins: list[int]) -> np.ndarray:
    """A hash of each word and the two after it in its string, of fewer at its end."""
    out, w = np.zeros((3, len(words)), np.uint64), np.array(words, np.uint64) + np.uint64(1)
    string = np.zeros(len(words), np.int64)
    string[begins] = 1
    string = np.cumsum(string)
    out[0] = w
    for k in (1, 2):
        out[k, :-k] = np.where(string[k:] == string[:-k], w[k:], 0)
    out = (out * _TURNS[:3, None]).sum(0, dtype=np.uint64)
    return out ^ (out >> np.uint64(29))


def _counted(node: _Node, size: int, inside: bool) -> bool:
    if node.tag == "li":  # an entry of a menu
        return not inside and all(x.tag == "a" if isinstance(x, _Node) else not x.strip() for x in node.items)
    if node.tag not in _UNITS:
        return False
    is_named = bool(node.attrs) and not {"class", "id"}.isdisjoint(attributes(node))
    if node.tag in _PROSE:
        return size >= MIN_CHARS and (is_named or not inside)
    return size >= MIN_CHARS or is_named


def _read(root: _Node, template: set[int] | None = None, hashes: dict[int, tuple] | None = None) -> str:
    heads, spare = heads_of(root)
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    for head in heads or [root]:
        stack: list = [iter((head,))]
        ends: list[bool] = [False]
        while stack:
            x = next(stack[-1], None)
            if x is None:
                stack.pop()
                if ends.pop():
                    close()
            elif isinstance(x, str):
                run.append(x)
            elif x.tag == "br":
                run.append(" ")
            elif x is not root and (boilerplate(x, root, spare) or (template and hashes.get(id(x), (None,))[0] in template)):
                if x.tag in _BLOCK:
                    close()
            else:
                block = x.tag in _BLOCK
                if block:
                    close()
                stack.append(iter(x.items))
                ends.append(block)
        close()
    return "\n".join(blocks)


def main_text(root: _Node, template: set[int] | None = None, hashes: dict[int, tuple] | None = None) -> str:
    """The blocks of the article, joined by line breaks; template: hashes of subtrees to delete."""
    return _read(root, template, hashes)


def _key(host: str | None, h: int) -> int:
    """A hash of host and subtree as a signed 64-bit integer."""
    return int(np.uint64(xxhash.xxh64_intdigest(f"{host}|{h}")).astype(np.int64))


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """key of every subtree that recurs in many different bodies of its host."""
    ship(pages.sparkSession)

    def packed(batches):
        keys, bodies, leasts = [], [], []
        least = [f"l{k}" for k in range(HASHES)]

        def full():
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, bodies, *zip(*leasts, strict=True))], ["key", "body", *least])

        for b in batches:
            for host, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for h, body, *own in set(subtrees(parse(text or "")).values()):
                    keys.append(_key(host, h))
                    bodies.append(body - 2**63)
                    leasts.append(own)
                if len(keys) > 50_000:
                    yield full()
                    keys, bodies, leasts = [], [], []
        if keys:
            yield full()

    src = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string"))
    # a row for each different body first, so that no key of a large host is one task's
    seen = src.mapInArrow(packed, "key long, body long, " + ", ".join(f"l{k} long" for k in range(HASHES))).distinct()
    own = seen.select("key", F.posexplode(F.array(*[f"l{k}" for k in range(HASHES)])).alias("k", "least"))
    own = own.groupBy("key", "k", "least").agg(F.count("*").alias("n")).groupBy("key", "k").agg(F.sum("n").alias("n"), F.count("*").alias("own"))
    seen = own.groupBy("key").agg(F.max("n").alias("n"), F.avg("own").alias("own"))
    return seen.filter((F.col("n") >= MIN_BODIES) & (F.col("own") >= OWN_SHARE * F.col("n"))).select("key")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    spark = pages.sparkSession
    template = cut(templates(pages), "templates")
    src = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    schema = "page_id long, url string, text string, n_chars long"
    names = ["page_id", "url", "text", "n_chars"]

    def texts(b, sets):
        out = []
        for k, (host, text) in enumerate(zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True)):
            root = parse(text or "")
            hashes = subtrees(root, bodies=False) if sets(k) else {}
            hit = {h for h in {h for h, *_ in hashes.values()} if _key(host, h) in sets(k)}
            out.append(main_text(root, hit, hashes))
        return pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names)

    if template.limit(broadcast_rows(template) + 1).count() <= broadcast_rows(template):
        sent = spark.sparkContext.broadcast(frozenset(template.toArrow()["key"].to_pylist()))

        def run(batches):
            for b in batches:
                yield texts(b, lambda k: sent.value)

        return src.mapInArrow(run, schema)

    # more templates than may be broadcast: each page gets its own by two joins
    def keys(batches):
        for b in batches:
            rows = [[_key(host, h) for h in {h for h, *_ in subtrees(parse(text or ""), bodies=False).values()}] for host, text in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page"), pa.array(rows, pa.list_(pa.int64()))], ["page", "keys"])

    src = src.withColumn("page", F.xxhash64("page_id", "url", "html"))
    own = src.select("page", "host", "html").mapInArrow(keys, "page long, keys array<long>").select("page", F.explode("keys").alias("key")).distinct()
    hits = own.join(template, "key", "left_semi").groupBy("page").agg(F.collect_list("key").alias("keys"))
    joined = src.join(hits, "page", "left")

    def run_joined(batches):
        for b in batches:
            own = [set(x or ()) for x in b.column("keys").to_pylist()]
            yield texts(b, own.__getitem__)

    return joined.mapInArrow(run_joined, schema)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_text": op3_html_text}
