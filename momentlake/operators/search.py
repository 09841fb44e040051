"""Search: filters, dense and text ranks, their fusion, moments, live observations and answers about whole recordings.

The vector and the text of a query are values of the driver: they become literals of the plan, so that no unit is
joined with a query.  Every filter comes before the ranks and reaches the scan; a rank is a top-k and a window over its
rows; fused rows, few, are joined back to the units for their content.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentlake.errors import Refused, UnknownOption
from momentlake.functions import text as T
from momentlake.functions import times
from momentlake.functions import vectors as V
from momentlake.functions.stems import english
from momentlake.lineage import cut
from momentlake.operators import grid as G
from momentlake.operators.numbering import same

RRF_K = 60
#: A moment's score: 1 / (MOMENT_K + best rank) + SECOND / (MOMENT_K + second rank).
MOMENT_K, SECOND = 10, 0.5
#: What aggregate answers are searched by, coarse to fine.
LEVELS = ("source", "span", "entity")
UNIT = ["video_id", "chunk_id", "sampler_id"]
SEEN = ["video_id", "frame_index", "sampler_id"]
ITEM = ["source_id", "aggregate_id", "item_id"]


def scope_of(video_id: str | Iterable[str] | None) -> list[str]:
    """The recordings to search, from one id or several; blank ones don't count, and none means every one."""
    given = [video_id] if isinstance(video_id, str) else list(video_id or ())
    return [v for v in given if v]


@dataclass(frozen=True)
class SearchRequest:
    """What to look for.  Empty filters don't filter.

    sampler_id is one pairing, question the question whoever asked it, sampler all that one sampler gave.  after, before
    (media seconds) and chunk_ids name chunks, `window` adds their neighbours.  stemmed: words of a text match by their
    English stems."""

    limit: int = 5
    candidates: int = 20
    embedder: str | None = None
    video_ids: str | Iterable[str] = ()
    sampler_id: str | None = None
    question: str | None = None
    sampler: str | None = None
    chunk_ids: list[int] = field(default_factory=list)
    structured: dict[str, str] = field(default_factory=dict)
    mode: str = "dense"
    after: float | None = None
    before: float | None = None
    window: int = 0
    stemmed: bool = False

    def __post_init__(self):
        object.__setattr__(self, "video_ids", scope_of(self.video_ids))
        if self.limit < 1 or self.candidates < 1 or self.window < 0:
            raise Refused("limits are at least 1, a window at least 0")
        if self.mode not in ("dense", "hybrid"):
            raise Refused("mode is dense or hybrid")
        if self.after is not None and self.before is not None and self.before <= self.after:
            raise Refused("a window ends after it begins")

    @property
    def narrows_chunks(self) -> bool:
        return bool(self.chunk_ids) or self.after is not None or self.before is not None

    def notes(self) -> list[str]:
        """What to know about the scores."""
        out = []
        if self.sampler_id or self.question or self.sampler or self.structured:
            out.append("filters take away units that agree, so scores are lower than without them")
        if len(self.video_ids) != 1:
            out.append("several recordings share one ranking; a chunk id belongs to its recording's grid")
        return out


def structured_matches(structured: Column, wanted: dict[str, str]) -> Column:
    """Every wanted field equals the stored one, or is an element of it if that is a list."""
    out, fields = F.lit(True), F.from_json(structured, "map<string,string>")
    for key, value in wanted.items():
        have = F.try_element_at(fields, F.lit(key))
        as_list = F.from_json(have, "array<string>")
        out = out & F.coalesce((have == str(value)) | F.array_contains(as_list, str(value)), F.lit(False))
    return out


def _equal(rows: DataFrame, **wanted) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def wanted_chunks(request: SearchRequest, grids: DataFrame) -> DataFrame:
    """chunk_id of the chunks that a request is narrowed to: its set, those in its time window on any grid in scope, or
    both, and then the neighbours within `window` on either side, up to the longest grid's end.

    If that leaves nothing, the chunks themselves stay."""
    known = grids.filter(F.col("video_id").isin(*request.video_ids)) if request.video_ids else grids
    if request.after is not None or request.before is not None:
        ids = G.chunks_overlapping(known, request.after, request.before).select("chunk_id").distinct()
        if request.chunk_ids:
            ids = ids.filter(F.col("chunk_id").isin(*request.chunk_ids))
    else:
        ids = grids.sparkSession.createDataFrame([(int(c),) for c in dict.fromkeys(request.chunk_ids)], "chunk_id long")
    if not request.window:
        return ids
    wide = G.widened(ids, known, request.window)
    return wide.unionByName(ids.filter(wide.agg(F.count("*") == 0).scalar()))


def candidates(units: DataFrame, request: SearchRequest, grids: DataFrame | None = None) -> DataFrame:
    """The filters of a request, all before any ranking, so that they reach the scan."""
    out = _equal(units, embedder=request.embedder, sampler_id=request.sampler_id, question=request.question, sampler=request.sampler)
    if request.video_ids:
        out = out.filter(F.col("video_id").isin(*request.video_ids))
    if request.chunk_ids and request.after is None and request.before is None and not request.window:
        out = out.filter(F.col("chunk_id").isin(*request.chunk_ids))
    elif request.narrows_chunks:
        if grids is None:
            raise Refused("a time window or neighbours need the grids")
        out = out.join(wanted_chunks(request, grids), "chunk_id", "left_semi")
    if request.structured:
        out = out.filter(structured_matches(F.col("structured"), request.structured))
    return out


def over_fetch(limit: int) -> int:
    return max(4 * limit, 40)


def _ranked(rows: DataFrame, order: list[Column], limit: int, name: str) -> DataFrame:
    """The first rows by order with their rank: a top-k first, so that the window sees `limit` rows only."""
    return rows.orderBy(*order).limit(limit).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def query_literal(query: DataFrame | Iterable[float]) -> Column:
    """The query's vector as a literal.  A table of queries must have one row, with q."""
    if isinstance(query, DataFrame):
        found = query.select("q").limit(2).collect()
        if len(found) != 1:
            raise Refused("a search has one query vector")
        query = found[0].q
    return F.lit([float(x) for x in query])


def vector_rank(units: DataFrame, query: DataFrame | Iterable[float], keys: list[str], limit: int) -> DataFrame:
    """keys, similarity and vector_rank of the nearest units by cosine."""
    scored = units.filter(F.col("vector").isNotNull()).select(*keys, V.cosine(F.col("vector"), query_literal(query)).alias("similarity"))
    return _ranked(scored, [F.desc("similarity"), *map(F.col, keys)], limit, "vector_rank")


def tallies(units: DataFrame, keys: list[str], found: Column, repeated: DataFrame | None = None) -> DataFrame:
    """keys, lexeme and positions of every unit, from an array of its words; rows of equal keys count as one unit.

    Words are counted inside of their row; only rows whose keys occur again (repeated: these keys, once each) are
    shuffled to be put together."""
    if repeated is None:
        again = units.select(*keys).groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1")
        repeated = cut(again.select(*keys), "repeated")
    counted = lambda rows: rows.withColumn("__words", found).select(*keys, F.inline(T.tallied(F.col("__words"))))
    if repeated.isEmpty():
        return counted(units)
    one = units.alias("a").join(repeated.alias("b"), same(keys, "a", "b"), "left_anti")
    more = units.alias("a").join(repeated.alias("b"), same(keys, "a", "b"), "left_semi")
    merged = counted(more).groupBy(*keys, "lexeme").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return counted(one).unionByName(merged)


def postings(units: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """One row a unit and lexeme: how often it occurs and where first."""
    words = tallies(units, keys, T.lexemes(F.col(content)))
    return words.select(*keys, "lexeme", F.size("positions").cast("long").alias("tf"), F.col("positions")[0].alias("first_position"))


def parse_query(text: str) -> list[tuple[list[str], bool]]:
    """The terms of a query as (lexemes, negated): words, "phrases", and either with a dash before it to exclude it."""
    out = []
    for dash, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        found = [w for w in re.findall(r"[^\W_]+", (phrase or word).lower()) if w not in T.STOP_WORDS]
        out += [(found, bool(dash))] if phrase and found else [([w], bool(dash)) for w in found]
    return out


def query_terms(text: str, stemmed: bool = False) -> list[tuple[list[str], bool]]:
    """The terms of a query as parse_query gives them; stemmed: with the stems of their words."""
    return [([english(w) for w in found], negated) for found, negated in parse_query(text)] if stemmed else parse_query(text)


def text_rank(units: DataFrame, query: str, keys: list[str], limit: int, content: str = "content", stemmed: bool = False) -> DataFrame:
    """Units that match any term of the query and hold at least min(2, query lexemes) of its lexemes, by how often the
    terms that aren't negated occur (each occurrence is a cover of its own, as terms are alternatives).

    The query is a value of the driver: units are scored in place, nothing but the best is shuffled."""
    terms = query_terms(query, stemmed)
    lexemes = list(dict.fromkeys(w for found, _ in terms for w in found))
    if not lexemes:
        return units.select(*keys, F.lit(0).alias("matched"), F.lit(0).cast("long").alias("tf"), F.lit(1).cast("long").alias("text_rank")).filter(F.lit(False))
    at = F.transform(F.col("w"), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    wanted = F.array(*map(F.lit, lexemes))

    def occurrences(found: list[str]) -> Column:
        if len(found) == 1:
            return F.size(F.filter("w", lambda w: w == found[0]))
        phrase = F.array(*map(F.lit, found))
        return F.size(F.filter(at, lambda x: (x["w"] == found[0]) & (F.slice(F.col("w"), x["i"] + 1, len(found)) == phrase)))

    rows = units.select(*keys, T.lexemes(F.coalesce(F.col(content), F.lit("")), stemmed).alias("w"))
    matched = F.size(F.array_intersect("w", wanted)).cast("long")
    tf = sum((occurrences(f) for f, negated in terms if not negated), F.lit(0)).cast("long")
    absent = reduce(lambda x, y: x | y, [occurrences(f) == 0 for f, negated in terms if negated], F.lit(False))
    hits = rows.select(*keys, matched.alias("matched"), tf.alias("tf"), absent.alias("absent"))
    hits = hits.filter((F.col("matched") >= min(2, len(lexemes))) & ((F.col("tf") > 0) | F.col("absent"))).drop("absent")
    return _ranked(hits, [F.desc("tf"), *map(F.col, keys)], limit, "text_rank")


def fuse(by_vector: DataFrame, by_text: DataFrame, keys: list[str], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings, full outer."""
    j = by_vector.select(*keys, "vector_rank").join(by_text.select(*keys, "text_rank"), keys, "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return j.withColumn("score", part("vector_rank") + part("text_rank"))


def ranked_hits(rows: DataFrame, query: DataFrame | Iterable[float], text: str | None, keys: list[str], limit: int, texts: DataFrame | None = None, stemmed: bool = False) -> DataFrame:
    """keys, vector_rank, text_rank and score of the best `limit` rows; without a text the vector's ranking alone.

    texts: keys and content of the same rows, where they are stored without vectors: no text goes through a join then.

    Ties go by vector rank, rows without one last, then by keys."""
    by_vector = vector_rank(rows, query, keys, over_fetch(limit))
    if text and text.strip():
        fused = fuse(by_vector, text_rank(rows if texts is None else texts, text, keys, over_fetch(limit), stemmed=stemmed), keys)
    else:
        fused = by_vector.select(*keys, "vector_rank", F.lit(None).cast("long").alias("text_rank"), (1.0 / (RRF_K + F.col("vector_rank"))).alias("score"))
    return fused.orderBy(F.desc("score"), F.asc_nulls_last("vector_rank"), *keys).limit(limit)


def with_content(hits: DataFrame, rows: DataFrame, keys: list[str], columns: Iterable[str]) -> DataFrame:
    """hits with columns of the rows that they stand for; those that rows don't have are left out."""
    own = [c for c in columns if c in rows.columns and c not in keys]
    return hits.join(rows.select(*keys, *own), keys)


def hybrid(units: DataFrame, query: DataFrame | Iterable[float], text: str, keys: list[str], limit: int, texts: DataFrame | None = None, stemmed: bool = False) -> DataFrame:
    """The best units by fused rank."""
    return ranked_hits(units, query, text, keys, limit, texts, stemmed)


def hybrid_search(units: DataFrame, grids: DataFrame, query: DataFrame | Iterable[float], text: str | None, request: SearchRequest) -> DataFrame:
    """The best units with their content and their chunk's times: request.limit rows."""
    found = candidates(units, request, grids)
    hits = with_content(ranked_hits(found, query, text, UNIT, request.limit, stemmed=request.stemmed), found, UNIT, ("sampler", "question", "content", "structured"))
    return hits.join(grids.select("video_id", "chunk_id", "start_ts", "end_ts"), ["video_id", "chunk_id"], "left").orderBy(F.desc("score"), F.asc_nulls_last("vector_rank"), *UNIT)


def moments(hits: DataFrame, limit: int) -> DataFrame:
    """Hits (video_id, chunk_id, sampler_id, score, vector_rank) as chunks, by the hits' places in one ranking: the best
    place of a chunk, and half of its second."""
    order = [F.desc("score"), F.asc_nulls_last("vector_rank"), *UNIT]
    place = F.row_number().over(Window.partitionBy("video_id", "chunk_id").orderBy("rank"))
    s = hits.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("place", place)  # a few dozen rows
    part = lambda n: F.max(F.when(F.col("place") == n, 1.0 / (MOMENT_K + F.col("rank"))))
    g = s.groupBy("video_id", "chunk_id").agg((part(1) + SECOND * F.coalesce(part(2), F.lit(0.0))).alias("score"), F.count("*").alias("hits"))
    return g.orderBy(F.desc("score"), "video_id", "chunk_id").limit(limit)


HIT = ("sampler", "question", "content", "structured")


def search(units: DataFrame, query: DataFrame | Iterable[float], request: SearchRequest, text: str = "", grid: DataFrame | None = None, visual: tuple[DataFrame, Iterable[float]] | None = None, details: bool = False) -> DataFrame:
    """Moments that answer a query: one lazy plan.

    visual: units of another vector space, such as frames, and the query in that space.  Each space is then ranked for
    itself and its hits are scored by their places, as scores of two spaces aren't on one scale.
    details: with `found`, what a moment is made of, the best first: sampler_id, score, the ranks by vector and text, and what
    the unit says (HIT)."""
    hits = ranked_hits(candidates(units, request, grid), query, text if request.mode == "hybrid" else None, UNIT, request.candidates, stemmed=request.stemmed)
    said = candidates(units, request, grid)
    if visual is not None:
        said = said.unionByName(candidates(visual[0], request, grid), allowMissingColumns=True)
        seen = ranked_hits(candidates(visual[0], request, grid), visual[1], None, UNIT, request.candidates)
        order = [F.desc("score"), F.asc_nulls_last("vector_rank"), *UNIT]
        both = hits.withColumn("space", F.lit(0)).unionByName(seen.withColumn("space", F.lit(1)))
        hits = both.withColumn("score", 1.0 / (RRF_K + F.row_number().over(Window.partitionBy("space").orderBy(*order)))).drop("space")
    out = moments(hits, request.limit)
    if details:
        out = with_hits(out, hits, said)
    if grid is not None:
        out = out.join(grid.select("video_id", "chunk_id", "start_ts", "end_ts"), ["video_id", "chunk_id"], "left")
    return out


def with_hits(found: DataFrame, hits: DataFrame, units: DataFrame) -> DataFrame:
    """Moments with `found`, their hits as an array of structs, the best first.  Hits are few; units are read for them only."""
    chunk = ["video_id", "chunk_id"]
    own = hits.join(found.select(*chunk), chunk, "left_semi")
    own = with_content(own, units, UNIT, HIT)
    place = F.struct((-F.col("score")).alias("s"), F.coalesce("vector_rank", F.lit(1 << 60)).alias("v"), F.col("sampler_id").alias("k"))
    what = F.struct("sampler_id", "score", "vector_rank", "text_rank", *[c for c in HIT if c in own.columns])
    listed = own.groupBy(*chunk).agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), what.alias("hit")))), lambda x: x["hit"]).alias("found"))
    return found.join(listed, chunk)


def search_notes(request: SearchRequest, found: int, empty_spaces: Iterable[str] = ()) -> list[str]:
    """What to know about a result of `found` moments: the request's notes, what matched nothing, and which of several
    vector spaces had nothing to rank."""
    narrowed = request.narrows_chunks or request.sampler_id or request.question or request.sampler or request.structured or request.video_ids
    out = [f"nothing is indexed for {space} in this scope; only the other space was ranked" for space in empty_spaces]
    if not found:
        out.append("nothing matched those filters; if that embedder never indexed these recordings, embed them first" if narrowed else "nothing is indexed for this embedder")
    return out + request.notes()


def search_observations(
    observations: DataFrame, query: DataFrame | Iterable[float], limit: int = 10, after=None, before=None, since=None, until=None, text: str | None = None,
    embedder: str | None = None, video_id: str | Iterable[str] | None = None, sampler_id: str | None = None, question: str | None = None, sampler: str | None = None, structured: dict[str, str] | None = None,
) -> DataFrame:
    """Live answers, best first, with their content, inside half-open windows of media time and of arrival.

    since and until are dates or ISO 8601 (without a zone: UTC) where seen_at is text, else values of its own kind."""
    if limit < 1:
        raise Refused("a limit is at least 1")
    if dict(observations.dtypes).get("seen_at") == "string":
        since, until = times.stamp(since, "since"), times.stamp(until, "until")
    out = _equal(observations, embedder=embedder, sampler_id=sampler_id, question=question, sampler=sampler)
    if scope := scope_of(video_id):
        out = out.filter(F.col("video_id").isin(*scope))
    for column, low, high in (("media_ts", after, before), ("seen_at", since, until)):
        if low is not None and high is not None and low >= high:
            raise Refused("a window ends after it begins")
        if low is not None:
            out = out.filter(F.col(column) >= F.lit(low))
        if high is not None:
            out = out.filter(F.col(column) < F.lit(high))
    if structured:
        out = out.filter(structured_matches(F.col("structured"), structured))
    hits = ranked_hits(out, query, text, SEEN, limit)
    return with_content(hits, out, SEEN, ("chunk_id", "sampler", "question", "media_ts", "frames", "description", "structured", "seen_at"))


def search_aggregates(
    units: DataFrame, sources: DataFrame, items: DataFrame, query: DataFrame | Iterable[float], text: str | None = None, level: str = "source", limit: int = 5,
    embedder: str | None = None, source_ids: str | Iterable[str] | None = None,
) -> DataFrame:
    """Summaries (level source), chapters (span) or entities (entity) that answer a query, best first, with the label
    of their item and the recordings of their source."""
    if level not in LEVELS:
        raise UnknownOption("level", level, LEVELS)
    if limit < 1:
        raise Refused("a limit is at least 1")
    found = _equal(units, embedder=embedder, level=level)
    if scope := scope_of(source_ids):
        found = found.filter(F.col("source_id").isin(*scope))
    hits = with_content(ranked_hits(found, query, text, ITEM, limit), found, ITEM, ("level", "content", "start_ts", "end_ts"))
    out = hits.join(sources.select("source_id", "video_ids"), "source_id").join(items.select(*ITEM, "label"), ITEM, "left")
    return out.orderBy(F.desc("score"), F.asc_nulls_last("vector_rank"), *ITEM)


def spaces(hits: DataFrame, space: str = "embedder", k: int = RRF_K) -> DataFrame:
    """Hits of several vector spaces, each ranked in its own and scored by that rank."""
    w = Window.partitionBy(space).orderBy("rank", *UNIT)
    return hits.withColumn("space_rank", F.row_number().over(w)).withColumn("score", 1.0 / (k + F.col("space_rank")))
