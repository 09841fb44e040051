"""What recurs in a recording: the mentions of a profile, their groups as entities, accounts, doubts and who is seen
with whom.  Only the links inside a block and the model calls run in Python."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlake.errors import Refused, UnknownOption
from momentlake.functions import text as T
from momentlake.operators import aggregates, linking
from momentlake.operators.selection import Source

#: The prose of an answer as a field's name.
PROSE = "summary"
CHECKS = ("flag", "off")


@dataclass(frozen=True)
class Profile:
    """How mentions of one kind are found, compared and told about.

    identity: the keys of a list's entries that say who it is; none links the field's whole value.  fixed: a bar in
    place of the one read off the data.  story: more keys that an account is told from."""

    name: str
    field: str
    identity: tuple[str, ...] = ()
    story: tuple[str, ...] = ()
    rule: str = "max"
    mutual: bool = True
    fixed: float | None = None
    transcript: bool = False
    check: str = "flag"
    min_appearances: int = 2
    max_narratives: int = 12
    weights: dict[str, float] = field(default_factory=dict)
    attributes: dict[str, float] = field(default_factory=dict)
    shared: dict[str, float] = field(default_factory=dict)
    near: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        if self.rule not in linking.RULES:
            raise UnknownOption("rule", self.rule, linking.RULES)
        if self.check not in CHECKS:
            raise UnknownOption("check", self.check, CHECKS)
        if self.min_appearances < 1 or self.max_narratives < 0:
            raise Refused("at least one appearance, no fewer than 0 accounts")

    def narrowed(self, sources: list[Source]) -> tuple[str, ...]:
        """The identity keys that are left if the sources name fields: they may narrow the keys, never widen them."""
        asked = [f for s in sources for f in s.fields]
        if not asked:
            return self.identity
        if not self.identity:
            raise Refused(f"profile {self.name!r} links whole values; its input takes no fields")
        allowed = {f"{self.field}.{k}" for k in self.identity}
        if wrong := [f for f in asked if f not in allowed]:
            raise Refused(f"{', '.join(wrong)}: profile {self.name!r} identifies by {', '.join(sorted(allowed))}")
        return tuple(dict.fromkeys(f.split(".", 1)[1] for f in asked))


MENTION = ["video_id", "chunk_id", "sampler_id", "field", "index", "signature", "entry"]


def mentions(profile: Profile, answers: DataFrame, transcript: DataFrame | None = None, sources: list[Source] | None = None) -> DataFrame:
    """video_id, chunk_id, sampler_id, field, index, signature, entry (a map) and key of everything that a profile links.

    A row for each object of a matching answer's list field that has an identity key; for a whole value, one an answer;
    for the transcript, one a chunk.  answers: video_id, chunk_id, sampler, question, description, structured (JSON)."""
    sources = sources or []
    keys, name = profile.narrowed(sources), F.lit(profile.field)
    if profile.field == "transcript":
        if transcript is None:
            raise Refused("this profile reads a transcript")
        said = F.trim(F.coalesce("text", F.lit("")))
        rows = transcript.select("video_id", "chunk_id", F.lit("transcript").alias("sampler_id"), name.alias("field"), F.lit(0).alias("index"), said.alias("signature"), F.create_map(name, said).alias("entry"))
    else:
        for s in sources:
            if s.transcript:
                raise Refused(f"profile {profile.name!r} links answers, no transcript")
        rows = answers
        if sources:
            wanted = F.lit(False)
            for s in sources:
                wanted = wanted | s.predicate()
            rows = rows.filter(wanted)
        who = [F.col("video_id"), F.col("chunk_id"), T.answer_id(F.col("sampler"), F.col("question")).alias("sampler_id"), name.alias("field")]
        if keys:
            listed = F.from_json(F.get_json_object("structured", f"$.{profile.field}"), "array<map<string,string>>")
            rows = rows.select(*who, F.posexplode(listed).alias("index", "entry"))
            said = [F.trim(F.col("entry")[k]) for k in keys]
            rows = rows.select(*MENTION[:5], F.concat_ws("; ", *[F.when(v != "", v) for v in said]).alias("signature"), "entry")
        else:
            value = F.col("description") if profile.field == PROSE else T.rendered(F.lit(""), F.concat(F.lit(f'{{"{profile.field}":'), F.coalesce(F.to_json(F.variant_get(F.try_parse_json("structured"), f"$.{profile.field}", "variant")), F.lit("null")), F.lit("}")))
            said = F.trim(F.coalesce(value if profile.field == PROSE else F.regexp_replace(value, f"^{profile.field}: ", ""), F.lit("")))
            rows = rows.select(*who, F.lit(0).alias("index"), said.alias("signature"), F.create_map(name, said).alias("entry"))
    key = F.concat(F.lit("c"), F.col("chunk_id").cast("string"), F.lit("/"), F.concat_ws("/", "sampler_id", "field", F.col("index").cast("string")))
    return rows.filter(F.col("signature") != "").select(*MENTION, key.alias("key"))


def sightings(profile: Profile, answers: DataFrame, transcript: DataFrame | None = None, sources: list[Source] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """A profile's mentions, and what was said in the chunks that have some, if its accounts are told from that."""
    found = mentions(profile, answers, transcript, sources)
    if not profile.transcript or transcript is None:
        return found, None
    heard = transcript.filter(F.trim(F.coalesce("text", F.lit(""))) != "").join(found.select("video_id", "chunk_id").distinct(), ["video_id", "chunk_id"], "left_semi")
    return found, heard.select("video_id", "chunk_id", F.trim("text").alias("text"))


def numbered(found: DataFrame) -> DataFrame:
    """found with `mention`, its number within the recording by chunk, answer, field and place in the list."""
    w = Window.partitionBy("video_id").orderBy("chunk_id", "sampler_id", "field", "index")
    return found.withColumn("mention", F.row_number().over(w).cast("long") - 1)


@dataclass(frozen=True)
class Linked:
    """entities: one row each; mentions: with their entity_id; together: pairs by shared chunks; figures: one row a recording."""

    entities: DataFrame
    mentions: DataFrame
    together: DataFrame
    figures: DataFrame


def keyed_texts(profile: Profile, found: DataFrame) -> DataFrame:
    """video_id, mention, name and text of what the profile's weights compare: one row a mention and key, blanks left out."""
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.trim(F.coalesce(F.col("entry")[k], F.lit(""))).alias("text")) for k in profile.weights]))
    return found.select("video_id", "mention", parts.alias("p")).select("video_id", "mention", "p.name", "p.text").filter("text <> ''")


def linked(
    profile: Profile, found: DataFrame, grid: DataFrame, tell: Callable[[DataFrame], DataFrame] | None = None, heard: DataFrame | None = None, most: int = 50,
    keyed: DataFrame | None = None, unknown: list[float] | None = None,
) -> Linked:
    """Entities of numbered mentions with vectors; a recording's only mention is none.

    found: MENTION, key, mention and vector (of the signature).  For a profile with weights also keyed: video_id, mention,
    name and vector of each of the keyed_texts, and unknown, the vector of the text that stands for a blank; the weighted
    mean of the keys' cosines then takes the place of the signature's.  tell: (video_id, entity_id, lines, spoken) -> (video_id,
    entity_id, account map<string,string>, doubts array<struct<observation:int,reason:string>>), asked for entities with
    enough appearances, at most max_narratives a recording.  An entity of which every observation is doubted has no
    account."""
    by, answer = ["video_id"], ["chunk_id", "sampler_id", "field"]
    scored = linking.pairs(found, by, answer, "field")
    measures = ["text"] if profile.weights or profile.attributes else []
    if profile.weights:
        from momentlake.operators.attributes import keyed_similarity

        if keyed is None or unknown is None:
            raise Refused(f"profile {profile.name!r} weighs keys: give their vectors, and that of a blank")
        names = {k: f"__k{n}" for n, k in enumerate(profile.weights)}
        wide = keyed.groupBy("video_id", "mention").agg(*[F.first(F.when(F.col("name") == k, F.col("vector")), ignorenulls=True).alias(c) for k, c in names.items()])
        wide = found.select("video_id", "mention").join(wide, ["video_id", "mention"], "left")
        text = keyed_similarity(wide, by, {names[k]: w for k, w in profile.weights.items()}, unknown)
        scored = scored.drop("similarity").join(text.withColumnRenamed("similarity", "text"), ["video_id", "i", "j"])
    elif profile.attributes:
        scored = scored.withColumnRenamed("similarity", "text")
    if profile.attributes:
        from momentlake.operators.attributes import attribute_similarity

        named = [*profile.attributes, *profile.shared]
        plain = found.select("video_id", "mention", F.concat_ws("/", *[F.col(c).cast("string") for c in answer]).alias("__answer"), *[F.col("entry")[k].alias(k) for k in dict.fromkeys(named)])
        other = attribute_similarity(plain, by, "__answer", profile.attributes, profile.shared, list(profile.near))
        scored = scored.join(other.select("video_id", "i", "j", F.col("similarity").alias("attributes")), ["video_id", "i", "j"])
        measures.append("attributes")
    if measures:
        scored = linking.blended(scored, by, measures)
    bars = linking.threshold(scored, by, linking.RULES[profile.rule], profile.fixed)
    links = linking.mutual_best(scored, bars, by, answer) if profile.mutual else linking.over_bar(scored, bars, by).select("video_id", "i", "j", "similarity")
    groups = linking.grouped(found, links, "video_id", answer)
    several = found.groupBy("video_id").agg(F.count("*").alias("mentions"))
    told_of = found.drop("vector").join(groups, ["video_id", "mention"]).join(several.filter("mentions > 1"), "video_id", "left_semi")
    entities = aggregates.entity_summary(told_of, grid, "sampler_id")
    entities = entities.join(told_of.groupBy("video_id", "group").agg(F.min_by("field", "mention").alias("field")), ["video_id", "group"])
    rank = F.row_number().over(Window.partitionBy("video_id", F.col("appearances") >= profile.min_appearances).orderBy(F.length("entity_id"), "entity_id"))
    entities = entities.withColumn("present", F.col("appearances") >= profile.min_appearances).withColumn("narrated", F.col("present") & (rank <= profile.max_narratives))
    seen = told_of.join(entities.select("video_id", "group", "entity_id", "present", "narrated"), ["video_id", "group"])
    place = F.row_number().over(Window.partitionBy("video_id", "entity_id").orderBy("chunk_id", "sampler_id", "mention"))
    seen = seen.withColumn("observation", place.cast("int"))
    if tell is not None and profile.max_narratives:
        answers = tell(_stories(profile, seen.filter("narrated"), grid, heard))
        raw = answers.select("video_id", "entity_id", F.posexplode("doubts").alias("at", "d")).select("video_id", "entity_id", F.col("d.observation").alias("observation"), "at", F.col("d.reason").alias("reason"))
        doubts = raw.groupBy("video_id", "entity_id", "observation").agg(F.min_by("reason", "at").alias("doubt"))
        seen = seen.join(doubts if profile.check == "flag" else doubts.filter("false"), ["video_id", "entity_id", "observation"], "left")
        count = seen.groupBy("video_id", "entity_id").agg(F.count("doubt").alias("doubted"), F.count("*").alias("observations"))
        entities = entities.join(answers.select("video_id", "entity_id", "account"), ["video_id", "entity_id"], "left").join(count, ["video_id", "entity_id"])
        entities = entities.withColumn("account", F.when(F.col("doubted") < F.col("observations"), F.col("account"))).drop("observations")
    else:
        seen = seen.withColumn("doubt", F.lit(None).cast("string"))
        entities = entities.withColumn("account", F.lit(None).cast("map<string,string>")).withColumn("doubted", F.lit(0).cast("long"))
    pairs = aggregates.together(seen.filter("present").select("video_id", "chunk_id", F.col("entity_id").alias("group")), most)
    candidates = linking.over_bar(scored, bars, by).groupBy("video_id").agg(F.count("*").alias("over_bar"))
    figures = entities.groupBy("video_id").agg(F.count("*").alias("count"), F.count_if("present").alias("linked"), F.count_if("narrated").alias("narrated"), F.sum("doubted").alias("doubted"))
    figures = several.join(figures, "video_id", "left").join(bars, "video_id", "left").join(links.groupBy("video_id").agg(F.count("*").alias("candidate_pairs")), "video_id", "left").join(candidates, "video_id", "left")
    figures = figures.fillna({"count": 0, "linked": 0, "narrated": 0, "doubted": 0, "calibration_pairs": 0, "candidate_pairs": 0, "over_bar": 0})
    return Linked(entities.drop("group", "present"), seen.drop("group", "present", "narrated"), pairs, figures)


def _stories(profile: Profile, seen: DataFrame, grid: DataFrame, heard: DataFrame | None) -> DataFrame:
    """video_id, entity_id, lines (`(n) [s-es] key: value | ...`) and spoken (`[s-es] text`) of the entities to tell of."""
    spans = grid.select("video_id", "chunk_id", F.concat(F.lit("["), F.bround("start_ts").cast("long"), F.lit("-"), F.bround("end_ts").cast("long"), F.lit("s] ")).alias("span"))
    keys = [*profile.identity, *[k for k in profile.story if k not in profile.identity]]
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col("entry")[k].alias("value")) for k in keys]), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != "") if keys else F.array_sort(F.map_entries("entry"))
    said = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")
    s = seen.join(spans, ["video_id", "chunk_id"])
    line = F.concat(F.lit("("), F.col("observation").cast("string"), F.lit(") "), F.col("span"), said)
    out = s.groupBy("video_id", "entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("observation", line.alias("line")))), lambda e: e["line"]).alias("lines"))
    if heard is None:
        return out.withColumn("spoken", F.array().cast("array<string>"))
    chunks = s.select("video_id", "entity_id", "chunk_id", "span").distinct().join(heard, ["video_id", "chunk_id"])
    spoken = chunks.groupBy("video_id", "entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", F.concat("span", "text").alias("line")))), lambda e: e["line"]).alias("spoken"))
    return out.join(spoken, ["video_id", "entity_id"], "left").withColumn("spoken", F.coalesce("spoken", F.array().cast("array<string>")))
