"""Shapes of documents, of answers that users declare, and of ids."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from momentlake.errors import Refused

SPAN = "start double, end double, text string, speaker string"
DOCUMENTS = {
    "media": "document string, version int, video_id string, path string, container_format string, duration_s double, video struct<index:int,codec:string,rate:double,time_base:string,width:int,height:int,frames:int,duration_s:double>, audio struct<index:int,codec:string,rate:int,channels:int,duration_s:double>, source string, name string, recorded_at string",
    "raw_transcript": f"document string, version int, video_id string, speakers array<string>, segments array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>, words array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>, turns array<struct<speaker:string,start:double,end:double>>",
    "cuts": "document string, version int, video_id string, source string, detector string, cuts array<double>, scores struct<metric:string,stride:int,at:array<double>,values:array<double>>",
    "timeline": "document string, version int, video_id string, policy string, derived_from string, fingerprint string, duration_s double, chunk_count int, chunks array<struct<chunk_id:int,start_ts:double,end_ts:double>>",
    "transcript": "document string, version int, video_id string, timeline_fingerprint string, chunks array<struct<chunk_id:int,text:string,word_count:int,turns:array<struct<speaker:string,start:double,end:double,text:string>>>>",
    "manifest": "document string, version int, video_id string, timeline_fingerprint string, manifest_fingerprint string, chunks array<struct<chunk_id:int,decimated_frames:int,samplers:map<string,struct<frame_count:int,frames:array<struct<index:long,media_ts:double,chunk_local_index:int,pts:long,score:double>>>>>>",
    "descriptions": "document string, version int, video_id string, timeline_fingerprint string, chunks array<struct<chunk_id:int,samplers:map<string,struct<sampler:string,question:string,frame_count:int,frame_indexes:array<long>,description:string,structured:string,elapsed_s:double>>>>",
    "embedded": "document string, version int, video_id string, embedder string, units array<struct<chunk_id:int,sampler_id:string,text_hash:string,characters:int,content:string,sampler:string,question:string,structured:string,vector:array<float>>>",
}
OBSERVATION = (
    "video_id string, chunk_id int, sampler_id string, sampler string, question string, frame_index long, media_ts double, frames array<long>, frame_ts array<double>, "
    "description string, structured string, content string, text_hash string, seen_at string, answered_at string, lag_s double, gap_before boolean, embedder string, vector array<float>"
)

_NAME = re.compile(r"^[a-z][a-z0-9_]{0,31}$")
#: Fixed limits of declared answers.
MOST_FIELDS, MOST_KEYS, MOST_CHOICES = 12, 8, 24


def check_fields(spec: dict) -> list[str]:
    """What is wrong with declared fields: {name: {"type": "text" | "list", "one_of": [...], "of": [...]}}."""
    problems = []
    if not 1 <= len(spec) <= MOST_FIELDS:
        problems.append(f"1 to {MOST_FIELDS} fields are needed")
    for name, field in spec.items():
        if not _NAME.match(name):
            problems.append(f"{name!r} is no field name")
        if field.get("type") not in ("text", "list"):
            problems.append(f"{name}: type is text or list")
        if "of" in field and (field.get("type") != "list" or not 1 <= len(field["of"]) <= MOST_KEYS or not all(_NAME.match(k) for k in field["of"])):
            problems.append(f"{name}: of names 1 to {MOST_KEYS} keys of a list")
        if "one_of" in field and not 1 <= len(set(field["one_of"])) == len(field["one_of"]) <= MOST_CHOICES:
            problems.append(f"{name}: one_of has 1 to {MOST_CHOICES} different choices")
    return problems


def fields_to_structtype(spec: dict) -> T.StructType:
    if problems := check_fields(spec):
        raise Refused("; ".join(problems))
    out = T.StructType()
    for name, field in spec.items():
        item = T.StructType([T.StructField(k, T.StringType()) for k in field["of"]]) if "of" in field else T.StringType()
        out = out.add(name, T.ArrayType(item) if field["type"] == "list" else T.StringType())
    return out


def json_schema(spec: dict) -> dict:
    """The strict JSON Schema of declared fields."""
    if problems := check_fields(spec):
        raise Refused("; ".join(problems))

    def one(field):
        text = {"type": "string"} | ({"enum": list(field["one_of"])} if "one_of" in field else {})
        if field["type"] == "text":
            return text
        if "of" in field:
            text = {"type": "object", "properties": {k: {"type": "string"} for k in field["of"]}, "required": list(field["of"]), "additionalProperties": False}
        return {"type": "array", "items": text}

    return {"type": "object", "properties": {n: one(f) for n, f in spec.items()}, "required": list(spec), "additionalProperties": False}


_ID = re.compile(r"^[A-Za-z0-9._-]+$")


def check_id(video_id: str) -> str:
    """Ids are letters, digits, dots, underscores and dashes, don't start with _ and aren't all dots."""
    if not _ID.match(video_id) or video_id.startswith("_") or not video_id.strip("."):
        raise Refused(f"{video_id!r} is no id")
    return video_id


def mint_id(wanted: str, taken: set[str]) -> str:
    """wanted, or wanted-2, wanted-3, ... if it is taken."""
    if wanted not in taken:
        return check_id(wanted)
    for k in range(2, 1000):
        if f"{wanted}-{k}" not in taken:
            return check_id(f"{wanted}-{k}")
    raise Refused(f"{wanted!r} is taken too often")


POLICIES = ("new", "replace", "refuse")


def claim_id(wanted: str, taken: set[str], policy: str = "new") -> str:
    """The id of a run: wanted, or if that is taken another one (new), the same (replace) or none (refuse)."""
    if policy not in POLICIES:
        raise Refused(f"a conflict is met by one of {', '.join(POLICIES)}")
    if wanted in taken and policy == "refuse":
        raise Refused(f"{wanted!r} is there already")
    return check_id(wanted) if policy == "replace" else mint_id(wanted, taken)


def validate(document: object, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON document is against a schema of the strict subset that `json_schema` makes, by path."""
    kind = schema.get("type")
    if kind == "string":
        if not isinstance(document, str):
            return [f"{at}: a text is needed"]
        return [f"{at}: {document!r} is none of {', '.join(schema['enum'])}"] if "enum" in schema and document not in schema["enum"] else []
    if kind == "integer":
        return [] if isinstance(document, int) and not isinstance(document, bool) else [f"{at}: a whole number is needed"]
    if kind == "array":
        if not isinstance(document, list):
            return [f"{at}: a list is needed"]
        return [p for k, x in enumerate(document) for p in validate(x, schema["items"], f"{at}[{k}]")]
    if not isinstance(document, dict):
        return [f"{at}: an object is needed"]
    known = schema.get("properties", {})
    out = [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in document]
    if schema.get("additionalProperties") is False:
        out += [f"{at}.{k}: not asked for" for k in document if k not in known]
    return out + [p for k, x in document.items() if k in known for p in validate(x, known[k], f"{at}.{k}")]
