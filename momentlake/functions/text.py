"""Text expressions: rendering, slugs, words, tokens and pieces."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words that carry no meaning for matching and search, by the common English list of text search.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down "
    "during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my "
    "myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your "
    "yours yourself yourselves"
).split()


#: Words too common to count as a detail that two descriptions share.
DETAIL_STOP_WORDS = "a an the and with of on in none nothing no".split()


def slug(text: Column, default: str = "all", most: int = 48) -> Column:
    """Lower case, other characters than letters and digits as one dash, trimmed, at most 48 characters."""
    s = F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, most)
    return F.when(s == "", default).otherwise(s)


def words(text: Column) -> Column:
    """Distinct lower-case words but for those too common to be a detail."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in DETAIL_STOP_WORDS]))


def stems(found: Column) -> Column:
    """The English (Porter 2) stems of an array of words, by batches; each different word is stemmed once."""
    from momentlake.functions.stems import english

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(w: str) -> str:
            if w not in known:
                known[w] = english(w)
            return known[w]

        return lists.map(lambda ws: None if ws is None else [one(w) for w in ws])

    return run(found)


def lexemes(text: Column, stemmed: bool = False) -> Column:
    """Words in order with repeats, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(*STOP_WORDS))
    return stems(kept) if stemmed else kept


def tallied(found: Column) -> Column:
    """The different words of an array, by word, each with its positions in order: an array of (lexeme, positions).

    A row is sorted in itself and cut where the word changes: nothing is shuffled to count the words of one text."""
    let = lambda value, body: F.transform(F.array(value), body)[0]
    word = lambda s, i: F.get(s, i)["lexeme"]

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~word(s, i).eqNullSafe(word(s, i - 1)))
        after = lambda e, k: F.coalesce(F.get(e, k + 1), F.size(s))
        positions = lambda e, a, k: F.transform(F.slice(s, a + 1, after(e, k) - a), lambda x: x["position"])
        return let(first, lambda e: F.transform(e, lambda a, k: F.struct(word(s, a).alias("lexeme"), positions(e, a, k).alias("positions"))))

    placed = F.transform(found, lambda w, i: F.struct(w.alias("lexeme"), i.alias("position")))
    return F.when(F.size(found) > 0, let(F.sort_array(placed), runs))


def render(summary: Column, structured: Column) -> Column:
    """A summary and then `key: value` of a string map by key, blanks left out, joined by `. `."""
    pairs = F.filter(F.array_sort(F.map_entries(structured)), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != "")
    said = F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), F.trim(e["value"])))
    head = F.when(F.trim(F.coalesce(summary, F.lit(""))) != "", F.trim(summary))
    return F.concat_ws(". ", head, said)


def _value(x) -> str:
    """A JSON value as text: lists by ` | `, objects as `key value` by key and `; `, blanks left out."""
    if x is None or x == "" or x == []:
        return ""
    if isinstance(x, dict):
        return "; ".join(f"{k} {v}" for k in sorted(x) if (v := _value(x[k])))
    if isinstance(x, list):
        return " | ".join(v for v in map(_value, x) if v)
    return x.strip() if isinstance(x, str) else str(x)


def render_json(summary: str | None, structured: str | None) -> str:
    """As render, for a JSON object of any depth; what isn't an object says nothing."""
    try:
        fields = json.loads(structured) if structured else {}
    except ValueError:
        fields = {}
    said = [f"{k}: {v}" for k in sorted(fields) if (v := _value(fields[k]))] if isinstance(fields, dict) else []
    return ". ".join([*([summary.strip()] if summary and summary.strip() else []), *said])


def rendered(summary: Column, structured: Column) -> Column:
    """As render, of a JSON object of any depth.  Objects of plain values stay in the JVM; only deeper ones go to
    Python, by batches."""

    @F.pandas_udf("string")
    def deep(s: pd.Series, j: pd.Series) -> pd.Series:
        return pd.Series([render_json(a, b) for a, b in zip(s, j, strict=True)])

    flat = F.from_json(structured, "map<string,string>")
    nested = structured.rlike(r"^\s*\{.*[\[{]") | structured.rlike(r":\s*(true|false)\b")
    return F.when(F.coalesce(nested, F.lit(False)), deep(summary, structured)).otherwise(render(summary, F.coalesce(flat, F.create_map().cast("map<string,string>"))))


def account_text(account: Column, label: Column) -> Column:
    """The text of an entity: the description and narrative of its account, then what else it says; without, its label."""
    said = lambda k: F.when(F.trim(F.coalesce(account[k], F.lit(""))) != "", F.trim(account[k]))
    prose = F.concat_ws(" ", said("description"), said("narrative"))
    rest = F.map_filter(account, lambda k, _: ~k.isin("description", "narrative"))
    full = render(prose, F.coalesce(rest, F.create_map().cast("map<string,string>")))
    return F.when(account.isNotNull() & (full != ""), full).otherwise(F.coalesce(label, F.lit("")))


def row_line(chunk_id: Column, start: Column, end: Column, text: Column) -> Column:
    """A chunk's row as one line: its id, its seconds and what is said."""
    whole = lambda c: F.bround(c).cast("long").cast("string")
    return F.concat(F.lit("["), chunk_id.cast("string"), F.lit("] "), whole(start), F.lit("-"), whole(end), F.lit("s  "), text)


def plain(parts: Column) -> Column:
    """Parts that aren't blank, joined by a space."""
    return F.concat_ws(" ", F.filter(F.transform(parts, F.trim), lambda p: p != ""))


def singular(word: Column) -> Column:
    return F.regexp_replace(word, "s$", "")


def answer_id(name: Column, question: Column) -> Column:
    return F.when(name == question, name).otherwise(F.concat_ws(":", name, question))


def file_name(answer: Column) -> Column:
    return F.translate(answer, ":", ".")


def answer_of_file(stem: Column) -> Column:
    return F.translate(stem, ".", ":")


def labelled(definition: Column, label: Column) -> Column:
    """The id of a definition's answer for one of several inputs: `definition~label`, or the definition alone."""
    return F.when(F.coalesce(label, F.lit("")) == "", definition).otherwise(F.concat_ws("~", definition, label))


def definition_of(answer: Column) -> Column:
    return F.substring_index(answer, "~", 1)


def content_hash(text: Column) -> Column:
    """Sixteen hex digits that identify a content."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def split_pieces(text: str, limit: int) -> list[str]:
    """Pieces of at most `limit` characters: whole sentences packed together; a longer sentence is cut at its last
    space within the limit, or at the limit.  Nothing is dropped."""
    out, held = [], ""
    for sentence in _SENTENCE.split(text.strip()):
        while len(sentence) > limit:
            if held:
                out.append(held)
                held = ""
            at = sentence.rfind(" ", 0, limit + 1)
            at = at if at > 0 else limit
            out.append(sentence[:at].rstrip())
            sentence = sentence[at:].lstrip()
        joined = f"{held} {sentence}".strip()
        if len(joined) > limit:
            out.append(held)
            held = sentence
        else:
            held = joined
    return [*out, held] if held else out


#: Characters of the texts that a task turns into Python strings at once; a longer text is one part.
PART = 1_000_000


def parts(texts: pa.Array, most: int = PART) -> Iterator[tuple[int, list[str]]]:
    """A batch's texts (null: empty) as lists of about `most` characters, each with the row that it begins at."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, [t or "" for t in texts.slice(a, b - a).to_pylist()]
        a = b


def pieces(rows: DataFrame, keys: list[str], text: str, limit: int) -> DataFrame:
    """keys, piece_no and piece of every row, by parts of a batch: no task holds the pieces of many texts."""
    named = rows.select(*keys, F.col(text).alias("piece"))
    schema = StructType(named.schema.fields[:-1]).add("piece_no", "integer").add("piece", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in parts(b.column(len(keys))):
                found = [split_pieces(t, limit) for t in texts]
                of = pa.array(np.repeat(np.arange(start, start + len(texts)), [len(x) for x in found]))
                number, piece = pa.array([k for x in found for k in range(len(x))], pa.int32()), pa.array([p for x in found for p in x], pa.string())
                yield pa.RecordBatch.from_arrays([*(c.take(of) for c in b.columns[: len(keys)]), number, piece], schema.names)

    return named.mapInArrow(run, schema)
