"""Pages that carry their data as a stream of framed records: frames cut by their lengths, references between them resolved as a relation."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townkit.operators.joins import look_up
from townkit.operators.stages import written

#: What a page's scripts begin with, the fields of a record that may refer to a text, and the marks of an index of records.
PUSH, REFERRING, INDEX_MARK, INDEX_LIST = "self.__next_f.push(", ("description", "description_html", "requirements"), "isEvents", "source"
SCRIPT = re.compile(r"<script\b[^>]*>(.*?)</script\s*>", re.S | re.I)
FRAME_ID, TEXT_LENGTH = re.compile(rb"([0-9a-f]+):"), re.compile(rb"T([0-9a-f]+),")
CUT = pa.schema([("page", pa.int64()), ("kind", pa.string()), ("id", pa.string()), ("place", pa.int64()), ("value", pa.string())])
CUT_SQL = "page long, kind string, id string, place long, value string"
REFERENCE = r"^\$([0-9a-f]+)$"


class BadPage(ValueError):
    """A page whose data cannot be read as a whole."""


def stream_of(html: str) -> bytes:
    """The data that a page's scripts push, in their order."""
    parts = []
    for script in SCRIPT.findall(html):
        body = script.strip()
        if not body.startswith(PUSH):
            continue
        try:
            arguments = json.loads(body[len(PUSH) :].rstrip(";").rstrip()[:-1])
        except ValueError:
            raise BadPage("malformed data") from None
        if isinstance(arguments, list) and len(arguments) > 1 and isinstance(arguments[1], str):
            parts.append(arguments[1])
    return "".join(parts).encode("utf-8", "replace")


def cut_frames(data: bytes) -> tuple[dict[str, str], list]:
    """(texts by id, JSON values in their order). A text frame states its length in bytes, and the next one follows at once; others end with their line."""
    texts, values, at = {}, [], 0
    while at < len(data):
        name = FRAME_ID.match(data, at)
        if name:
            at = name.end()
            length = TEXT_LENGTH.match(data, at)
            if length:
                end = length.end() + int(length[1], 16)
                if end > len(data):
                    raise BadPage("incomplete text frame")
                texts[name[1].decode()] = data[length.end() : end].decode("utf-8", "replace")
                at = end
                continue
        end = data.find(b"\n", at)
        line, at = data[at : end if end >= 0 else len(data)], (end + 1 if end >= 0 else len(data))
        if name and line[:1] in (b"[", b"{"):
            try:
                values.append(json.loads(line))
            except ValueError:
                raise BadPage("malformed frame") from None
    return texts, values


def indexes(value) -> list[list]:
    """All lists of records that a value holds at any depth."""
    found, rest = [], [value]
    while rest:
        one = rest.pop()
        if isinstance(one, dict):
            if one.get(INDEX_MARK) is True and isinstance(one.get(INDEX_LIST), list):
                found.append(one[INDEX_LIST])
            rest += one.values()
        elif isinstance(one, list):
            rest += one
    return found


def cut_pages(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """page, kind, id, place, value of every page that pushes data: its `text` frames, its `record`s (JSON) if it has one index of them, else the `problem`."""

    def cut(batches):
        for batch in batches:
            out = []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    data = stream_of(text)
                    if not data:
                        continue
                    texts, values = cut_frames(data)
                    lists = indexes(values)
                    if len(lists) != 1 or not lists[0]:
                        raise BadPage("missing index" if not lists or not lists[0] else "ambiguous index")
                    out += [(number, "text", i, None, t) for i, t in texts.items()]
                    out += [(number, "record", None, n, json.dumps(r, ensure_ascii=False)) for n, r in enumerate(lists[0])]
                except BadPage as problem:
                    out.append((number, "problem", None, None, str(problem)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(CUT), CUT, strict=True)], schema=CUT)

    return pages.select(F.col(page).cast("long"), F.coalesce(F.col(html), F.lit(""))).mapInArrow(cut, CUT_SQL)


def resolved_texts(texts: DataFrame, most_rounds: int = 40) -> DataFrame:
    """page, id, value: texts (page, id, value) that are references replaced by what they lead to, over any number of steps.

    A reference to a frame that is not there stays as it is written; references that go round in a circle are null. Pointer doubling: each
    round doubles the steps that are followed, and only references that are not settled yet go on.
    """
    marked = written(texts.select("page", "id", "value", F.nullif(F.regexp_extract("value", REFERENCE, 1), F.lit("")).alias("to")), "texts")
    ends = marked.where("to IS NULL").select("page", "id", "value")
    open_, done = marked.where("to IS NOT NULL").select("page", "id", "to"), ends
    for _ in range(most_rounds):
        if open_.isEmpty():
            return done
        keyed = open_.select("page", "id", F.col("to").alias("_to"))
        target = look_up(keyed, ends.select("page", F.col("id").alias("_to"), F.col("value"), F.lit(True).alias("ends")), ["page", "_to"], "left")
        step = written(look_up(target, open_.select("page", F.col("id").alias("_to"), F.col("to").alias("next")), ["page", "_to"], "left"), "texts")
        # a frame that is neither an end nor a reference is not there
        settled = step.where("ends OR next IS NULL").select("page", "id", F.when(F.col("ends"), F.col("value")).otherwise(F.concat(F.lit("$"), "_to")).alias("value"))
        rest = step.where("ends IS NULL AND next IS NOT NULL").select("page", "id", F.col("next").alias("to"))
        circle = rest.where("to = id").select("page", "id", F.lit(None).cast("string").alias("value"))
        done = done.unionByName(settled).unionByName(circle)
        ends, open_ = ends.unionByName(settled).unionByName(circle), rest.where("to <> id")
        ends = written(ends, "texts")
    return done.unionByName(open_.select("page", "id", F.lit(None).cast("string").alias("value")))


def published_records(pages: DataFrame, page: str = "page_id", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(page, place, record and the referring fields of every record; page, problem of pages that cannot be read as a whole).

    A field that refers to a text of its page has that text; a field that refers to none stays as it is written.
    """
    cut = written(cut_pages(pages, page, html), "frames")
    texts = resolved_texts(cut.where("kind = 'text'").select("page", "id", "value"))
    records = cut.where("kind = 'record'").select("page", "place", F.col("value").alias("record"))
    out = records
    for name in REFERRING:
        field = F.get_json_object("record", f"$.{name}")
        keyed = out.withColumn("id", F.nullif(F.regexp_extract(F.coalesce(field, F.lit("")), REFERENCE, 1), F.lit("")))
        known = texts.select("page", "id", F.col("value").alias("_value"), F.lit(True).alias("_there"))
        out = keyed.join(known, ["page", "id"], "left").withColumn(name, F.when(F.col("_there"), F.col("_value")).otherwise(field)).drop("id", "_value", "_there")
    return out, cut.where("kind = 'problem'").select("page", F.col("value").alias("problem"))
