"""Secret scans: fixed patterns, and incompressible strings in sensitive context by dictionary-primed zstandard novelty."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townkit.llm.shared import batch_of, id_and_text, small_batches

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that make the text around a string sensitive, and common identifiers and code for the compressor's dictionary.
SENSITIVE = ("secret", "token", "passw", "passphrase", "credential", "api_key", "apikey", "api-key", "access_key", "private", "auth", "bearer", "akia", "signature", "client_id", "session")
IDENTIFIERS = (
    "class function return const static public private import export default async await self this true false null None undefined "
    "client_id client_secret access_key secret_key private_key public_key api_key auth_token session_id password username account "
    "https://www.example.com/index.html http://localhost:8080/api/v1/users?id=0 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
    "AUTHORIZATION_HEADER CONTENT_TYPE APPLICATION_JSON DATABASE_URL CONNECTION_STRING ENVIRONMENT_VARIABLE CONFIGURATION_FILE_PATH "
    "getElementById addEventListener createConnection authenticateUser generateAccessToken refreshToken validatePassword parseConfiguration "
    "application/x-www-form-urlencoded multipart/form-data 2024-01-01T00:00:00Z 00000000-0000-0000-0000-000000000000 version 1.0.0 release"
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Strings with further signs, looked at where no part of them is a candidate that counts.
SIGNED = re.compile(r"[A-Za-z0-9!#$%&*+./:=?@^_~-]{16,}")
SENSITIVE_WORD = re.compile("|".join(map(re.escape, SENSITIVE)), re.ASCII | re.IGNORECASE)
#: What may stand between the lines of one string, and the short last line of a key before its END.
SEAM = re.compile(r"""(?:\\[nr]|[\s"'`+,;>|#*\\])*""")
TAIL = re.compile(r"""(?:\\[nr]|[\s"'`+,;>|#*\\])*([A-Za-z0-9+/=_]{1,15})(?=(?:\\[nr]|[\s"'`+,;>|#*\\])*-----END)""")


@dataclass(frozen=True)
class Novelty:
    """before: characters of context on each side, in which a sensitive word counts; least: marginal compressed bytes a character, beside
    `fixed` ones that any string takes; identifiers: the most words of the corpus that the dictionary takes (a documented bound); in_texts: the least texts with such a word."""

    before: int = 400
    least: float = 0.62
    fixed: float = 1.0
    identifiers: int = 2_000
    in_texts: int = 3


def learn_identifiers(docs: DataFrame, settings: Novelty = Novelty()) -> str:
    """The corpus' own words for the compressor's dictionary: the words of 4 to 15 letters, alone or as parts of identifiers (between
    signs, digits and humps), that most texts with a sensitive word hold, rarest first. Columns only, summed up before the shuffle; at
    most settings.identifiers words come here.

    A word is lower case but for its first letter and ends where its letters end. So no string that is long enough to be reported is
    learnt, nor more than a few letters of a random one, however many copies of it there are.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.lower("text").rlike("|".join(map(re.escape, SENSITIVE))))
    parts = F.regexp_extract_all("text", F.lit(r"(?<![a-z])[a-z]{4,15}(?![a-z])|[A-Z][a-z]{3,14}(?![a-z])"), F.lit(0))
    each = texts.select(F.explode(F.array_distinct(parts)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= settings.in_texts)
    rows = each.orderBy(F.desc("n"), "word").limit(settings.identifiers).collect()
    return " ".join(row["word"] for row in reversed(rows))


@lru_cache(4)
def compressor(learnt: str = ""):
    import zstandard

    words = zstandard.ZstdCompressionDict(f"{learnt} {IDENTIFIERS}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=9)
    return zstandard.ZstdCompressor(level=9, dict_data=words, write_checksum=False, write_content_size=False)


def marginal_bytes(context: str, candidate: str, learnt: str = "") -> int:
    """Compressed bytes that the candidate adds after its context, with the identifier dictionaries primed."""
    zstd, base = compressor(learnt), context.encode("utf-8", "replace")
    return len(zstd.compress(base + candidate.encode())) - len(zstd.compress(base))


def alphabet_bytes(candidate: str) -> float:
    """Bytes that a character of the string can carry at most, by the alphabets that it draws on: digits, small and capital letters, signs.

    A compressor that knows no frequencies spends nearly a byte on any character that it has not seen in this order, so that the number of a
    card or account looks as novel as a key. What ten digits can tell bounds that from above.
    """
    kinds = ((10, str.isdigit), (26, str.islower), (26, str.isupper), (8, lambda c: not c.isalnum()))
    return math.log2(sum(size for size, holds in kinds if any(map(holds, candidate)))) / 8


def around(text: str, start: int, end: int, settings: Novelty) -> str:
    """The surrounding text on both sides of a span."""
    return text[max(0, start - settings.before) : start] + "\n" + text[end : end + settings.before] + "\n"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches, leftmost and non-overlapping for each kind."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]], settings: Novelty = Novelty(), learnt: str = "") -> list[tuple[int, int, int]]:
    """Strings of 16 characters or more in sensitive context, outside base spans, that context and dictionaries hardly compress.

    Strings that only line ends or quotes part, as the lines of a key, are in context together as long as each hardly compresses.
    """
    low = text.lower()
    words = [m.start() for m in SENSITIVE_WORD.finditer(text)] if any(word in low for word in SENSITIVE) else []
    if not words:
        return []

    def in_context(start: int, end: int) -> bool:
        k = bisect_left(words, start - settings.before)
        if k < len(words) and words[k] < start:
            return True
        k = bisect_left(words, end)
        return k < len(words) and words[k] < end + settings.before

    def novel(start: int, end: int) -> bool:
        # the alphabet first: it costs nothing, and without it the measure tells what was not seen before, not what is incompressible
        if alphabet_bytes(text[start:end]) < settings.least:
            return False
        return marginal_bytes(around(text, start, end, settings), text[start:end], learnt) >= settings.least * (end - start) + settings.fixed

    found: list[tuple[int, int, int]] = []
    for pattern in (CANDIDATE, SIGNED):
        taken: list[tuple[int, int, bool]] = []  # what counts already, without overlaps; it carries context on
        for s, _, e in sorted(base + found):
            if taken and s < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(e, taken[-1][1]), True)
            else:
                taken.append((s, e, True))
        parts = []
        for m in pattern.finditer(text):
            k = bisect_left(taken, (m.end(),))  # the last that starts before the string's end
            if not k or taken[k - 1][1] <= m.start():
                parts.append((m.start(), m.end(), False))
        runs: list[list[tuple[int, int, bool]]] = []
        for part in sorted(parts + taken):
            if runs and SEAM.fullmatch(text, runs[-1][-1][1], part[0]):
                runs[-1].append(part)
            else:
                runs.append([part])
        for run in runs:
            if not any(known or in_context(s, e) for s, e, known in run):
                continue
            held: list[tuple[int, int, bool]] = []
            for part in [*run, None]:
                if part is not None and (part[2] or novel(*part[:2])):
                    held.append(part)
                    continue
                if any(known or in_context(s, e) for s, e, known in held):
                    found += [(s, 3, e) for s, e, known in held if not known]
                    tail = TAIL.match(text, held[-1][1])
                    if tail and not any(s < tail.end(1) and tail.start(1) < e for s, _, e in base + found):
                        found.append((tail.start(1), 3, tail.end(1)))
                held = []
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


FOUND = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_novel", pa.int64()), ("added_bytes", pa.string())])
FOUND_SQL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long, added_bytes string"


def find_secrets(docs: DataFrame, settings: Novelty = Novelty()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel, added_bytes for every whole text; spans are kind:start:end in code points.

    added_bytes gives for each span, base ones too, the compressed bytes that it adds to its surroundings, as evidence; base spans stay
    whatever these are. A null text is empty and has no spans (the hash of the empty string); null ids stay null; repeated rows are all
    returned; very long texts are scanned whole; further columns are left out; an empty table gives an empty result. The dictionary is
    learnt from all texts by one aggregate; the scan is a narrow pass.
    """
    learnt = learn_identifiers(docs, settings)

    def scan(batches):
        for batch in batches:
            out = [[] for _ in FOUND]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(text)
                spans = sorted(base + novel_spans(text, base, settings, learnt))
                counts = [sum(kind == k for _, kind, _ in spans) for k in range(4)]
                added = ",".join(str(marginal_bytes(around(text, a, b, settings), text[a:b], learnt)) for a, _, b in spans)
                for column, value in zip(out, (doc_id, *counts[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), counts[3], added), strict=True):
                    column.append(value)
            yield batch_of(FOUND, out)

    return id_and_text(docs).mapInArrow(scan, FOUND_SQL)


def redact(docs: DataFrame, mask: str = "[secret]", settings: Novelty = Novelty()) -> DataFrame:
    """docs (text, and n_chars if there is one) with every span replaced by the mask; all other columns and rows as they are.

    Null texts stay null, repeated rows are all masked alike, an empty table stays empty.
    """
    learnt = learn_identifiers(docs, settings)
    schema, text_at = docs.schema, docs.columns.index("text")
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(batches):
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            counts = batch.column(count_at).to_pylist() if count_at is not None else None
            for i, text in enumerate(texts):
                if not text:
                    continue
                base = base_spans(text)
                spans = sorted(base + novel_spans(text, base, settings, learnt))
                if not spans:
                    continue
                parts, at = [], 0
                for start, _, end in spans:
                    if start >= at:
                        parts += [text[at:start], mask]
                    elif end > at:
                        parts.append("")
                    at = max(at, end)
                texts[i] = "".join([*parts, text[at:]])
                if counts is not None:
                    counts[i] = len(texts[i])
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            if counts is not None:
                columns[count_at] = pa.array(counts, batch.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return small_batches(docs).mapInArrow(clean, schema)
