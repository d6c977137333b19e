"""Token counts and token ids of whole texts.

A byte-pair tokenizer first cuts a text into chunks and never merges across them. Both halves here rest on that: `PrefixCounts`
runs a prefix dynamic programme over the bytes of each distinct chunk, and `ChunkIds` asks the tokenizer for each distinct chunk once.
Special strings are set apart first. Where all characters are of a plain range, a pattern cuts the chunks; elsewhere the tokenizer's own cutter.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townkit.llm.shared import batch_of, id_and_text, text_groups

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼½¾"
#: A text with any other character is left to the tokenizer's own rules for Unicode.
OTHER_CHARACTER = re.compile("[^\t\n\r -~¡-įı-ɏ‐-‧‰-⁞€]")
#: How the two vocabularies cut texts, for texts without other characters.
BYTE_CHUNKS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
WORD_CHUNKS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: The characters that Unicode calls white space.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Chunks that a Python worker remembers; beyond that it starts anew.
REMEMBERED = 300_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable, else the next code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounts:
    """Exact token counts of every prefix, by dynamic programming over a byte-pair vocabulary.

    For each prefix of a chunk the programme keeps the last token of its encoding and the number of tokens. The encoding of a
    prefix ends in the token t exactly if the encoding of the shorter prefix before t ends in a token that byte-pair merging
    leaves apart from t; one such t exists for each prefix, so that no text is encoded again for another cut.
    """

    def __init__(self, path: str):
        import regex

        whole = json.loads(open(path, encoding="utf-8").read())
        model, added = whole["model"], sorted((t["content"] for t in whole["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.cutter = tokenizer(path).pre_tokenizer
        alphabet = byte_alphabet()
        spelled = {token: bytes(map(alphabet.__getitem__, token)) for token in model["vocab"] if all(c in alphabet for c in token)}
        self.ids = {spelled[token]: i for token, i in model["vocab"].items() if token in spelled}
        self.longest = max(map(len, self.ids))
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            whole = model["vocab"][left + right]
            halves = (model["vocab"][left], model["vocab"][right])
            self.merged[halves] = rank
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = halves, rank
        self.apart: dict[tuple[int, int], bool] = {}
        self.counts: dict[str, int] = {}

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of left and right ends in just these two tokens.

        Walks back through the merges that built the two, latest first: at each moment the tokens that touch at the border must
        not have a merge of a lower rank than the one that is undone next, or merging would have crossed the border then.
        """
        rank, parts, merged = self.rank, self.parts, self.merged
        limit = len(merged)
        while True:
            crossing = merged.get((left, right))
            if crossing is not None and crossing < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # the left token was built later; of equal ranks the left one is built first
                limit, left = a, parts[left][1]
            else:
                limit, right = b + 1, parts[right][0]

    def of_bytes(self, data: bytes) -> list[int]:
        """Token counts of the prefixes of one chunk by length in bytes, the empty one first."""
        ids, apart, longest = self.ids, self.apart, self.longest
        last, counts = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = ids.get(data[start:end])
                if token is None:
                    continue
                if start:
                    pair = (last[start], token)
                    fits = apart.get(pair)
                    if fits is None:
                        if len(apart) > REMEMBERED // 2:
                            apart.clear()
                        fits = apart[pair] = self.stay_apart(*pair)
                    if not fits:
                        continue
                last[end], counts[end] = token, counts[start] + 1
                break
        return counts

    def of_chunk(self, chunk: str) -> int:
        return self.of_bytes(chunk.encode("utf-8", "replace"))[-1]

    def learn(self, chunks: set[str]) -> dict[str, int]:
        counts = self.counts
        if len(counts) > REMEMBERED:
            counts.clear()
        for chunk in chunks if not counts else chunks.difference(counts):
            counts[chunk] = self.of_chunk(chunk)
        return counts

    def segments(self, text: str) -> list[tuple[int, int, bool]]:
        """(start, end, whether it is a special string) of the parts of a text that are cut into chunks by themselves."""
        if self.special is None or "<" not in text:
            return [(0, len(text), False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(at, m.start(), False), (m.start(), m.end(), True)]
            at = m.end()
        return [*out, (at, len(text), False)]

    def chunks(self, segment: str) -> list[str]:
        if not OTHER_CHARACTER.search(segment):
            return BYTE_CHUNKS.findall(segment)
        return [segment[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(segment)]

    def cut(self, text: str) -> tuple[list[str], int]:
        """(chunks of a whole text, special strings in it)."""
        parts = self.segments(text)
        return [c for a, b, special in parts if not special for c in self.chunks(text[a:b])], sum(special for *_, special in parts)

    def prefixes(self, text: str) -> np.ndarray:
        """Exact token counts of text[:n] for n = 0 ... len(text), as if each prefix were encoded by itself."""
        out = np.zeros(len(text) + 1, np.int32)
        total = 0  # tokens of all before the segment
        for start, end, special in self.segments(text):
            if special:
                # a prefix that ends inside the special string is plain text from the last chunk before it on
                for n in range(start + 1, end):
                    out[n] = total_before + sum(map(self.of_chunk, self.chunks(text[tail:n])))
                total = out[end] = out[start] + 1
                continue
            at, tail, total_before = start, start, total
            segment = text[start:end]
            for chunk in self.chunks(segment):
                tail, total_before = at, total
                counts, place = self.of_bytes(chunk.encode("utf-8", "replace")), 0
                for k, c in enumerate(chunk, at + 1):
                    place += 1 if c < "\x80" else len(c.encode("utf-8", "replace"))
                    out[k] = total + counts[place]
                if len(chunk) == 3 and chunk in CONTRACTIONS:  # "'r" of "'re" is no contraction: two chunks
                    out[at + 2] = total + self.of_chunk(chunk[0]) + self.of_chunk(chunk[1])
                at += len(chunk)
                total = total + counts[-1]
            # spaces at the end of a prefix are one chunk, whatever follows them
            for m in SPACES.finditer(segment):
                counts, place, a = self.of_bytes(m[0].encode()), 0, start + m.start()
                for k, c in enumerate(m[0], a + 1):
                    place += len(c.encode())
                    out[k] = out[a] + counts[place]
            out[end] = total
        return out


def is_plain(text: str) -> bool:
    return "<|" not in text and not OTHER_CHARACTER.search(text)


@lru_cache(2)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text as the tokenizer gives them."""
    counter, out = prefix_counts(path), [0] * len(texts)
    for start, end in text_groups(texts):
        cut = list(map(counter.cut, texts[start:end]))
        counts = counter.learn(set(chain.from_iterable(chunks for chunks, _ in cut)))
        for i, (chunks, special) in enumerate(cut, start):
            out[i] = sum(map(counts.__getitem__, chunks)) + special
    return out


COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    A null text counts as empty: 0 bytes, 0 tokens. A null doc_id stays null, repeated rows are all returned, further columns are
    left out, and an empty table gives an empty result. Very long texts are counted whole. One narrow pass: no shuffle. The counts are
    the last ones of the prefix programme; `prefix_table` keeps all of them. The vocabulary is a byte-level .json file name.
    """

    def count(batches):
        path = vocabulary_path(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = count_tokens(texts, path)
            yield batch_of(COUNTED, [batch.column(0), [len(t.encode("utf-8", "replace")) for t in texts], n, [x > limit for x in n]])

    return id_and_text(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


PREFIXES = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("prefixes", pa.list_(pa.int32()))])


def prefix_table(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, text, and prefixes: element n is the exact token count of the first n characters (element 0 of none).

    Once it is written, `tokens_at`, `longest_within` and `truncated` answer questions of cuts and budgets in columns, without encoding
    a text again. Nulls, repeats, further columns and empty tables are as in `token_counts`. One narrow pass; four bytes a character,
    so a batch is cut where it holds many of them.
    """

    def count(batches):
        counter = prefix_counts(vocabulary_path(vocabulary))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_groups(texts):
                yield batch_of(PREFIXES, [batch.column(0).slice(a, b - a), texts[a:b], [counter.prefixes(t) for t in texts[a:b]]])

    return id_and_text(docs).mapInArrow(count, "doc_id long, text string, prefixes array<int>")


def tokens_at(n_chars: Column, prefixes: str = "prefixes") -> Column:
    """Tokens of the first n_chars characters (of all, if there are fewer)."""
    return F.element_at(F.col(prefixes), F.least(n_chars, F.size(prefixes) - 1) + 1)


def longest_within(budget: Column, prefixes: str = "prefixes") -> Column:
    """Characters of the longest prefix of at most `budget` tokens. Counts can fall where a character completes a longer token."""
    return F.size(prefixes) - F.array_position(F.reverse(F.transform(F.col(prefixes), lambda n: n <= budget)), True)


def truncated(budget: Column, prefixes: str = "prefixes") -> Column:
    """The longest prefix of the text of at most `budget` tokens."""
    return F.substring(F.col("text"), F.lit(1), longest_within(budget, prefixes).cast("int"))


class ChunkIds:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes; each distinct chunk goes through the tokenizer once."""

    def __init__(self, path: str, pattern: re.Pattern, lower: bool):
        self.tokenizer, self.pattern, self.lower = tokenizer(path), pattern, lower
        self.spelling = {b: c for c, b in byte_alphabet().items()}
        self.known: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        """A chunk is one word of the model, spelled in the byte alphabet."""
        tokenize, spelling, pack = self.tokenizer.model.tokenize, self.spelling, [struct.Struct(f"<{n}I").pack for n in range(64)]
        for chunk in chunks:
            ids = [t.id for t in tokenize(chunk.encode().decode("latin-1").translate(spelling))]
            self.known[chunk] = pack[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        find, known = self.pattern.findall, self.known
        for start, end in text_groups(texts):
            cut = [(find(t.lower()) if self.lower else find(t)) if is_plain(t) else None for t in texts[start:end]]
            chunks = set(chain.from_iterable(c for c in cut if c))
            if len(known) > REMEMBERED:
                known.clear()
            self.learn(chunks.difference(known) if known else chunks)
            for i, c in enumerate(cut, start):
                out[i] = b"".join(map(known.__getitem__, c)) if c is not None else as_bytes(self.tokenizer.encode(texts[i], add_special_tokens=False))
        return out


def as_bytes(encoding) -> bytes:
    return np.array(encoding.ids, "<u4").tobytes()


@lru_cache(2)
def chunk_ids(name: str) -> ChunkIds:
    """Of the two vocabularies whose cutting rules are known here."""
    pattern, lower = {"byte_bpe_50k.json": (BYTE_CHUNKS, False), "word_bpe_49k.json": (WORD_CHUNKS, True)}[name]
    return ChunkIds(vocabulary_path(name), pattern, lower)
