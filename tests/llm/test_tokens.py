import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from townkit.llm import tokens

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def strings():
    r = random.Random(3)
    alphabet = "ab'sStT rRe lLvVmMdD1 2\n\t  .,!-_ñÉß€–½² ªİ中文 ́😀"
    mixed = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    return [*mixed, "", "a<|endoftext|>b", "<|startoftext|>", "x" * 3000, "'re", "it's they'LL", "   a", "a   ", "\r\n"]


def test_counts_are_the_tokenizers(strings):
    path = tokens.vocabulary_path(BYTES)
    expected = [len(e.ids) for e in tokens.tokenizer(path).encode_batch(strings, add_special_tokens=False)]
    assert tokens.count_tokens(strings, path) == expected


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_ids_are_the_tokenizers(strings, name):
    expected = tokens.tokenizer(tokens.vocabulary_path(name)).encode_batch(strings, add_special_tokens=False)
    found = tokens.chunk_ids(name).encode(strings)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [e.ids for e in expected]


def encoded(text):
    return len(tokens.tokenizer(tokens.vocabulary_path(BYTES)).encode(text, add_special_tokens=False).ids)


def mixed_texts(n, seed, length=50):
    r = random.Random(seed)
    alphabets = ["abcdefgh éß1 '\n.st", "ab'sStTrRelLvVmMdD1 2\n\t\x0b\x1c\x85\xa0\u2003\u3000  .,!-_ñÉß€–½² ªİ中文 ́😀", "Москва музей и парк 12 ", "北京博物馆，公园 と かな "]
    pieces = ["<|endoftext|>", "<|endof", "<|", " <|endoftext|>", "'re", "'ll", "   ", "they've"]
    return ["".join(r.choice(pieces) if r.random() < 0.05 else r.choice(alphabets[k % 4]) for _ in range(r.randint(0, length))) for k in range(n)]


def test_every_prefix():
    """Of any script, inside chunks, contractions, spaces and special strings."""
    counter = tokens.prefix_counts(tokens.vocabulary_path(BYTES))
    fixed = ["The museum's unbelievable 12345 dinosaurs!!  Don't they'll \n\n x", "", "a<|endoftext|><|endoftext|> b", "x !<|endoftext|>'re", "  <|endoftext|>  ", "中文<|endoftext|>É"]
    for text in [*fixed, *mixed_texts(160, 6)]:
        assert counter.prefixes(text).tolist() == [encoded(text[:n]) for n in range(len(text) + 1)], text


def test_cuts_and_budgets_in_columns(spark):
    texts = [*mixed_texts(60, 8), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = tokens.prefix_table(docs)
    budget = F.col("doc_id").cast("int") % 25
    rows = table.select("doc_id", "text", tokens.tokens_at(budget).alias("at"), tokens.longest_within(budget).alias("longest"), tokens.truncated(budget).alias("cut")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text, b = texts[row["doc_id"]] or "", row["doc_id"] % 25
        longest = max(n for n in range(len(text) + 1) if encoded(text[:n]) <= b)
        assert row["text"] == text and row["at"] == encoded(text[:b]) and row["longest"] == longest and row["cut"] == text[:longest]


def test_prefixes_of_awkward_rows(awkward, no_documents):
    rows = tokens.prefix_table(awkward).selectExpr("doc_id", "text", "prefixes[size(prefixes) - 1] AS n", "size(prefixes) AS size").collect()
    assert sorted(repr((r["doc_id"], r["size"], r["n"])) for r in rows) == sorted(repr((r["doc_id"], len(r["text"] or "") + 1, encoded(r["text"] or ""))) for r in awkward.collect())
    assert tokens.prefix_table(no_documents).count() == 0


def test_awkward_rows(awkward, no_documents):
    tokenizer = tokens.tokenizer(tokens.vocabulary_path(BYTES))
    expected = sorted(repr((r["doc_id"], len((r["text"] or "").encode()), n := len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids), n > 512)) for r in awkward.collect())
    assert sorted(repr(tuple(r)) for r in tokens.token_counts(awkward).collect()) == expected
    assert tokens.token_counts(no_documents).count() == 0
