import ast
import random
import zlib

import numpy as np

import corpus_pipeline
from townkit.llm import contamination, credentials, jaccard, packing, tokens, toxicity
from townkit.llm.queries import ORACLE_SQL, QUERIES

from .conftest import sentence
from .test_contamination import brute as contaminated
from .test_jaccard import brute as classes_of
from .test_toxicity import plain_scores

DATA = "/root/testdata/sf0.001"


def test_stages_hand_on_what_they_keep(spark):
    labels, benchmark = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, DATA).cache()
        assert after.columns == columns, name
        kept, before = ids(after), ids(docs)
        if k == 0:
            gone = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
        elif k == 1:
            gone = {r["doc_id"] for r in jaccard.jaccard_classes(docs).where("doc_id <> class_id").collect()}
        elif k == 2:
            gone = {r["doc_id"] for r in contamination.contaminated(docs, benchmark).collect()}
        else:
            gone = set()
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all((r["text"] != texts[r["doc_id"]]) == bool(credentials.base_spans(texts[r["doc_id"]] or "") or credentials.novel_spans(texts[r["doc_id"]] or "", [])) for r in after.collect())
        assert kept == [i for i in before if i not in gone], name
        docs = after
    assert sorted({r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()}) == ids(docs)


def test_against_brute_force(spark, tmp_path):
    """The whole pipeline over a small table: every stage by its definition, from the brute-force versions of the operators' tests."""
    r = random.Random(21)
    items = [(k, sentence(900 + k, 12)) for k in range(3)]
    docs = []
    for i in range(80):
        text = sentence(i, r.randint(20, 60))
        if i % 4 == 0:
            text += " grumpo nastix vilefy" * 3
        if i % 9 == 1:
            text = docs[r.randrange(len(docs))][1]
        if i % 13 == 5:
            text += " " + items[i % 3][1]
        if i % 10 == 7:
            text += f' password = "{sentence(i, 1)}abc{i}" and AKIAABCDEFGHIJKLMN{i:02d}'
        docs.append((i, text))
    docs += [(90, None), (91, ""), (92, "word " * 3000)]
    labelled = [(i, int("grumpo" in (t or ""))) for i, t in docs if i % 3]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labelled, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    scores = plain_scores(docs, labelled, toxicity.Settings())
    assert None not in scores.values()
    kept = [(i, t) for i, t in docs if scores[i] < 0.5]
    classes = {ast.literal_eval(x)[0]: ast.literal_eval(x)[1] for x in classes_of(kept)}
    kept = [(i, t) for i, t in kept if classes[i] == i]
    dirty = {ast.literal_eval(x)[0] for x in contaminated(kept, items)}
    kept = [(i, t) for i, t in kept if i not in dirty]
    assert len(docs) - 10 > len(kept) > 40 and dirty
    tokenizer, expected = tokens.tokenizer(tokens.vocabulary_path("byte_bpe_50k.json")), []
    for i, t in kept:
        text, at = "", 0
        for start, _, end in credentials.base_spans(t or ""):
            text, at = text + (t[at:start] + "[secret]" if start >= at else ""), max(at, end)
        ids, start = [*tokenizer.encode(text + (t or "")[at:], add_special_tokens=False).ids, 0], 0
        for k, length in enumerate(packing.cut_lengths(len(ids), 2048)):
            expected.append((i, k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
            start += length
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(x)[:5] for x in found) == sorted(expected)


def test_stages_on_awkward_and_empty_documents(spark, awkward, no_documents):
    for name, stage in corpus_pipeline.STAGES:
        after, empty = stage(spark, awkward, DATA), stage(spark, no_documents, DATA)
        assert empty.count() == 0
        if name == "best_fit_packing":
            assert after.select("doc_id").distinct().count() == awkward.select("doc_id").distinct().count()
        else:
            assert after.columns == awkward.columns and [r["doc_id"] for r in after.collect() if r["text"] is None].count(3) == 1


def test_queries_are_named_by_number():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
