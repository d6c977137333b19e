import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from townkit.llm import frames, tokens


def file_of(documents, width=2, frame_bytes=64):
    out = io.BytesIO()
    writer = frames.FrameWriter(out, width, frame_bytes)
    for doc_id, ids in documents:
        writer.add(doc_id, np.array(ids, "<u4"))
    writer.close()
    return out


@pytest.mark.parametrize("width", [2, 4])
def test_round_trip_and_single_documents(width):
    docs = [(i if i % 5 else None, list(range(i % 40))) for i in range(100)]
    reader = frames.FrameReader(file_of(docs, width))
    assert [(d, ids.tolist()) for d, ids in reader] == docs
    assert len(reader.frames) > 5
    for i in (0, 1, 50, 99):
        assert reader.document(i).tolist() == docs[i][1]


def test_a_reader_reads_only_the_frames_it_needs():
    source = file_of([(i, list(range(30))) for i in range(200)])
    reads = []

    class Watched(io.BytesIO):
        def read(self, n=-1):
            reads.append(n)
            return super().read(n)

    reader = frames.FrameReader(Watched(source.getvalue()))
    reads.clear()
    reader.document(120)
    assert len(reads) == 1 and reads[0] < len(source.getvalue()) / 50


def test_damage_is_found():
    data = bytearray(file_of([(i, list(range(30))) for i in range(20)]).getvalue())
    data[10] ^= 1
    with pytest.raises(ValueError, match="frame 0"):
        frames.FrameReader(io.BytesIO(bytes(data))).document(0)
    data = bytearray(file_of([(1, [1])]).getvalue())
    data[-frames.FOOTER.size - 2] ^= 1
    with pytest.raises(ValueError, match="seek table"):
        frames.FrameReader(io.BytesIO(bytes(data)))
    with pytest.raises(ValueError, match="not a"):
        frames.FrameReader(io.BytesIO(b"x" * 100))


def test_empty_file():
    assert list(frames.FrameReader(file_of([]))) == []


def encoded(text):
    tokenizer = tokens.tokenizer(tokens.vocabulary_path("word_bpe_49k.json"))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("settings", [{"tasks": 3}, {}, {"tasks": 2, "file_documents": 1}, {"tasks": 2, "file_bytes": 200}])
def test_documents_are_read_back(awkward, settings):
    """Whatever the tasks and files, starts go on from file to file in the order of ids."""
    rows = awkward.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    expected, start = [], 0
    for r in rows:
        ids = encoded(r["text"])
        expected.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    files = frames.write_token_files(awkward, **settings)
    found = frames.read_token_files(files).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    if "file_documents" in settings:
        assert files.manifest.count() == len(rows)


def test_only_the_documents_asked_for(awkward, no_documents):
    files = frames.write_token_files(awkward, tasks=3, file_bytes=300)
    texts = [(r["doc_id"], encoded(r["text"])) for r in awkward.collect()]
    for wanted in ([7, 3, 99], [6], [], list(range(20))):
        found = sorted((r["doc_id"], r["ids"]) for r in frames.documents_of(files, wanted).collect())
        assert found == sorted(x for x in texts if x[0] in wanted)
    assert frames.read_token_files(frames.write_token_files(no_documents)).count() == 0


def test_an_id_of_many_rows_is_no_single_task(spark):
    files = frames.write_token_files(spark.range(900).selectExpr("1 AS doc_id", "concat('w', id % 3) AS text"), tasks=4)
    sizes = [r["n_docs"] for r in files.manifest.collect()]
    assert sum(sizes) == 900 and len(sizes) == 4 and max(sizes) < 450
