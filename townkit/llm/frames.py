"""Token-id files: independent zstandard frames, a checksum for each, and a seek table at the end."""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from townkit.llm.shared import batch_of, id_and_text, shared_dir
from townkit.llm.tokens import chunk_ids

# A file is frames, then the seek table, then a footer.
#   frame       one zstandard frame (with its own checksum) of: for each document its ids, as unsigned 16 or 32-bit little-endian
#   seek table  one zstandard frame of: for each frame (offset, bytes, documents, crc32 of the compressed frame), then for each
#               document (id, is-null, tokens)
#   footer      offset of the seek table, its bytes, number of frames, number of documents, bytes an id, crc32 of the table, magic
FRAME = np.dtype([("offset", "<u8"), ("size", "<u8"), ("documents", "<u4"), ("crc", "<u4")])
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("tokens", "<u8")])
FOOTER = struct.Struct("<QQQQBI8s")
MAGIC = b"TKFRAME1"
#: Bytes of ids in a frame: what a reader must decompress for one document, documents of more alone.
FRAME_BYTES = 1 << 18


class FrameWriter:
    """Appends documents to an open binary file and ends it with the seek table."""

    def __init__(self, out, width: int = 2, frame_bytes: int = FRAME_BYTES, level: int = 1):
        import zstandard

        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames, self.held, self.held_bytes, self.at = [], [], 0, 0
        # 17 bytes a document
        self.ids, self.nulls, self.tokens = array("q"), array("B"), array("Q")

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        if self.held and self.held_bytes + len(data) > self.frame_bytes:
            self.flush()
        self.held.append(data)
        self.held_bytes += len(data)
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.tokens.append(len(ids))

    def flush(self) -> None:
        if self.held:
            frame = self.zstd.compress(b"".join(self.held))
            self.frames.append((self.at, len(frame), len(self.held), zlib.crc32(frame)))
            self.out.write(frame)
            self.at += len(frame)
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self.flush()
        entries = np.zeros(len(self.ids), ENTRY)
        entries["doc_id"], entries["null"], entries["tokens"] = self.ids, self.nulls, self.tokens
        table = self.zstd.compress(np.array(self.frames, FRAME).tobytes() + entries.tobytes())
        self.out.write(table + FOOTER.pack(self.at, len(table), len(self.frames), len(entries), self.width, zlib.crc32(table), MAGIC))


class FrameReader:
    """Reads the seek table of a file, then only the frames of the documents asked for."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        end = source.seek(0, 2)
        source.seek(end - FOOTER.size)
        at, size, n_frames, n_docs, self.width, crc, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        source.seek(at)
        table = source.read(size)
        if zlib.crc32(table) != crc:
            raise ValueError("the seek table is damaged")
        table = self.zstd.decompress(table)
        self.frames = np.frombuffer(table, FRAME, n_frames)
        self.entries = np.frombuffer(table, ENTRY, n_docs, n_frames * FRAME.itemsize)
        self.first = np.concatenate([[0], np.cumsum(self.frames["documents"])]).astype(int)

    def frame(self, k: int) -> list[np.ndarray]:
        """The ids of each document of frame k."""
        f = self.frames[k]
        self.source.seek(int(f["offset"]))
        data = self.source.read(int(f["size"]))
        if zlib.crc32(data) != f["crc"]:
            raise ValueError(f"frame {k} is damaged")
        ids = np.frombuffer(self.zstd.decompress(data), "<u2" if self.width == 2 else "<u4")
        return np.split(ids, np.cumsum(self.entries["tokens"][self.first[k] : self.first[k + 1]])[:-1].astype(int))

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file."""
        k = int(np.searchsorted(self.first, i, "right")) - 1
        return self.frame(k)[i - self.first[k]]

    def places(self, doc_ids: np.ndarray) -> np.ndarray:
        """Places in the file of all documents of these ids; entries rise by id, null ids first."""
        nulls = int(self.entries["null"].sum())
        known = self.entries["doc_id"][nulls:]
        return np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) + nulls for a, b in zip(np.searchsorted(known, doc_ids), np.searchsorted(known, doc_ids, "right"), strict=True))])

    def documents(self, places: np.ndarray):
        """(id, ids) of the documents at these rising places; a frame is read once."""
        held, at = None, -1
        for i in places.tolist():
            k = int(np.searchsorted(self.first, i, "right")) - 1
            if k != at:
                held, at = self.frame(k), k
            entry = self.entries[i]
            yield None if entry["null"] else int(entry["doc_id"]), held[i - self.first[k]]

    def __iter__(self):
        for k in range(len(self.frames)):
            for entry, ids in zip(self.entries[self.first[k] : self.first[k + 1]], self.frame(k), strict=True):
                yield None if entry["null"] else int(entry["doc_id"]), ids


@lru_cache(8)
def filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


@dataclass
class TokenFiles:
    """The folder and the Spark table of its files: part, file, path, n_docs, n_tokens, first_id, last_id, start (tokens in the files before it)."""

    folder: str
    manifest: DataFrame


MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])
MANIFEST_SQL = "part long, file long, path string, n_docs long, n_tokens long, first_id long, last_id long"
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
#: Bytes of text that one writing task gets, ids that one file holds, and documents that one file holds.
TASK_BYTES, FILE_BYTES, FILE_DOCUMENTS = 512 << 20, 256 << 20, 1_000_000
#: Documents of a batch that a reader hands on.
READ_AT_ONCE = 2_000


def write_token_files(
    docs: DataFrame, folder: str | None = None, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, tasks: int | None = None, file_bytes: int = FILE_BYTES, file_documents: int = FILE_DOCUMENTS
) -> TokenFiles:
    """Encodes every whole text and writes its ids, with end_id after each, to files of rising doc_id (part by part, file by file).

    Null texts are empty: only the end id. Null doc_ids come first; rows of equal doc_ids are in the order of a hash of their text. An
    empty table makes no file. A very long text is a frame of its own. Spark ranges the rows by doc_id, and within an id by text and
    row, so that no id makes one task long; there are as many tasks as the session has shuffle partitions, more where these would get
    over TASK_BYTES. A task goes on to its next file at file_bytes or file_documents, and moves each file into its place when it is
    whole, so a task that runs twice leaves the same files.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    texts = id_and_text(docs)
    if tasks is None:
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    keyed = texts.withColumns({"text_hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(tasks, "doc_id", "text_hash", "row").sortWithinPartitions("doc_id", "text_hash").select("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = filesystem(folder)
        encoder, writer, file = chunk_ids(vocabulary), None, 0
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4

        def whole():
            writer.close()
            out.close()
            name = f"{root}/part-{part:06d}-{file:04d}.tok"
            store.move(own, name)
            known = [i for i, null in ((writer.ids[0], writer.nulls[0]), (writer.ids[-1], writer.nulls[-1])) if not null]
            first = known[0] if len(known) == 2 else -(2**63) if known else None  # null ids come first
            return batch_of(MANIFEST, [[part], [file], [name], [len(writer.ids)], [sum(writer.tokens)], [first], [known[-1] if known else None]])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    own = f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(own)
                    writer, held = FrameWriter(out, width), 0
                writer.add(doc_id, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
                held += len(ids) * width // 4
                if held >= file_bytes or len(writer.ids) >= file_documents:
                    yield whole()
                    writer, file = None, file + 1
        if writer is not None:
            yield whole()

    # one small row a file, kept beside the files: reading does not write them again
    ordered.mapInArrow(write, MANIFEST_SQL).write.parquet(f"{folder}/manifest")
    return TokenFiles(folder, open_token_files(spark, folder))


def open_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row a file; the running sum needs them in one order, and files are few against documents."""
    manifest = spark.read.schema(MANIFEST_SQL).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files: frames are checked, decompressed and handed on one by one."""
    folder = files.folder

    def read(batches):
        store, _ = filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = [[] for _ in READ]
                with store.open_input_file(path) as source:
                    for doc_id, ids in FrameReader(source):
                        for column, value in zip(out, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            column.append(value)
                        start += len(ids)
                        if len(out[0]) >= READ_AT_ONCE:
                            yield batch_of(READ, out)
                            out = [[] for _ in READ]
                yield batch_of(READ, out)

    parts = files.manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return files.manifest.select("path", "start").repartition(int(parts), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])


def documents_of(files: TokenFiles, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the documents asked for (a list that the caller holds): only files whose range of ids has one of them are opened,
    and only the frames that hold one are read. Ids that no document has give no row; of repeated ids every document is returned."""
    wanted, folder = sorted(set(doc_ids)), files.folder
    has_one = F.exists(F.array(*map(F.lit, wanted)), lambda i: (i >= F.col("first_id")) & (i <= F.col("last_id"))) if wanted else F.lit(False)

    def read(batches):
        store, _ = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as source:
                    reader = FrameReader(source)
                    for doc_id, ids in reader.documents(reader.places(np.array(wanted, np.int64))):
                        yield batch_of(DOCUMENTS, [[doc_id], [ids]])

    return files.manifest.where(F.col("last_id").isNotNull() & has_one).select("path").mapInArrow(read, "doc_id long, ids array<long>")
