"""Token-ID files: independent zstandard frames, a trailing seek table, per-frame checksums.

Layout of one file (all integers little-endian):

* data frames: each a zstandard frame of its own over whole documents' ids (uint16 if the
  vocabulary fits, else uint32), cut when ``FRAME_BYTES`` are reached; a longer document is
  alone in its frame;
* a skippable frame (0x184D2A50) with the zstandard-compressed document index: per document its
  doc_id, whether it is null, its frame, its first id within the frame and its number of ids;
* a skippable frame (0x184D2A5E) with the seek table: per data frame the compressed size, the
  decompressed size and a checksum (crc32 of the decompressed bytes), then the index's sizes and
  checksum, the number of frames, a descriptor byte (bytes per id) and the end magic 0x8F92EAB1.

``read_documents`` fetches the footer, then the index, then only the frames of the documents asked
for, and checks each frame's checksum.

Writing: documents are range-partitioned and sorted by doc_id (ties by text), each task streams
its share into one file of the shared folder, and a manifest row per file is written by Spark.
Only files of the manifest belong to the data, so a repeated or lost task leaves no trace in it.
Added tokens of the tokenizer file that stand in a text get their ids, as by the library's default settings.
Null texts are empty documents (only the end id); null ids come first; repeated rows are
documents of their own; an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paraforge.llm.common import table
from paraforge.llm.pieces import byte_level_encoder
from paraforge.llm.words import slices
from paraforge.session import scratch_path

# Fixed values of the file format.
SEEK_MAGIC = 0x184D2A5E
INDEX_MAGIC = 0x184D2A50
END_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IIIIBI")  # index: compressed, raw, checksum; frames; bytes per id; magic
ENTRY = np.dtype([("packed", "<u4"), ("raw", "<u4"), ("check", "<u4")])
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("first", "<u4"), ("n", "<u4")])

FRAME_BYTES = 1 << 18
LEVEL = 1
MANIFEST = "file string, part long, n_docs long, n_tokens long, n_bytes long"
ROWS = "doc_id long, part long, place long, before long, n_tokens long, ids_crc32 long"


def place_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder of the shared store."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class TokenFileWriter:
    """Streams documents into one file; at most one frame is held in memory."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames, self.index, self.held, self.held_ids = [], [], [], 0
        self.n_docs = self.n_tokens = self.n_bytes = 0

    def add(self, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> None:
        """Add consecutive documents given all their ids and the number of ids of each."""
        if len(ids) and int(ids.max()) >= 1 << (8 * self.width):
            raise ValueError(f"id {int(ids.max())} does not fit {self.width} bytes")
        edge = np.concatenate([[0], np.cumsum(counts)])
        most = FRAME_BYTES // self.width
        at, n = 0, len(counts)
        while at < n:
            room = most - self.held_ids
            end = int(np.searchsorted(edge, edge[at] + room, side="right")) - 1
            if end <= at and self.held_ids:
                self._cut()
                continue
            end = min(n, max(end, at + 1))
            rows = np.zeros(end - at, dtype=INDEX)
            rows["null"] = [x is None for x in doc_ids[at:end]]
            rows["doc_id"] = [0 if x is None else x for x in doc_ids[at:end]]
            rows["frame"], rows["first"] = len(self.frames), self.held_ids + edge[at:end] - edge[at]
            rows["n"] = counts[at:end]
            self.index.append(rows)
            self.held.append(ids[edge[at]:edge[end]].astype(f"<u{self.width}").tobytes())
            self.held_ids += int(edge[end] - edge[at])
            self.n_docs += end - at
            self.n_tokens += int(edge[end] - edge[at])
            at = end
            if self.held_ids >= most:
                self._cut()

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.n_bytes += len(data)

    def _cut(self) -> None:
        raw = b"".join(self.held)
        packed = self.pack.compress(raw)
        self._put(packed)
        self.frames.append((len(packed), len(raw), zlib.crc32(raw)))
        self.held, self.held_ids = [], 0

    def close(self) -> None:
        if self.held:
            self._cut()
        raw = np.concatenate(self.index).tobytes() if self.index else b""
        packed = self.pack.compress(raw)
        self._put(struct.pack("<II", INDEX_MAGIC, len(packed)) + packed)
        table_bytes = np.array(self.frames, dtype=ENTRY).tobytes()
        foot = FOOTER.pack(len(packed), len(raw), zlib.crc32(raw), len(self.frames), self.width, END_MAGIC)
        self._put(struct.pack("<II", SEEK_MAGIC, len(table_bytes) + len(foot)) + table_bytes + foot)


class TokenFileReader:
    """Random access to one file: footer and index first, then single frames."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - FOOTER.size)
        packed, raw, check, frames, self.width, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != END_MAGIC:
            raise ValueError("not a token file, or one that was cut short")
        start = source.size() - FOOTER.size - frames * ENTRY.itemsize
        source.seek(start)
        self.frames = np.frombuffer(source.read(frames * ENTRY.itemsize), dtype=ENTRY)
        source.seek(start - 8 - packed)
        self.index = np.frombuffer(self._unpack(source.read(packed), raw, check), dtype=INDEX)
        self.starts = np.cumsum(self.frames["packed"].astype(np.int64)) - self.frames["packed"]

    @staticmethod
    def _unpack(data: bytes, size: int, check: int) -> bytes:
        raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=size) if size else b""
        if len(raw) != size or zlib.crc32(raw) != check:
            raise ValueError("a frame's checksum does not fit its data")
        return raw

    def frame(self, k: int) -> np.ndarray:
        entry = self.frames[k]
        self.source.seek(int(self.starts[k]))
        data = self._unpack(self.source.read(int(entry["packed"])), int(entry["raw"]), int(entry["check"]))
        return np.frombuffer(data, dtype=f"<u{self.width}")

    def documents(self, doc_ids=None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of the documents asked for (all by default), in file order."""
        wanted = range(len(self.index)) if doc_ids is None else np.flatnonzero(
            np.isin(self.index["doc_id"], list(doc_ids)) & (self.index["null"] == 0))
        held, ids = -1, None
        for i in wanted:
            row = self.index[i]
            if row["frame"] != held:
                held, ids = row["frame"], self.frame(row["frame"])
            yield (None if row["null"] else int(row["doc_id"])), ids[row["first"]:row["first"] + row["n"]]


def read_documents(uri: str, doc_ids=None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of some documents of one file; other frames are neither read nor unpacked."""
    system, path = place_of(uri)
    with system.open_input_file(path) as source:
        yield from TokenFileReader(source).documents(doc_ids)


def id_width(tokenizer: str, end_id: int = 0) -> int:
    """Bytes per id: 2 if all ids of the tokenizer file and the end id fit, else 4."""
    from tokenizers import Tokenizer

    most = max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values())
    return 2 if most < 1 << 16 else 4


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0,
                      width: int | None = None) -> DataFrame:
    """Encode (doc_id, text) into token files under ``folder`` in ascending doc_id order, and return
    the manifest table. The texts are shuffled once, by range of doc_id and beginning of the text, so that many rows of one id are
    no single task; ids never are. ``width`` follows the vocabulary; with a narrower one, ids that do not fit raise."""
    width = width or id_width(tokenizer, end_id)

    def write(batches):
        from pyspark import TaskContext

        system, base = place_of(folder)
        system.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"tokens-{part:06d}-{uuid.uuid4().hex}.ids.zst"
        encoder, writer, sink = byte_level_encoder(tokenizer, added_tokens=True), None, None
        for batch in batches:
            for at, data, off in slices(batch.column(1)):
                if writer is None:
                    sink = system.open_output_stream(f"{base}/{name}", compression=None)
                    writer = TokenFileWriter(sink, width)
                ids, counts = encoder.ids(data, off)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                writer.add(batch.column(0)[at:at + len(counts)].to_pylist(), ids, counts + 1)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "part": part, "n_docs": writer.n_docs,
                                               "n_tokens": writer.n_tokens, "n_bytes": writer.n_bytes}])

    by_id = F.col("doc_id").asc_nulls_first()
    ordered = (docs.select("doc_id", "text").repartitionByRange(by_id, F.substring("text", 1, 64))
               .sortWithinPartitions(by_id, "text"))
    manifest = f"{folder}/manifest"
    ordered.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return docs.sparkSession.read.schema(MANIFEST).parquet(manifest)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document read back from the files, with its place in the file and the ids before
    it in the file; one task reads whole files, one frame at a time."""
    def read(batches):
        for batch in batches:
            for file, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, path = place_of(file)
                with system.open_input_file(path) as source:
                    reader = TokenFileReader(source)
                    index = reader.index
                    before = np.cumsum(index["n"].astype(np.int64)) - index["n"]
                    edges = np.searchsorted(index["frame"], np.arange(len(reader.frames) + 1))
                    for k in range(len(reader.frames)):
                        rows = slice(int(edges[k]), int(edges[k + 1]))
                        some = index[rows]
                        ids = reader.frame(k).astype("<u4")
                        checks = [zlib.crc32(ids[a:a + n]) for a, n in zip(some["first"].tolist(), some["n"].tolist())]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(some["doc_id"], mask=some["null"].astype(bool)),
                            pa.array(np.full(len(some), part, np.int64)),
                            pa.array(np.arange(rows.start, rows.stop, dtype=np.int64)),
                            pa.array(before[rows]), pa.array(some["n"].astype(np.int64)),
                            pa.array(np.array(checks, dtype=np.int64))],
                            names=["doc_id", "part", "place", "before", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return manifest.select("file", "part").repartitionByRange(files, "part").mapInArrow(read, ROWS)


def token_file_rows(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the files, read them back, and add each document's place in the whole of all ids.
    The running sum over files has one row per file."""
    manifest = write_token_files(docs, folder, tokenizer, end_id)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("file_start"))
    return (read_token_files(manifest).join(starts, "part")
            .select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_file_rows(docs, scratch_path(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"))
