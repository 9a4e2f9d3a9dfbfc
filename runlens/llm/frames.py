"""Token-id files of independent zstandard frames with a trailing seek table.

Layout of a file: frames of little-endian unsigned 32-bit ids, whole documents
each (a document above ``FRAME_IDS`` has frames of its own); one frame with the
document index; a skippable frame with the seek table: for each frame its
compressed size, its size and the low 32 bits of the XXH64 of its content, then
the number of frames, a flag byte and the magic number. Any zstandard reader can
decompress such a file from start to end."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from runlens.llm.shared import by_batch, filesystem, folder, raw_texts, written
from runlens.llm.tokens import encoder

#: Ids in a frame, about; no frame holds more, so a reader never decompresses more.
FRAME_IDS = 1 << 17
SKIPPABLE, SEEKABLE, WITH_SUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("start", "<u8"), ("n", "<u8")])
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])


def _sum(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class Writer:
    """Appends documents to an open binary stream; holds one frame and the index."""

    def __init__(self, out, level: int = 3) -> None:
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=level)
        self.held: list[bytes] = []
        self.held_ids = self.ids = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []

    def _frame(self, content: bytes) -> None:
        packed = self.zstd.compress(content)
        self.out.write(packed)
        self.frames.append((len(packed), len(content), _sum(content)))

    def _flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
            self.held, self.held_ids = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        if self.held_ids + n > FRAME_IDS:
            self._flush()
        self.index.append((doc_id or 0, doc_id is None, self.ids, n))
        self.ids += n
        if n > FRAME_IDS:
            for at in range(0, len(ids), 4 * FRAME_IDS):
                self._frame(ids[at:at + 4 * FRAME_IDS])
        elif n:
            self.held.append(ids)
            self.held_ids += n

    def close(self) -> None:
        self._flush()
        # the index comes in pieces, so a file may hold any number of documents
        index = np.array(self.index, dtype=INDEX).tobytes()
        step = INDEX.itemsize * FRAME_IDS
        pieces = range(0, len(index), step)
        for at in pieces:
            self._frame(index[at:at + step])
        entries = np.array(self.frames, dtype=_ENTRY).tobytes()
        tail = entries + struct.pack("<IIBI", len(pieces), len(self.frames), WITH_SUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(tail)) + tail)


class Reader:
    """Random access to a file that ``Writer`` made; checks every frame it opens."""

    def __init__(self, file) -> None:
        self.file, size = file, file.size()
        file.seek(size - 13)
        indexes, count, flags, magic = struct.unpack("<IIBI", file.read(13))
        if magic != SEEKABLE or flags != WITH_SUMS:
            raise ValueError("no seek table at the end of the file")
        length = 13 + count * _ENTRY.itemsize
        file.seek(size - length - 8)
        if struct.unpack("<II", file.read(8)) != (SKIPPABLE, length):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(file.read(count * _ENTRY.itemsize), dtype=_ENTRY)
        self.place = np.concatenate([[0], np.cumsum(self.table["packed"].astype("i8"))])
        self.zstd = zstandard.ZstdDecompressor()
        self.data = count - indexes
        self.first = np.concatenate([[0], np.cumsum(self.table["size"][:self.data].astype("i8") // 4)])
        self.index = np.frombuffer(b"".join(self.frame(i) for i in range(self.data, count)), dtype=INDEX)
        self.opened = (-1, b"")

    def frame(self, i: int) -> bytes:
        self.file.seek(int(self.place[i]))
        content = self.zstd.decompress(self.file.read(int(self.table["packed"][i])), max_output_size=max(1, int(self.table["size"][i])))
        if _sum(content) != self.table["sum"][i]:
            raise ValueError(f"frame {i} is damaged")
        return content

    def parts(self, row: int) -> Iterator[bytes]:
        """The ids of the ``row``-th document, frame by frame; only its frames are read."""
        start, n = int(self.index["start"][row]), int(self.index["n"][row])
        frame = int(np.searchsorted(self.first, start, side="right")) - 1
        while n:
            if self.opened[0] != frame:
                self.opened = (frame, self.frame(frame))
            at = start - int(self.first[frame])
            part = self.opened[1][4 * at:4 * (at + n)]
            yield part
            start, n, frame = start + len(part) // 4, n - len(part) // 4, frame + 1

    def rows_of(self, doc_id: int | None) -> np.ndarray:
        """The rows of a document id; documents lie in ascending order, null first."""
        ids, nulls = self.index["doc_id"], int(self.index["null"].sum())
        if doc_id is None:
            return np.arange(nulls)
        return nulls + np.arange(np.searchsorted(ids[nulls:], doc_id), np.searchsorted(ids[nulls:], doc_id, side="right"))


_FILE = StructType([StructField("part", LongType()), StructField("path", StringType()), StructField("docs", LongType()), StructField("ids", LongType())])
_DOC = StructType([StructField("doc_id", LongType()), StructField("is_null", BooleanType()), StructField("start", LongType()),
                   StructField("n_tokens", LongType()), StructField("ids_crc32", LongType())])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of ``docs`` in ascending order of the id (null first) and
    returns the list of files ``part, path, docs, ids``, where ``start`` is the
    number of ids in the files before.

    Null texts are empty; rows that repeat an id lie side by side in the order of
    their texts. Texts are dealt by ranges of the id and encoded after that, one
    file a task. A file is made under another name and renamed when whole, so a
    task that runs again replaces it with the same content."""
    body = F.coalesce(F.col(text), F.lit(""))
    cells = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = cells.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches):
        context = TaskContext.get()
        name = f"{path}/ids-{context.partitionId():08d}.zst"
        store, target = filesystem(name)
        made = f"{target}.{context.taskAttemptId()}"
        out = writer = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                if writer is None:
                    store.create_dir(target.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(made)
                    writer = Writer(out)
                for i, ids in zip(some.column(0).to_pylist(), encoder(tokenizer).ids(raw_texts(some)), strict=True):
                    writer.add(i, ids + end)
        if writer:
            writer.close()
            out.close()
            store.move(made, target)
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "path": [name], "docs": [len(writer.index)], "ids": [writer.ids]},
                                             schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    files = written(dealt.mapInArrow(run, _FILE))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(files: DataFrame) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens, ids_crc32``,
    where ``start`` counts the ids of all documents before it."""
    def make(batch):
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, target = filesystem(path)
            with store.open_input_file(target) as file:
                reader = Reader(file)
                for at in range(0, len(reader.index), 10_000):
                    index = reader.index[at:at + 10_000]
                    sums = []
                    for row in range(at, at + len(index)):
                        crc = 0
                        for part in reader.parts(row):
                            crc = zlib.crc32(part, crc)
                        sums.append(crc)
                    yield {"doc_id": index["doc_id"], "is_null": index["null"].astype(bool), "start": index["start"].astype("i8") + base,
                           "n_tokens": index["n"].astype("i8"), "ids_crc32": np.array(sums, dtype="i8")}

    listed = files.select("path", "start")
    rows = by_batch(listed.repartition(max(1, listed.count()), "path"), make, _DOC)
    return rows.select(F.when(~F.col("is_null"), F.col("doc_id")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def stored(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """``docs`` written to a fresh shared folder and read back."""
    return read(write(docs, folder(docs.sparkSession), tokenizer, end_id))
