"""Token ids in Arrow stream files of fixed-size lists.

A file holds the ids of consecutive documents, cut into rows of ``row_length`` ids with a mask of the same length
(only the last row is padded). All rows of a file have equal length, so the place of any id is arithmetic, and a
memory-mapped file gives its rows as views without a copy. A second small stream file lists its documents' places.
Tasks write to the shared work folder through Arrow's file systems; names hold the attempt, and a file counts
only when the manifest of the finished job names it, so repeated and lost attempts leave nothing half-written.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructType

from vecatlas.llm.common import slices, written
from vecatlas.llm.tokenization import tokenizer

ROWS_PER_BATCH = 256
MANIFEST = "place long, tokens string, documents string, n_docs long, n_tokens long"


def _open(path: str):
    """A seekable source: a memory map for local files."""
    system, name = fs.FileSystem.from_uri(path)
    return pa.memory_map(name) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(name)


class RowWriter:
    """Writes a stream of ids as fixed-size rows and masks; ids take two bytes where the vocabulary allows it."""

    def __init__(self, sink, row_length: int, vocabulary_size: int):
        self.length, self.held, self.size = row_length, [], 0
        self.kind = np.uint16 if vocabulary_size <= 1 << 16 else np.uint32
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), row_length)), ("mask", pa.list_(pa.bool_(), row_length))])
        self.out = pa.ipc.new_stream(sink, self.schema)

    def _write(self, ids: np.ndarray) -> None:
        padded = np.zeros(-(-len(ids) // self.length) * self.length, dtype=self.kind)
        padded[: len(ids)] = ids
        mask = np.arange(len(padded)) < len(ids)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids) // 4
        full = ROWS_PER_BATCH * self.length
        if self.size >= full:
            ids = np.frombuffer(b"".join(self.held), dtype="<u4")
            whole = len(ids) // full * full
            for i in range(0, whole, full):
                self._write(ids[i : i + full])
            self.held, self.size = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> None:
        if self.size:
            self._write(np.frombuffer(b"".join(self.held), dtype="<u4"))
        self.out.close()


@dataclass
class TokenFile:
    """Random access to the rows of one file."""

    path: str

    def __post_init__(self):
        self.source = _open(self.path)
        self.batches = list(pa.ipc.open_stream(self.source))

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def row(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids (a numpy view) and mask (an Arrow slice of bits) of row ``i``, without a copy of the file's bytes."""
        batch = self.batches[i // ROWS_PER_BATCH]  # all batches but the last have ROWS_PER_BATCH rows
        length, at = batch.schema.field("ids").type.list_size, i % ROWS_PER_BATCH
        return batch.column(0).values.to_numpy()[at * length : (at + 1) * length], batch.column(1).values.slice(at * length, length)

    def ids(self, start: int, stop: int) -> list[np.ndarray]:
        """Views of the ids from ``start`` to ``stop``, one for each batch that they lie in."""
        found = []
        if self.batches:
            size = ROWS_PER_BATCH * self.batches[0].schema.field("ids").type.list_size
            for k in range(start // size, -(-stop // size)):
                found.append(self.batches[k].column(0).values.to_numpy()[max(0, start - k * size) : stop - k * size])
        return found

    def n_tokens(self) -> int:
        return sum(b.column(1).values.true_count for b in self.batches)


def write(
    docs: DataFrame, tokenizer_path: str, folder: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1, row_length: int = 2048, style: str = "word", partitions: int | None = None
) -> DataFrame:
    """Write all documents in ascending key order (ties by a hash of the text, null keys first), each followed
    by ``end_id``, and return the manifest: one row per file, ``place`` in ascending key order.

    A null text counts as empty. Repeated rows and keys are all written. An empty table gives an empty manifest.
    Columns other than key and text are not read.
    """
    kind = docs.select(F.col(f"`{key}`").alias("key")).schema["key"].dataType
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        place = TaskContext.get().partitionId()
        names = [f"part-{place:06d}-{uuid.uuid4().hex}.{x}.arrow" for x in ("tokens", "documents")]
        library, rows, at = tokenizer(tokenizer_path, style), 0, 0
        schema = pa.schema([("key", to_arrow_type(kind)), ("start", pa.int64()), ("length", pa.int64())])
        with system.open_output_stream(f"{base}/{names[0]}") as sink, system.open_output_stream(f"{base}/{names[1]}") as index_sink:
            tokens, index = RowWriter(sink, row_length, library.library.get_vocab_size()), pa.ipc.new_stream(index_sink, schema)
            for batch in slices(batches, "text", 2_000_000):
                lengths = []
                for ids in library.encode(batch.column(1).to_pylist()):
                    tokens.add(ids + end)
                    lengths.append(len(ids) // 4 + 1)
                starts = at + np.cumsum([0, *lengths[:-1]])
                index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], schema=schema))
                rows, at = rows + len(lengths), at + sum(lengths)
            tokens.close()
            index.close()
        if rows:
            values = (place, *(f"{folder}/{n}" for n in names), rows, at)
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("place", "tokens", "documents", "n_docs", "n_tokens"), values, strict=True)})

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    order = ["key", F.xxhash64("text")]
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return written(dealt.sortWithinPartitions(*order).mapInArrow(run, MANIFEST), f"{folder}/manifest")


def read(spark: SparkSession, manifest: DataFrame, key: str, key_type) -> DataFrame:
    """Read files back: one row per document with its start among all ids, its length, and its ids' crc32.

    The manifest has a row per file; only its numbers of tokens pass through the driver.
    """
    files = manifest.orderBy("place").collect()
    starts = np.cumsum([0, *(f["n_tokens"] for f in files)])
    schema = StructType().add(key, key_type).add("start", LongType()).add("n_tokens", LongType()).add("ids_crc32", LongType())
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(f["tokens"], f["documents"], f["n_tokens"], int(s)) for f, s in zip(files, starts, strict=False)], "tokens string, documents string, n_tokens long, base long")

    def run(batches):
        for batch in batches:
            for f in batch.to_pylist():
                tokens = TokenFile(f["tokens"])
                if tokens.n_tokens() != f["n_tokens"]:
                    raise ValueError(f"{f['tokens']} has {tokens.n_tokens()} ids, not {f['n_tokens']}")
                for docs in pa.ipc.open_stream(_open(f["documents"])):
                    sums = []
                    for start, length in zip(docs.column("start").to_pylist(), docs.column("length").to_pylist(), strict=True):
                        crc = 0
                        for part in tokens.ids(start, start + length):
                            crc = zlib.crc32(part.astype("<u4"), crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [docs.column("key"), pa.array(docs.column("start").to_numpy() + f["base"]), docs.column("length"), pa.array(sums, pa.int64())], names=schema.fieldNames()
                    )

    return listed.repartition(len(files)).mapInArrow(run, schema)
