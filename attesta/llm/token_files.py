"""Token ids as flat unsigned-integer files with 64-bit document offsets, read back by memory map."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import shared_dir, shuffle_width
from attesta.llm.packing import CALL_TEXTS, END_ID, word_ids

#: The index file: this name, then as little-endian numbers the bytes of an id (32 bits), documents and ids (64 bits each); then
#: documents + 1 offsets in ids (64 bits), the documents' ids (64 bits, signed), and a byte for each that is 1 where there is an id.
MAGIC = b"TOKIDX01"
#: Documents whose offsets are looked at in one go.
READ_DOCS = 4096

FILES = "part int, name string, id_bytes int, documents long, tokens long"


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder or file and its path there; any store that Arrow opens by its address."""
    if "://" not in uri or uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    scheme, rest = uri.split("://", 1)
    return pyarrow.fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def _write(folder: str, tokenizer: str, end_id: int):
    """mapInArrow function: sorted rows of (doc_id, text) to one file of ids and its index; one row about them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = word_ids(tokenizer)
        wide = max(len(ids.ends), end_id + 1) > 1 << 16
        kind, end = np.dtype("<u4" if wide else "<u2"), np.array([end_id], "<u4").tobytes()
        # a task that runs again writes files of other names; only those named by the row that Spark commits are ever read
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        store, path = _place(folder)
        store.create_dir(path, recursive=True)
        lengths, doc_ids, known = [], [], []
        with store.open_output_stream(f"{path}/{name}.bin") as out:
            for batch in batches:
                texts = batch.column("text")
                for first in range(0, len(texts), CALL_TEXTS):
                    found = [ids.split(t.as_py() or "") for t in texts[first : first + CALL_TEXTS]]
                    ids.learn(set().union(*found))
                    data = [b"".join(map(ids.words.__getitem__, words)) + end for words in found]
                    out.write(np.frombuffer(b"".join(data), "<u4").astype(kind).tobytes())
                    lengths.append(np.array([len(d) // 4 for d in data], dtype=np.uint64))
                column = batch.column("doc_id")
                doc_ids.append(column.fill_null(0).to_numpy().astype("<i8"))
                known.append(column.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
        if not doc_ids:
            store.delete_file(f"{path}/{name}.bin")
            return
        offsets = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.concatenate(lengths), dtype=np.uint64)]).astype("<u8")
        documents, tokens = len(offsets) - 1, int(offsets[-1])
        with store.open_output_stream(f"{path}/{name}.idx") as out:
            out.write(MAGIC + np.array([kind.itemsize], "<u4").tobytes() + np.array([documents, tokens], "<u8").tobytes())
            for values in (offsets, np.concatenate(doc_ids), np.concatenate(known)):
                out.write(values.tobytes())
        row = ([part], [name], [kind.itemsize], [documents], [tokens])
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], [f.split()[0] for f in FILES.split(", ")])

    return run


class TokenFile:
    """One file of ids with its index. A local file is mapped into memory, others are read by ranges: neither is read whole."""

    def __init__(self, uri: str):
        store, path = _place(uri)
        local = isinstance(store, pyarrow.fs.LocalFileSystem)
        opened = pa.memory_map if local else store.open_input_file
        self.ids, self.index = opened(f"{path}.bin"), opened(f"{path}.idx")
        head = self.index.read_at(28, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri}.idx is no index of token ids")
        self.kind = np.dtype(f"<u{int(np.frombuffer(head, '<u4', 1, 8)[0])}")
        self.documents, self.tokens = map(int, np.frombuffer(head, "<u8", 2, 12))

    def __len__(self) -> int:
        return self.documents

    def offsets(self, first: int, last: int) -> np.ndarray:
        """Where documents first to last - 1 begin, and where the last of them ends."""
        return np.frombuffer(self.index.read_at(8 * (last - first + 1), 28 + 8 * first), "<u8")

    def doc_ids(self, first: int, last: int) -> pa.Array:
        at = 28 + 8 * (self.documents + 1)
        values = np.frombuffer(self.index.read_at(8 * (last - first), at + 8 * first), "<i8")
        known = np.frombuffer(self.index.read_at(last - first, at + 8 * self.documents + first), np.uint8)
        return pa.array(values, pa.int64(), mask=known == 0)

    def span(self, first: int, last: int) -> np.ndarray:
        """The ids at places first to last - 1 of the file."""
        size = self.kind.itemsize
        return np.frombuffer(self.ids.read_at(size * (last - first), size * first), self.kind)

    def __getitem__(self, i: int) -> np.ndarray:
        """The ids of document i."""
        if not 0 <= i < self.documents:
            raise IndexError(i)
        first, last = map(int, self.offsets(i, i + 1))
        return self.span(first, last)


def _read(folder: str):
    """mapInArrow function: rows of the manifest to a row for each document of their files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(f"{folder}/{row['name']}")
                for first in range(0, len(file), READ_DOCS):
                    last = min(len(file), first + READ_DOCS)
                    at = file.offsets(first, last).astype(np.int64)
                    crc = [zlib.crc32(file.span(x, y).astype("<u4").tobytes()) for x, y in zip(at.tolist(), at[1:].tolist())]
                    columns = [file.doc_ids(first, last), pa.array(row["token_base"] + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all whole texts of docs (doc_id, text), each with end_id after it, in ascending doc_id order, below `folder`.

    folder: an address that the driver and all executors share. One flat file of ids and one index for each range of doc_ids; ids take
    16 bits where the vocabulary and end_id allow it, else 32. `folder`/manifest (Parquet, returned) names the files in order, with the
    documents and ids before each (doc_base, token_base): prefix sums over the files' counts. A task holds a batch of texts and the
    lengths of its range's documents; one that runs again leaves files that no manifest names.

    Null texts count as empty: end_id alone. Null doc_ids come first; rows of one doc_id follow the hash of their text, repeated rows
    are written each; so many of them that they fill several ranges are split. Very long texts are written whole; an empty
    table gives an empty manifest; other columns are not read.
    """
    spark = docs.sparkSession
    tie = [F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_tie")]
    order = ["doc_id", "_hash", "_tie"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *tie)
    ranged = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(_write(folder, tokenizer, end_id), FILES).write.parquet(f"{folder}/files")
    files = spark.read.schema(FILES).parquet(f"{folder}/files")
    # one row for each file: as many as there are ranges
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(b) for c, b in (("documents", "doc_base"), ("tokens", "token_base"))))
    based.coalesce(1).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{FILES}, doc_base long, token_base long").parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; start counts the ids of all documents before it."""
    manifest = read_manifest(spark, folder)
    tasks = max(1, manifest.count())
    return manifest.repartitionByRange(tasks, "part").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/attesta/token-files-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder)
