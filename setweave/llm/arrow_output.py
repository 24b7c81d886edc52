"""Token ids as Arrow files of fixed-size lists: equally long sequences with masks, in document order.

Each shard is an Arrow IPC file whose batches hold ``ids: fixed_size_list<uint16>[length]`` (uint32
for a vocabulary over 65,536) and ``mask: fixed_size_list<bool>[length]``, a bit each; sequence i of a shard is a slice of a memory-mapped batch, without a
copy. Documents follow one another through the sequences; only the last sequence of a shard is
padded (mask 0). A second file beside it lists the shard's documents: id, first place, count.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setweave.llm.common import cut, new_name, ranges, shared_dir, steps, table, texts_of
from setweave.llm.segments import SegmentEncoder
from setweave.llm.token_counts import cuts_at, load

VOCABULARY = "byte_bpe_50k.json"
LENGTH, ROWS = 2048, 64
#: Segments in one text for the library, and those that a worker remembers, from task to task.
JOINED, CACHED = 2048, 1_300_000
NUL = "\0"
_PLAIN = re.compile(r" [^\s\0]+").fullmatch
MANIFEST = "shard int, path string, n_ids long, n_docs long"


class LibraryEncoder:
    """Ids as the tokenizers library gives them for whole texts; segments between spaces are encoded once and kept, if the file
    is such that its ids don't depend on what stands around them."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cached, self.barrier = cuts_at(self.tokenizer) == "word", self._barrier()
        self.segments = SegmentEncoder(self._new, CACHED)

    def _barrier(self) -> int | None:
        """The id of the NUL character, if no other token holds it: then no token reaches over one."""
        ids = self.tokenizer.encode(NUL, add_special_tokens=False).ids
        if len(ids) != 1:
            return None
        own = self.tokenizer.id_to_token(ids[0])
        return ids[0] if sum(own in t for t in self.tokenizer.get_vocab()) == 1 else None

    def _new(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``_many`` for segments. Those of a space and then no white space go to the library in long texts, with NULs between: a
        NUL takes part in no word, ends the marks before it, and a space begins a new match after it."""
        plain = [i for i, s in enumerate(segments) if s[:1] == " " and (s[1:].isalnum() or _PLAIN(s))] if self.barrier is not None else []
        if not plain:
            return self._many(segments)
        joined = [NUL.join(segments[i] for i in plain[a : a + JOINED]) + NUL for a in range(0, len(plain), JOINED)]
        ids, _ = self._many(joined)
        ends = np.flatnonzero(ids == self.barrier)
        counts = np.zeros(len(segments), dtype=np.int64)
        counts[plain] = np.diff(ends, prepend=-1) - 1
        rest = np.setdiff1d(np.arange(len(segments)), plain, assume_unique=True)
        others, n = self._many([segments[i] for i in rest.tolist()])
        counts[rest] = n
        out, start = np.empty(int(counts.sum()), dtype=np.int32), np.cumsum(counts) - counts
        out[ranges(start[plain], counts[plain])] = np.delete(ids, ends)
        out[ranges(start[rest], n)] = others
        return out, counts

    def _many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
        return np.fromiter(chain.from_iterable(made), dtype=np.int32, count=int(counts.sum())), counts

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.cached:
            return self._many(texts)
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if not odd:
            return self.segments.encode(texts)
        parts = [self._many([t]) if i in odd else self.segments.encode([t]) for i, t in enumerate(texts)]
        return np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])


@lru_cache(maxsize=1)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


class ShardWriter:
    """Appends documents to one shard; holds at most a batch of sequences besides the document at hand."""

    def __init__(self, uri: str, length: int, rows: int, id_type: pa.DataType, vocabulary: int):
        self.length, self.rows = length, rows
        self.kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(os.path.dirname(path), recursive=True)
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n", pa.int64())])
        self.files = [self.fs.open_output_stream(path), self.fs.open_output_stream(path + ".docs")]
        self.out, self.docs = pa.ipc.new_file(self.files[0], self.schema), pa.ipc.new_file(self.files[1], self.index)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_docs = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        start = self.n_ids + np.cumsum(counts) - counts
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(start), pa.array(counts)], schema=self.index))
        self.held.append(ids)
        self.n_held, self.n_ids, self.n_docs = self.n_held + len(ids), self.n_ids + len(ids), self.n_docs + len(counts)
        if self.n_held >= self.length * self.rows:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.length * self.length
            self._batches(flat[:whole], whole)
            self.held, self.n_held = [flat[whole:].copy()], len(flat) - whole

    def _batches(self, flat: np.ndarray, real: int) -> None:
        flat, mask = flat.astype(self.kind.to_pandas_dtype()), np.arange(len(flat)) < real
        step = self.length * self.rows
        for a in range(0, len(flat), step):
            parts = [pa.FixedSizeListArray.from_arrays(pa.array(x[a : a + step]), self.length) for x in (flat, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(parts, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            self._batches(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        for x in (self.out, self.docs, *self.files):
            x.close()


def write(
    df: DataFrame, directory: str, path: str | None = None, length: int = LENGTH, end_id: int = 0, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes the shards and returns their manifest, ordered by ``shard``: path, number of ids, number of documents.

    Documents are in ascending order of ``id_col`` (nulls first; equal ids in order of their texts) through the
    shards. Each gets the ids of its whole text (null: empty) and then ``end_id``. Each attempt of a task writes a file of
    its own and the manifest names those of the attempts that were committed, so a lost executor leaves
    at most a file that nothing names. ``directory`` is a URI that all executors reach. An
    empty table gives no shards.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    source = df.select(df[id_col].alias("i"), df[text_col].alias("t"))
    ranged = source.repartitionByRange(F.col("i")).sortWithinPartitions("i", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = library_encoder(path), None
        context = TaskContext.get()
        name = f"{directory}/part-{context.partitionId():06d}-{context.taskAttemptId()}.arrow"
        for batch in batches:
            lengths = np.asarray(pa.compute.binary_length(batch.column(1)).fill_null(0), dtype=np.int64)
            for a, b in steps(lengths):
                ids, counts = encoder(texts_of(batch.column(1).slice(a, b - a)))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                if out is None:
                    out = ShardWriter(name, length, rows, batch.schema.field(0).type, encoder.tokenizer.get_vocab_size())
                out.add(batch.column(0).slice(a, b - a), ids, counts + 1)
        if out is not None:
            out.close()
            made = [[context.partitionId()], [name], [out.n_ids], [out.n_docs]]
            yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int32()), *map(pa.array, made[1:])], names=["shard", "path", "n_ids", "n_docs"])

    return cut(ranged.mapInArrow(run, MANIFEST))


def documents_of(uri: str) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray]]]:
    """Batches of a shard's documents from its files: ids of documents, their first places, their token ids."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        files = [pa.memory_map(path), pa.memory_map(path + ".docs")]
    else:
        files = [fs.open_input_file(path), fs.open_input_file(path + ".docs")]
    data, index = (pa.ipc.open_file(f) for f in files)
    held, base, k = np.zeros(0, dtype=data.schema.field(0).type.value_type.to_pandas_dtype()), 0, 0
    for b in range(index.num_record_batches):
        docs = index.get_batch(b)
        start, n = docs.column(1).to_numpy(), docs.column(2).to_numpy()
        parts, have = [held], len(held)
        while base + have < start[-1] + n[-1]:
            batch = data.get_batch(k)
            flat, mask = batch.column(0).flatten().to_numpy(), batch.column(1).flatten()
            parts.append(flat if mask[-1].as_py() else flat[mask.to_numpy(zero_copy_only=False)])
            have, k = have + len(parts[-1]), k + 1
        flat = np.concatenate(parts) if len(parts) > 1 else held
        yield docs.column(0), start, [flat[s : s + m] for s, m in zip(start - base, n, strict=True)]
        used = start[-1] + n[-1] - base
        held, base = flat[used:], base + used
    for f in files:
        f.close()


def read(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """Reads the shards back: ``doc_id``, ``start`` over all shards, ``n_tokens`` and ``ids`` (binary, little-endian
    32-bit) of each document. Prefix sums go over the manifest, a row a shard."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("path", before.alias("before"), "shard")
    files = max(1, manifest.count())
    spread = shards.repartition(files, F.col("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for docs, start, ids in documents_of(path):
                    yield pa.RecordBatch.from_arrays(
                        [
                            docs,
                            pa.array(start + base),
                            pa.array([len(x) for x in ids], pa.int64()),
                            pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return spread.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids binary")


def sequence(uri: str, at: int) -> tuple[pa.Array, pa.Array]:
    """Sequence ``at`` of a shard and its mask, as views of the file, without a copy."""
    fs, path = pafs.FileSystem.from_uri(uri)
    data = pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))
    rows = data.get_batch(0).num_rows
    batch = data.get_batch(at // rows)
    return tuple(batch.column(c).slice(at % rows, 1).flatten() for c in (0, 1))


def digests(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_arrow_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    directory = f"{shared_dir(spark)}/setweave/arrow-{new_name()}"
    manifest = write(docs, directory)
    return digests(read(manifest, docs.schema["doc_id"].dataType.simpleString().replace("bigint", "long")))
