"""What the training-data operators share: checkpoints, whole-text batches, table reads."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words; the word pattern is [^\x20\x09-\x0D]+, which is what bytes.split() splits on.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one in a session of one JVM (as in
    tests), an error on a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillmark-"))
    return named or sc.getCheckpointDir()


def open_store(uri: str):
    """File system and path for a folder's name as Spark writes it."""
    from pyarrow import fs

    if re.match(r"file:/+", uri):
        uri = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken, in whatever case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Arrow batches as dicts of Python lists, in and out; no shuffle, a batch in memory at a time."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b):
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
            pa.default_memory_pool().release_unused()  # workers outlive a stage: what it held is given back

    return df.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterable[pa.RecordBatch]:
    """A batch in pieces of a few MB, so that Python copies of the texts stay small."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * most_bytes / max(batch.nbytes, 1)))
    for i in range(0, n, step):
        yield batch.slice(i, min(step, n - i))


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def split_words(texts: list[str | None] | pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words of some texts: a number for each word in order, the distinct words by number, and each text's first word
    (with the end of the last one). Words are split as by bytes.split(), that is by white space of ASCII."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    parts = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    coded = pc.dictionary_encode(parts.flatten())
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary()).to_pylist()
    offsets = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    if b"" in words:  # stands before white space at the start, and after white space at the end
        empty = words.index(b"")
        kept = codes != empty
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        codes = codes[kept]
        codes = codes - (codes > empty)
        del words[empty]
    return codes, words, offsets


#: Where a block lies: a range of bytes of a file in the shared folder.
BLOCK = "block long, path string, start long, size long"


def pack_blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """BLOCK: rows in their order as compressed Arrow streams of about `block_bytes` each (a larger row is a block of its own), a
    file for each task in the shared folder. Each attempt writes a file of its own, and the checkpointed result names those of
    the attempts that succeeded; so blocks are written once, outlive executors, and later steps move their names alone."""
    folder = f"{shared_dir(rows.sparkSession)}/blocks-{uuid.uuid4()}"
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    schema = pa.schema([("block", pa.int64()), ("path", pa.string()), ("start", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, out, held, size, made = f"{uuid.uuid4()}.arrows", None, [], 0, []

        def flush() -> None:
            nonlocal out
            if out is None:
                store, top = open_store(folder)
                out = store.open_output_stream(f"{top}/{name}", compression=None)
            start = out.tell()
            with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as writer:
                for b in held:
                    writer.write_batch(b)
            made.append(((TaskContext.get().partitionId() << 32) + len(made), f"{folder}/{name}", start, out.tell() - start))

        for batch in batches:
            for b in _slices(batch, block_bytes // 4):
                held.append(b)
                size += b.nbytes
                if size >= block_bytes:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    return cut(rows.mapInArrow(run, BLOCK))


def dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows dealt out by block, for as many tasks as there is work: they are small themselves, so by their size they would all go to
    a few tasks, while each stands for a block. Two tables dealt for the same number of blocks join without another shuffle."""
    return rows.repartition(max(1, min(2 * blocks, 100_000)), "block")


def block_parts(path: str, start: int, size: int) -> Iterator[pa.RecordBatch]:
    store, at = open_store(path)
    with store.open_input_file(at) as f:
        payload = f.read_at(size, start)
    with pa.ipc.open_stream(payload) as reader:
        yield from reader


def planes(values: np.ndarray) -> bytes:
    """Compressed by byte planes, where the upper bytes of sorted differences and of counts are mostly zero."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unplaned(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def hash_ranges(ordered: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Number, start and end of each of the 2^bits equal ranges of 64-bit values that has some of the sorted ones."""
    cuts = np.searchsorted(ordered, np.arange(1, 1 << bits).astype(np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0)
    ends = np.concatenate([[0], cuts, [len(ordered)]]).astype(np.int64)
    for r in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
        yield r, int(ends[r]), int(ends[r + 1])
