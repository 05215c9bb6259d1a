"""Token ids in training order: fixed-stride binary shards, ordered by a keyed permutation of all sequences.

Documents are tokenised, closed with id 0 and cut into sequences of a fixed length. How many there are isn't known before every text is
tokenised, but their bytes bound it: a document of b bytes has at most (b + length) // length sequences. Each possible sequence has an index
below the sum M of these bounds, and a place p(i): p is a keyed Feistel network on the smallest even number of bits that holds M, walked
along its cycles until it lands below M. Places are cut into ranges, one for each shard, and a shard is sorted by place. The slot of a
sequence is the rank of its place among all sequences, a uniform order without gaps, and texts are tokenised only once.

Every record has the same number of bytes, so with the number of records of each shard (its size) slot s stands at a known offset of a
known file: a run that stops after any slot resumes there with one seek.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from factlode.llm.bpe import TextEncoder
from factlode.llm.packing import END_OF_TEXT
from factlode.llm.rows import slices, text_rows
from factlode.session import checkpoint_dir

ROUNDS = 4
#: Before the ids of a record: its place, its document, where its first id stands in the document, and how many ids are not padding.
HEADER = np.dtype([("place", "<i8"), ("doc_id", "<i8"), ("start", "<i4"), ("n", "<i4")])
NO_ID = np.iinfo(np.int64).min


def _mix(values: np.ndarray, key: int) -> np.ndarray:
    x = values ^ np.uint64(key)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slot of each index below n. A bijection on 0..n-1 for every key."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = [int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little") for r in range(ROUNDS)]
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        out[walking] = left << np.uint64(half) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def stride(length: int, width: int) -> int:
    """Bytes of a record: header, ids, and the line end that the text writer adds."""
    return HEADER.itemsize + length * width + 1


def _bounds(rows: DataFrame, length: int) -> dict[int, int]:
    """Possible sequences of each partition: one number per task."""
    each = F.floor((F.octet_length(F.coalesce("text", F.lit(""))) + length) / length)
    found = rows.select(F.spark_partition_id().alias("part"), each.alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()
    return {r.part: r.n for r in found}


def write_training_order(docs: DataFrame, folder: str, path: str, length: int = 512, per_shard: int = 16384, key: int = 20_240_601, width: int = 2, id_column: str = "doc_id", text_column: str = "text") -> dict:
    """Write the shards to `folder` (any file system Spark writes to) and return their layout.

    `per_shard` is the number of places of a shard, so the most records it can have. `width` is 2 bytes an id for vocabularies below 65,536
    ids, 4 for others; the rest of a document's last sequence is padded with 0. Ids move once, straight to their shard. The pass that
    adds up bytes and the one that writes must see the same rows in the same partitions, as a scan of files gives them; a partition with
    other bytes is an error. Null and empty texts are the closing id alone; a null id is kept as the smallest long; repeated rows are
    documents of their own; an empty table writes no shard.
    """
    rows = text_rows(docs, id_column, text_column)
    bounds = _bounds(rows, length)
    total, offsets, at = sum(bounds.values()), {}, 0
    for part in sorted(bounds):
        offsets[part], at = at, at + bounds[part]
    target, batch = StructType.fromDDL("shard int, place long, record binary"), 4096

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part_id = TextEncoder(path), TaskContext.get().partitionId()
        index, end = offsets.get(part_id, 0), offsets.get(part_id, 0) + bounds.get(part_id, 0)
        for part in slices(batches):
            data = encoder.encode(part["text"])
            tokens = np.frombuffer(b"".join(x + END_OF_TEXT for x in data), dtype="<u4")
            sizes = np.array([len(x) // 4 + 1 for x in data], dtype=np.int64)
            possible = np.array([(len((t or "").encode()) + length) // length for t in part["text"]], dtype=np.int64)
            pieces = -(-sizes // length)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * length
            n = np.minimum(length, sizes[owner] - start)
            first = (np.cumsum(sizes) - sizes)[owner] + start
            places = permute(index + (np.cumsum(possible) - possible)[owner] + number, total, key) if index + possible.sum() <= end else None
            index += int(possible.sum())
            if places is None:
                break
            ids = np.array([NO_ID if d is None else d for d in part["doc_id"]], dtype=np.int64)
            for b in range(0, len(owner), batch):
                cut = slice(b, b + batch)
                records = np.zeros(len(owner[cut]), dtype=[("header", HEADER), ("ids", f"<u{width}", (length,))])
                records["header"]["place"], records["header"]["doc_id"] = places[cut], ids[owner[cut]]
                records["header"]["start"], records["header"]["n"] = start[cut], n[cut]
                held = np.arange(length) < n[cut, None]
                records["ids"][held] = tokens[(first[cut, None] + np.arange(length))[held]]
                raw, size = records.tobytes(), records.dtype.itemsize
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array((places[cut] // per_shard).astype(np.int32)), "place": pa.array(places[cut]),
                    "record": pa.array([raw[k : k + size] for k in range(0, len(raw), size)], pa.binary()),
                })
        if index != end:
            raise RuntimeError("the rows of a partition changed between the two passes; write them to files first")

    shards = max(1, -(-total // per_shard))
    placed = rows.mapInArrow(place, target).repartitionById(shards, F.col("shard")).sortWithinPartitions("place")
    # the text writer puts the bytes of a string down as they are: every line is one record, and files come through Spark's committer
    placed.select(F.col("record").cast("string").alias("value")).write.option("compression", "none").option("maxRecordsPerFile", 0).text(folder)
    layout = {"length": length, "width": width, "stride": stride(length, width), "key": key, "places": total}
    return layout | {"first_slots": first_slots(docs.sparkSession, folder, layout["stride"])}


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.withColumn("shard", F.regexp_extract("path", r"part-(\d+)", 1).cast("int"))


def first_slots(spark: SparkSession, folder: str, size: int) -> dict[int, int]:
    """The first slot of each shard, from the sizes of the files; and, at -1, the number of sequences."""
    out, at = {}, 0
    for row in _shards(spark, folder).select("shard", "length").orderBy("shard").collect():
        out[row.shard], at = at, at + row.length // size
    return out | {-1: at}


def read_training_order(spark: SparkSession, folder: str, layout: dict, first_slot: int = 0) -> DataFrame:
    """slot, shard, shard_offset, place, doc_id, start, n, ids (little-endian, without padding) of all sequences from first_slot on.

    Shards before it are not opened, and the first one is entered at its offset. Rows of a shard are in training order.
    """
    size, width, starts = layout["stride"], layout["width"], layout["first_slots"]
    opened = max((k for k, at in starts.items() if k >= 0 and at <= first_slot), default=0)
    files = _shards(spark, folder).where(F.col("shard") >= opened).select("shard", "content")
    target = "slot long, shard int, shard_offset long, place long, doc_id long, start long, n int, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                buffer = content.as_buffer()
                skip = max(0, first_slot - starts[shard])
                for b in range(skip * size, buffer.size, 4096 * size):
                    raw = memoryview(buffer)[b : b + 4096 * size]
                    header = np.frombuffer(raw, dtype=np.dtype([("head", HEADER), ("rest", f"V{size - HEADER.itemsize}")]))["head"]
                    at = range(HEADER.itemsize, len(raw), size)
                    yield pa.RecordBatch.from_pydict({
                        "slot": starts[shard] + b // size + np.arange(len(header)), "shard": pa.array([shard] * len(header), pa.int32()),
                        "shard_offset": pa.array(range(b, b + len(raw), size), pa.int64()), "place": header["place"].copy(),
                        "doc_id": pa.array([None if d == NO_ID else d for d in header["doc_id"].tolist()], pa.int64()),
                        "start": header["start"].astype(np.int64), "n": header["n"].copy(),
                        "ids": pa.array([bytes(raw[k : k + width * n]) for k, n in zip(at, header["n"].tolist())], pa.binary()),
                    })

    return files.mapInArrow(run, target)


def materialize_training_order(docs: DataFrame, path: str, length: int = 512, per_shard: int = 16384, folder: str | None = None, **settings) -> DataFrame:
    """Write the shards below the shared checkpoint folder (or to `folder`) and read them back: slot, shard, shard_offset, doc_id, start,
    length and the crc32 of the ids as unsigned 32-bit little-endian numbers, one row for each sequence."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/training-order-{uuid.uuid4().hex}"
    layout = write_training_order(docs, folder, path, length, per_shard, **settings)
    target = "slot long, shard int, shard_offset long, doc_id long, start long, length long, ids_crc32 long"
    if not layout["first_slots"][-1]:
        return spark.createDataFrame([], target)
    width = layout["width"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), dtype=f"<u{width}").astype("<u4").tobytes()) for x in batch.column("ids")]
            columns = {name: batch.column(name) for name in ("slot", "shard", "shard_offset", "doc_id", "start")}
            yield pa.RecordBatch.from_pydict({**columns, "length": batch.column("n").cast(pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return read_training_order(spark, folder, layout).mapInArrow(digest, target)
