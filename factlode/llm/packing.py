"""Sum-of-squares packing of documents into windows of tokens."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from factlode.llm.bpe import TextEncoder
from factlode.llm.rows import slices, text_rows

END_OF_TEXT = b"\0\0\0\0"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
BATCH = 16_384


class LevelPacker:
    """Open windows by fill level. A rest goes to the level where the sum of the squared numbers of open windows grows least; among equal
    levels the fullest is taken. Full windows leave at once, so only open ones are held."""

    def __init__(self, window: int):
        self.window = window
        self.level = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)

    def place(self, piece: tuple, size: int) -> list | None:
        """The window that this piece fills up, if it does."""
        count, last = self.level, self.window - size
        # how the sum of squares changes if a window moves from level h to h + size
        gain = 2 * (count[size : self.window + 1] - count[: last + 1] + 1)
        gain[0] = 2 * count[size] + 1  # a new window leaves no level
        gain[last] = 1 - 2 * count[last] if last else 0  # a full one reaches none
        usable = count[: last + 1] > 0
        usable[0] = True
        level = last - int(np.argmin(np.where(usable, gain, np.iinfo(np.int64).max)[::-1]))
        pieces = self.open[level].pop() if level else []
        count[level] -= level > 0
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        count[level + size] += 1
        self.open[level + size].append(pieces)
        return None

    def drain(self, cut) -> Iterator[list]:
        """At the end of the input the emptiest windows are cut up to fill the fullest ones; one window at most stays open."""
        left = [(k, pieces) for k in sorted(self.open, reverse=True) for pieces in self.open[k]]
        low, spare = len(left), []
        for k, (size, pieces) in enumerate(left):
            if k >= low:
                break
            while size < self.window:
                if not spare:
                    low -= 1
                    if low <= k:
                        break
                    spare = left[low][1]
                head, tail = cut(spare.pop(), self.window - size)
                pieces.append(head)
                size += head[2]
                if tail:
                    spare.append(tail)
            yield pieces
        if spare:
            yield spare


def pack_documents(docs: DataFrame, path: str, window: int = 1024, keep_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece of a document: where it starts in its document, its length, the crc32 of its ids (unsigned 32 bits,
    little-endian), the document's number of tokens with the closing id 0, its sequence and its offset there; with keep_ids the ids too.

    A document longer than a window gives full windows first; its rest is placed whole by the sum-of-squares rule and cut only when the
    input of a task ends. Each partition of `docs` packs its own documents: nothing is shuffled, and at most one sequence of a
    partition stays short of the window. A null or empty text is the closing id alone; a null id stays null; repeated rows are documents
    of their own; an empty table has no pieces. sequence_id is the partition's number times 2**33 plus a running number.
    """
    schema = PIECES + (", ids binary" if keep_ids else "")
    target = StructType.fromDDL(schema)

    def cut(piece, size):
        doc, start, length, total, data = piece
        if length <= size:
            return piece, None
        return (doc, start, size, total, data[: 4 * size]), (doc, start + size, length - size, total, data[4 * size :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        encoder, packer, arrow = TextEncoder(path), LevelPacker(window), to_arrow_schema(target)
        columns: list[list] = [[] for _ in arrow]
        sequence = TaskContext.get().partitionId() << 33

        def emit(pieces):
            nonlocal sequence
            offset = 0
            for doc, start, length, total, data in pieces:
                for column, value in zip(columns, (doc, start, length, zlib.crc32(data), total, sequence, offset, data)):
                    column.append(value)
                offset += length
            sequence += 1

        def batch():
            done = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
            for column in columns:
                column.clear()
            return done

        for part in slices(batches):
            for doc, data in zip(part["doc_id"], encoder.encode(part["text"])):
                data += END_OF_TEXT
                total = len(data) // 4
                full = total - total % window
                for start in range(0, full, window):
                    emit([(doc, start, window, total, data[4 * start : 4 * (start + window)])])
                if total > full and (pieces := packer.place((doc, full, total - full, total, data[4 * full :]), total - full)):
                    emit(pieces)
                if len(columns[0]) >= BATCH:
                    yield batch()
        for pieces in packer.drain(cut):
            emit(pieces)
        yield batch()

    return text_rows(docs, id_column, text_column).mapInArrow(run, target)
