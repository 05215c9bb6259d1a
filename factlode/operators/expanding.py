"""Order statistics of growing series: every row sees the rows before it and itself, at the cost of one insertion."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1_024
#: what each row gets: values so far, twice their median, four times their median absolute deviation, how many are not above the row's
#: value, and the two values before it, the latest first
STATISTICS = T.StructType([
    T.StructField("sample_count", T.IntegerType()), T.StructField("centre2", T.DoubleType()), T.StructField("mad4", T.DoubleType()),
    T.StructField("not_above", T.IntegerType()), T.StructField("previous", T.DoubleType()), T.StructField("before_previous", T.DoubleType()),
])


class OrderedValues:
    """Sorted values in blocks: insertion, rank and access by rank touch one block and a list of block ends."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block = block
        self.blocks: list[list[float]] = []
        self.highest: list[float] = []
        self.ends: list[int] = []

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def __getitem__(self, rank: int) -> float:
        if len(self.blocks) == 1:
            return self.blocks[0][rank]
        k = bisect_right(self.ends, rank)
        return self.blocks[k][rank - (self.ends[k - 1] if k else 0)]

    def add(self, value: float) -> None:
        if not self.blocks:
            self.blocks.append([])
            self.highest.append(value)
            self.ends.append(0)
        k = min(bisect_left(self.highest, value), len(self.blocks) - 1)
        block = self.blocks[k]
        insort(block, value)
        self.highest[k] = block[-1]
        if len(block) > 2 * self.block:
            self.blocks[k : k + 1] = [block[: self.block], block[self.block :]]
            self.highest[k : k + 1] = [block[self.block - 1], block[-1]]
        if len(self.blocks) == 1:
            self.ends[0] = len(block)
        else:
            self.ends = list(accumulate(map(len, self.blocks)))

    def not_above(self, value: float) -> int:
        k = bisect_right(self.highest, value)
        if k == len(self.blocks):
            return len(self)
        return (self.ends[k - 1] if k else 0) + bisect_right(self.blocks[k], value)

    def centre2(self) -> float:
        """Twice the median."""
        n = len(self)
        return self[(n - 1) // 2] + self[n // 2]

    def _distance(self, rank: int, centre2: float) -> float:
        """The deviation of that rank from half of ``centre2``, doubled. The values nearest to a centre lie next to each other: their
        first one is found by halving."""
        low, high = 0, len(self) - rank - 1
        while low < high:
            middle = (low + high) // 2
            x, y = self[middle], self[middle + rank + 1]
            if centre2 - (x + x) > (y + y) - centre2:
                low = middle + 1
            else:
                high = middle
        x, y = self[low], self[low + rank]
        return max(abs(x + x - centre2), abs(y + y - centre2))

    def mad4(self, centre2: float) -> float:
        """Four times the median absolute deviation."""
        n = len(self)
        lower = self._distance((n - 1) // 2, centre2)
        return lower + (lower if n % 2 else self._distance(n // 2, centre2))


def expanding_statistics(rows: DataFrame, series: WindowSpec, value: str) -> DataFrame:
    """Rows with the columns of STATISTICS, from the values of their series up to and with the row; ``value`` is not null.

    One shuffle by series. The window numbers the rows of each series in order, and the task reads them as they come: a series holds its
    values once, sorted, however long it is. Each row costs an insertion and a few looks by rank, each in the logarithm of the length
    (with many blocks, a step over the list of block ends).
    """
    numbered = rows.withColumn("_place", F.row_number().over(series)).withColumn("_x", F.col(value).cast("double"))
    kept = T.StructType([f for f in numbered.schema.fields if f.name not in ("_place", "_x")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, place, recent = OrderedValues(), 0, (None, None)
        for batch in batches:
            found: dict[str, list] = {name: [] for name in STATISTICS.names}
            for number, x in zip(batch.column("_place").to_pylist(), batch.column("_x").to_pylist()):
                if number == 1:
                    seen, place, recent = OrderedValues(), 0, (None, None)
                if number != place + 1:
                    raise RuntimeError("the rows of a series don't follow each other")
                place = number
                seen.add(x)
                centre2 = seen.centre2()
                values = (len(seen), centre2, seen.mad4(centre2), seen.not_above(x), *recent)
                recent = (x, recent[0])
                for column, item in zip(found.values(), values):
                    column.append(item)
            names = [n for n in batch.schema.names if n not in ("_place", "_x")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names),
                 *(pa.array(found[f.name], pa.int32() if f.dataType == T.IntegerType() else pa.float64()) for f in STATISTICS)],
                names=[*names, *STATISTICS.names])

    return numbered.mapInArrow(run, T.StructType(kept.fields + STATISTICS.fields))
