"""Rows whose key is in another table, without shuffling the rows where that can be.

spread_join() joins rows to what is told of their keys.  A key with more than one
part in SHARE of all rows is hot; there are at most SHARE such keys, so they are
broadcast and their rows stay where they are.  The rest meet by the key.

Members is for ids that are to be found again.  The ids set bits of a map of bounded size (MOST_BITS at most), which travels to
the tasks; rows whose bit is clear are surely not in the table.  A few others
get through, so callers must do no harm with them.  At sizes where the map is
full, every row gets through and only the saving is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MOST_BITS = 1 << 27
SHARE = 20_000


def spread_join(rows: DataFrame, told: DataFrame, on: list[str], total: int, least: int) -> DataFrame:
    """rows joined to told, which has their keys and n, the number of rows of each.

    total: number of all rows; no key of `least` rows or fewer is hot.
    """
    limit = max(least, total // SHARE)
    heavy, light = told.filter(F.col("n") > limit).drop("n"), told.filter(F.col("n") <= limit).drop("n")
    if heavy.isEmpty():
        return rows.join(light, on)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on)
    return rows.join(F.broadcast(heavy), on).unionByName(rest)


class Members:
    def __init__(self, ids: DataFrame, column: str):
        n = ids.count()
        self.bits = min(MOST_BITS, 1 << max(16, (16 * n).bit_length()))
        at = self.place(F.col(column))
        words = ids.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("bit"))
        found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # bits / 64 rows at most
        map_ = np.zeros(self.bits // 64, np.int64)
        map_[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        self.map = ids.sparkSession.sparkContext.broadcast(map_)

    def place(self, id_: Column) -> Column:
        return F.pmod(F.xxhash64(id_.cast("long")), F.lit(self.bits))

    def marked(self, df: DataFrame, column: str) -> DataFrame:
        """df with the place of each row's bit as one more column at its end."""
        name = "place"
        while name in df.columns:
            name += "_"
        return df.withColumn(name, self.place(F.col(column)))

    def pick(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of df that may be members."""
        return self.through(df, column, lambda batches: batches, df.schema)

    def through(self, df: DataFrame, column: str, f, schema) -> DataFrame:
        """df.mapInArrow(f, schema) of the rows that may be members, in one Python step."""
        map_ = self.map

        def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(batch.num_columns - 1).to_numpy()
                hit = (map_.value[at >> 6] >> (at & 63)) & 1
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(hit == 1))

        return self.marked(df, column).mapInArrow(lambda batches: f(picked(batches)), schema)
