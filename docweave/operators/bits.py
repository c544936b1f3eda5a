"""A fixed-size bit filter over keys: rows that cannot have a partner are left out before a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: 1 MB, whatever the data. With more keys it lets more rows through, never fewer than it must.
BITS = 1 << 23
_BUCKET = 32768


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


class BitFilter:
    """The keys of a column as one bit each."""

    def __init__(self, df: DataFrame, key: str | None = None, place: str | None = None):
        """Of the column key, or of a column place that has bit numbers below BITS already."""
        at = _place(F.col(key)) if key else F.col(place)
        places = df.select(at.alias("p")).select(F.floor(F.col("p") / _BUCKET).alias("bucket"), (F.col("p") % _BUCKET).alias("bit"))
        rows = places.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # at most BITS / _BUCKET rows of 4 KB
        bits = np.zeros((BITS // _BUCKET, _BUCKET // 8), dtype=np.uint8)
        for r in rows:
            bits[r["bucket"]] = np.frombuffer(r["bits"], dtype=np.uint8)
        self.shared = df.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def maybe(self, key: str) -> Column:
        """False where a key is certainly not among the filter's; null keys are not."""
        shared = self.shared

        @F.pandas_udf("boolean")
        def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for p in batches:
                at = p.to_numpy()
                yield pd.Series((shared.value[at >> 3] >> (at & 7) & 1).astype(bool))

        return F.col(key).isNotNull() & test(_place(F.col(key)))
