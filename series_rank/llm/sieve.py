"""A bitmap of fixed size that tells which rows cannot have one of some keys.

Rows that it lets pass still need the exact join; those that it holds back are
certain. Its size does not depend on the number of keys: with very many keys it
lets all rows pass, which costs time only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25
PAGE = 1 << 15  # bits of a page, as bitmap_construct_agg makes them


@dataclass(frozen=True)
class Sieve:
    bits: bytes

    @classmethod
    def of(cls, keys: DataFrame, *key: str) -> Sieve:
        place = F.pmod(F.xxhash64(*key), F.lit(BITS))
        pages = keys.select(F.floor(place / PAGE).alias("page"), (place % PAGE).alias("bit")).groupBy("page").agg(
            F.bitmap_construct_agg("bit").alias("bits")
        )
        out = bytearray(BITS // 8)
        for r in pages.collect():  # at most BITS / PAGE pages
            out[r["page"] * PAGE // 8 : (r["page"] + 1) * PAGE // 8] = bytes(r["bits"])
        return cls(bytes(out))

    def may_hold(self, *key: Column) -> Column:
        held = self.bits

        def test(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table = np.frombuffer(held, np.uint8)
            for batch in batches:
                at = batch.to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.array(table[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

        test.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(test, "boolean")(F.pmod(F.xxhash64(*key), F.lit(BITS)))
