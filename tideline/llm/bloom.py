"""A Bloom filter of 64-bit hashes, made by Spark and small enough to broadcast at any size.

32 bits a hash and four places let about 2 in 10,000 other hashes pass. Beyond ``MOST_BITS`` the filter grows no
more and lets more pass; who uses it joins what passes, so that costs work and never changes a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import textwords

#: 64 MB broadcast; 128 MB pass through the driver while it is put together.
MOST_BITS = 1 << 29
PLACES = 4


def _places(hashes: np.ndarray, bits: int):
    shift = np.uint64(64 - bits)
    for k in range(PLACES):
        yield hashes >> shift
        hashes = textwords.mix(hashes + np.uint64(k + 1))


def _words(bits: int):
    def run(batches):
        for batch in batches:
            hashes = batch.column("hash").to_numpy().astype(np.uint64)
            at = np.unique(np.concatenate(list(_places(hashes, bits))))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            set_bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(set_bits.astype(np.int64))], names=["word", "bits"])

    return run


class Bloom:
    def __init__(self, hashes: DataFrame, count: int):
        """hashes: (hash long, never null), about ``count`` of them."""
        self.bits = int(min(max(32 * count, 1 << 12), MOST_BITS) - 1).bit_length()
        words = hashes.mapInArrow(_words(self.bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        self.words[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the (unsigned) hashes may be in the filter; all that are in it, are."""
        out, left = np.zeros(len(hashes), bool), np.arange(len(hashes))
        for k in range(PLACES):
            at = hashes >> np.uint64(64 - self.bits)
            here = (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            left, hashes = left[here], textwords.mix(hashes[here] + np.uint64(k + 1))
        out[left] = True
        return out
