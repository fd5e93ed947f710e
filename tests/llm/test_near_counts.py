"""The order of prefixes counts all sets."""

import numpy as np

from sievework.llm import near_dedup


def test_counts_are_of_all_sets(spark):
    sets = spark.createDataFrame([(k, k, np.arange(k % 7, dtype=np.uint64).tobytes()) for k in range(500)], "doc_id long, component long, shingles binary")
    assert near_dedup._counts(sets).sum() == sum(k % 7 for k in range(500))
    assert not hasattr(near_dedup, "COUNTED")
