"""The most similar rows of each vector, kept block by block, against all pairs."""

import numpy as np
import pytest

from palimpsest.operators import tabular


@pytest.mark.parametrize("block_rows", [50, 65_536])
def test_the_first_of_each_vector_by_blocks(spark, block_rows):
    random = np.random.default_rng(6)
    v = random.normal(size=(300, 5)).astype(np.float32)
    v[:60] = v[0]  # copies: ties go by the candidate
    v[70] = 0
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>")
    pairs = tabular.similar_pairs(frame, "id", "v", 0.4)
    from pyspark.sql import functions as F

    want = sorted(map(tuple, tabular.similar_top(pairs.withColumn("score", F.round("score", 6)), frame.limit(0).withColumnRenamed("id", "key"), "key", 7, 0).select("query", "candidate", "score", "rank").collect()))
    first = tabular.similar_first(frame, "id", "v", 0.4, 7, 6, block_rows)
    got = sorted(map(tuple, tabular.padded_top(first, frame.limit(0), "id", 7, 0).select("query", "candidate", "score", "rank").collect()))
    assert len(got) > 1500 and got == want
    assert first.count() <= 7 * 300 and tabular.similar_first(frame.limit(0), "id", "v", 0.4, 7, 6).count() == 0
