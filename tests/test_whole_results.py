"""Results that must reach the end of their tables."""

import os

import pytest

from seriesloom.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not there")


def test_strides_reach_the_end(spark):
    """A clip of sf0.01 has more than the 1000 frames at which the sample once stopped."""
    data = "/root/testdata/sf0.01"
    got = {(r.clip, r.frame) for r in QUERIES["strided_sample"](spark, data).collect()}
    counts = spark.read.parquet(f"{data}/events.parquet").groupBy("event_type").count().collect()
    assert max(n for _, n in counts) > 1000
    assert got == {(clip, k) for clip, n in counts for k in range(10, n, 7)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="tables are not there")
def test_folded_words_equal_unicodedata(spark):
    import unicodedata

    from seriesloom.plans.registry import QUERIES

    rows = QUERIES["folded_words"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.folded == unicodedata.normalize("NFKC", r.word) for r in rows)
