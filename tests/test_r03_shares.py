"""What a task holds doesn't grow with the input: a larger one is dealt over more tasks."""

from siftline.operators import keyword_index as ki
from siftline.tables import dealt


def test_shares(spark):
    x = spark.range(10)
    assert dealt(x, 10, 1, "id").rdd.getNumPartitions() == 10 and dealt(x, 10, 100, "id").rdd.getNumPartitions() == 4
    assert ki._spread(10) == ki.SPREAD and ki._spread(10 * ki.SHARDS * ki.WORDS_A_FILE) == 10
