"""The shuffle path of decontamination: same rows as the broadcast path, no text in the shuffled windows."""

import pytest

from matstream.llm import decontam
from matstream.llm.common import table
from tests.llm.conftest import SF


def as_set(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def by_shuffle(monkeypatch):
    def run(docs, bench):
        monkeypatch.setattr(decontam, "MAX_BROADCAST_WINDOWS", 0)
        out = as_set(decontam.contamination(docs, bench))
        monkeypatch.undo()
        return out
    return run


def test_same_rows_on_given_documents(spark, docs, by_shuffle):
    bench = table(spark, SF, "benchmark")
    assert by_shuffle(docs, bench) == as_set(decontam.contamination(docs, bench))


def test_same_rows_on_odd_and_long_documents(spark, odd, by_shuffle):
    long = " ".join(f"w{i}" for i in range(20_000))
    more = spark.createDataFrame([(100 + i, long + f" x{i} one two three", "en", "s", 0, "x") for i in range(8)], odd.schema)
    docs = odd.unionByName(more).repartition(4)
    bench = spark.createDataFrame([(1, "One two three"), (1, "One two three"), (2, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"),
                                   (None, "w w w w w w w w w w w"), (4, ""), (5, None)], "item_id long, text string")
    want = as_set(decontam.contamination(docs, bench))
    assert by_shuffle(docs, bench) == want and sum("contaminated=True" in r for r in want) >= 11


def test_items_may_have_text_ids(spark, odd, by_shuffle):
    bench = spark.createDataFrame([("a-1", "one two three"), ("b", "nowhere at all")], "item_id string, text string")
    want = as_set(decontam.contamination(odd, bench))
    assert sum("n_items=1" in r for r in want) == 4 and by_shuffle(odd, bench) == want
