import datetime as dt

import pytest

from marlspark.sources import paged
from marlspark.streaming.checkpoints import Checkpoints, in_window


def test_pages_of_shards(spark):
    spark.dataSource.register(paged.PagedFeed)
    rows = spark.read.format("paged_feed").option("fetch", "tests.feed:fetch").option("shards", "2").option("pageSize", "3").option("wait", "0").load()
    assert sorted(r.id for r in rows.collect()) == [f"{s}-{i}" for s in range(2) for i in range(7)]


def test_patience_ends():
    def fail():
        raise TimeoutError

    with pytest.raises(TimeoutError):
        paged.patient(fail, wait=0)


@pytest.mark.parametrize(
    ("error", "calls"),
    [(paged.FeedError(429), 4), (paged.FeedError(503), 4), (paged.FeedError(404), 1), (paged.FeedError(200, ("THROTTLED",)), 4), (paged.FeedError(200, ("ACCESS_DENIED",)), 1), (ConnectionError(), 4), (ValueError("bad page"), 1)],
)
def test_only_errors_that_may_pass_are_tried_again(error, calls):
    seen = []

    def fail():
        seen.append(1)
        raise error

    with pytest.raises(type(error)):
        paged.patient(fail, wait=0)
    assert len(seen) == calls


def test_checkpoints(spark):
    table, t = Checkpoints(spark), dt.datetime(2024, 1, 5)
    assert table.get("a") is None and table.window("a", t) == (None, t)
    assert not table.advance("a", t, failures=1) and not table.advance("a", t, 0, audited=False) and not table.advance("a", t, 0, dry_run=True)
    assert table.advance("a", t, 0)
    table.put("a", dt.datetime(2024, 1, 1), "set back by hand")
    start, end = table.window("a", t)
    assert start == dt.datetime(2023, 12, 31, 23, 58) and end == t
    assert table.history().count() == 2
    rows = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in (1, 5, 6)], "at timestamp")
    assert in_window(rows, "at", start, end).count() == 2 and in_window(rows, "at", None, end).count() == 2
