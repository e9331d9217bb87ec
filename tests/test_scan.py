"""Segmented scans against plain windows, with keys cut into many small pieces."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.plans import scan as S

from .oracle import SF, norm


def rows_of(df, cols):
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def events(spark):
    """Events of which one user has a third, some without a user, a value or a time."""
    df = spark.read.parquet(f"{SF}/events.parquet")
    user = F.when(F.col("event_id") % 3 == 0, 7).when(F.col("event_id") % 50 == 1, None).otherwise(F.col("user_id"))
    value = F.when(F.col("event_id") % 4 != 1, F.col("value"))
    at = F.when(F.col("event_id") % 60 != 3, F.col("ts"))
    return df.select("event_id", user.alias("user"), value.alias("value"), at.alias("ts"), "event_type").cache()


@pytest.mark.parametrize("order", [["ts", "event_id"], ["-ts", "event_id"], ["event_type", "event_id"], ["-value", "event_id"], ["value"]])
def test_same_as_plain_windows(events, order):
    w = Window.partitionBy("user").orderBy(*[F.desc(n[1:]) if n[0] == "-" else F.asc(n) for n in order])
    upto, rest = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v = F.round(F.col("value") * 100).cast("long")  # whole numbers, as sums of others depend on their order
    outs = {
        "rank": (S.rank(), F.rank().over(w)), "dense": (S.dense_rank(), F.dense_rank().over(w)), "all": (S.whole(v), F.sum(v).over(Window.partitionBy("user"))),
    }
    if len(order) > 1:  # the others aren't defined among equal rows
        outs |= {
            "number": (S.row_number(), F.row_number().over(w)), "sum": (S.running(v), F.coalesce(F.sum(v).over(upto), F.lit(0))),
            "before": (S.running(v, including=False), F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))),
            "lag": (S.lag(v), F.lag(v).over(w)), "lead": (S.lead(v), F.lead(v).over(w)),
            "known": (S.last_known(v), F.last(v, ignorenulls=True).over(upto)), "next": (S.next_known(v), F.first(v, ignorenulls=True).over(rest)),
        }
    want = events.withColumns({k: c for k, (_, c) in outs.items()})
    cols = ["event_id", *outs]
    for least, pieces in ((5, 100), (20, 7), (10**6, 4096)):
        got = S.scan(events, "user", order, {k: s for k, (s, _) in outs.items()}, least, pieces)
        assert rows_of(got, cols) == rows_of(want, cols)


def test_a_hot_key_is_cut_and_bounds_hold(events):
    order = S.Order(events, ["ts", "event_id"])
    cuts = S._cuts(events, ["user"], order, 5, 30)
    assert 0 < len(cuts) < 30 and sum(len(c[-1]) for c in cuts) < 90
    bounds = dict(cuts)[7]
    assert len(bounds) >= 9
    sizes = events.where("user = 7").withColumn("p", F.width_bucket(order.place, F.lit(bounds[1]), F.lit(bounds[-1]), F.lit(8))).groupBy("p").count()
    assert sizes.agg(F.max("count")).first()[0] < events.where("user = 7").count() / 2


def test_empty_and_unsortable(spark, events):
    assert S.scan(events.limit(0), "user", "ts", {"n": S.row_number()}, 0).collect() == []
    with pytest.raises(ValueError):
        S.scan(events.withColumn("a", F.array("ts")), "user", "a", {"n": S.row_number()}, 5)
    with pytest.raises(ValueError):
        S.scan(events, "user", "-event_type", {"n": S.row_number()}, 5)
