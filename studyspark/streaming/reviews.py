"""Reviews as a stream: states per item, and counts by time with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scheduler import EASE_START, MASTERED_AT, step

_STATE = "correct_streak int, interval_days int, ease_factor double, reviews bigint"


def states(reviews: DataFrame) -> DataFrame:
    """``item, reviews, correct_streak, interval_days, ease_factor, mastered`` after each micro-batch that has reviews of the item.

    ``reviews``: a stream of item string, at timestamp, tie bigint, quality int. Within a batch reviews apply in order of time.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, interval, ease, n = state.get if state.exists else (0, 1, EASE_START, 0)
        rows = pd.concat(list(parts)).sort_values(["at", "tie"])  # one item's reviews of one micro-batch
        for q in rows["quality"].tolist():
            streak, interval, ease = step(streak, interval, ease, q)
            n += 1
        state.update((streak, interval, ease, n))
        yield pd.DataFrame([(key[0], n, streak, interval, ease, streak >= MASTERED_AT)], columns=["item", "reviews", "correct_streak", "interval_days", "ease_factor", "mastered"])

    return reviews.groupBy("item").applyInPandasWithState(
        update, "item string, reviews bigint, correct_streak int, interval_days int, ease_factor double, mastered boolean", _STATE, "update", GroupStateTimeout.NoTimeout
    )


def by_window(reviews: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """``start, reviews, right`` by tumbling windows; rows later than the watermark are left out."""
    return (
        reviews.withWatermark("at", late).groupBy(F.window("at", width).alias("w"))
        .agg(F.count("*").alias("reviews"), F.count_if(F.col("quality") >= 3).alias("right")).select(F.col("w.start").alias("start"), "reviews", "right")
    )
