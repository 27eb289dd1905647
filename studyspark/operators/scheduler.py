"""Spaced review: risk, mastery and priority as column expressions, and reviews folded in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of a review state.
MASTERED_AT, EASE_START, EASE_LEAST, INTERVAL_MOST = 5, 2.5, 1.3, 365_000
LIMITS = {"review_count": (0, 1_000_000), "correct_streak": (0, 1_000_000), "interval_days": (1, 365_000), "ease_factor": (0.01, 100.0)}


def rounded(c: Column, digits: int = 3) -> Column:
    """Half-even on the binary value scaled by a power of ten."""
    return F.rint(c * 10**digits) / 10**digits


def day(c: Column) -> Column:
    """A date from ``YYYY-MM-DD``; null for anything else."""
    return F.when(c.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), c.try_cast("date"))


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing state columns filled in, ease raised to its least value, mastered by flag or streak; values out of limits raise."""
    def limited(name: str, default) -> Column:
        low, high = LIMITS[name]
        c = F.coalesce(F.col(name), F.lit(default))
        return F.when(c.between(low, high), c).otherwise(F.raise_error(F.lit(f"{name} must be between {low} and {high}")))

    out = df.withColumns(
        {
            "review_count": limited("review_count", 0), "correct_streak": limited("correct_streak", 0),
            "interval_days": limited("interval_days", 1), "ease_factor": F.greatest(limited("ease_factor", EASE_START), F.lit(EASE_LEAST)),
        }
    )
    return out.withColumn("mastered", F.coalesce(F.col("mastered"), F.lit(False)) | (F.col("correct_streak") >= MASTERED_AT))


def overdue(due: Column, today: Column) -> Column:
    """Days past due, at least 0; an unknown due day counts as one day."""
    return F.when(due.isNull(), 1).otherwise(F.greatest(F.lit(0), F.datediff(today, due)))


def with_scores(df: DataFrame, today: str, due: str = "next_review") -> DataFrame:
    """``df`` (a full state) with ``days_overdue``, ``forgetting_risk``, ``mastery_probability`` and ``review_priority``."""
    now = F.lit(today).cast("date")
    late = overdue(F.col(due), now)
    interval, streak, ease = F.greatest(F.lit(1), F.col("interval_days")), F.col("correct_streak"), F.col("ease_factor")
    base = F.when(late == 0, 0.25).otherwise(0.45)
    risk = base + 0.45 * late / interval - F.least(F.lit(0.45), 0.08 * streak) - F.least(F.lit(0.2), 0.08 * (ease - 1.3))
    risk = rounded(F.least(F.lit(0.99), F.greatest(F.lit(0.01), risk)))
    risk = F.when(F.col("mastered") & (F.col(due) > now), 0.05).otherwise(risk)
    known = df.withColumns({"days_overdue": late, "forgetting_risk": risk})
    mastery = 0.2 + F.least(F.lit(0.7), 0.14 * streak) + F.least(F.lit(0.15), 0.06 * (ease - 1.3)) - 0.35 * F.col("forgetting_risk")
    mastery = F.when(F.col("mastered"), 0.98).otherwise(rounded(F.least(F.lit(0.97), F.greatest(F.lit(0.03), mastery))))
    untried = F.when(streak == 0, F.least(F.lit(0.25), 0.02 * F.col("review_count"))).otherwise(0.0)
    priority = F.col("forgetting_risk") + 0.25 * F.least(F.lit(1.0), F.col("days_overdue") / interval) + F.greatest(F.lit(0.0), 0.12 * (3 - streak)) + untried
    priority = F.when(F.col("mastered"), 0.0).otherwise(rounded(F.least(F.lit(1.0), priority)))
    return known.withColumns({"mastery_probability": mastery, "review_priority": priority})


def new_ease(ease: Column, quality: Column) -> Column:
    q = F.greatest(F.lit(0), F.least(F.lit(5), quality))
    return rounded(F.greatest(F.lit(EASE_LEAST), ease + 0.1 - (5 - q) * (0.08 + 0.02 * (5 - q))))


def review(df: DataFrame, quality: Column, today: str) -> DataFrame:
    """Each row's state after one review of ``quality`` (0..5) on ``today``; other columns stay."""
    ease, good = new_ease(F.col("ease_factor"), quality), quality >= 3
    streak = F.when(good, F.col("correct_streak") + 1).otherwise(0)
    interval = F.when(~good | (streak == 1), 1).when(streak == 2, 6).otherwise(F.least(F.lit(INTERVAL_MOST), F.bround(F.col("interval_days") * ease)))
    interval = F.greatest(F.lit(1), interval).cast("int")
    return df.withColumns(
        {
            "review_count": F.col("review_count") + 1, "correct_streak": streak, "interval_days": interval, "ease_factor": ease,
            "mastered": good & (streak >= MASTERED_AT), "last_reviewed": F.lit(today).cast("date"), "next_review": F.date_add(F.lit(today).cast("date"), interval),
        }
    )


def step(streak: int, interval: int, ease: float, quality: int) -> tuple[int, int, float]:
    """Streak, interval and ease after one more review, the rule of ``review`` for one item at a time."""
    q = min(5, max(0, quality))
    lack = 5 - q
    ease = round(max(EASE_LEAST, ease + 0.1 - lack * (0.08 + 0.02 * lack)) * 1000) / 1000
    if q < 3:
        return 0, 1, ease
    streak += 1
    return streak, 1 if streak == 1 else 6 if streak == 2 else max(1, min(INTERVAL_MOST, round(interval * ease))), ease


def fold_reviews(reviews: DataFrame) -> DataFrame:
    """``item, reviews, correct_streak, interval_days, ease_factor, mastered, last_day`` after all reviews of each item.

    ``reviews``: ``item`` string, ``at`` timestamp, ``tie`` bigint, ``quality`` int; rows with a null item, time or quality are
    left out. Items are spread by hash and sorted within each partition, where the sort spills; the fold streams over the rows
    and holds one item's state, so an item with very many reviews needs no more memory than any other.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list | None = None
        for batch in batches:
            done = []
            for item, q, d in zip(batch["item"].tolist(), batch["quality"].tolist(), batch["day"].tolist()):
                if state is None or state[0] != item:
                    if state is not None:
                        done.append(state)
                    state = [item, 0, 0, 1, EASE_START, False, None]
                streak, interval, ease = step(state[2], state[3], state[4], q)
                state = [item, state[1] + 1, streak, interval, ease, streak >= MASTERED_AT, d]
            if done:
                yield pd.DataFrame(done, columns=_FOLDED)
        if state is not None:
            yield pd.DataFrame([state], columns=_FOLDED)

    rows = reviews.dropna(subset=["item", "at", "quality"]).select("item", "at", "tie", F.col("quality").cast("int"), F.to_date("at").alias("day"))
    ordered = rows.repartition("item").sortWithinPartitions("item", "at", "tie").select("item", "quality", "day")
    return ordered.mapInPandas(fold, "item string, reviews bigint, correct_streak int, interval_days int, ease_factor double, mastered boolean, last_day date")


_FOLDED = ["item", "reviews", "correct_streak", "interval_days", "ease_factor", "mastered", "last_day"]


def basic_interval(reviews: DataFrame) -> DataFrame:
    """``item, interval_days``: 2 to the number of right answers since the last wrong one, 1 to 32 days.

    Only sums are kept per item: its last wrong answer and the right ones after it, so no history is gathered.
    """
    rows = reviews.dropna(subset=["item", "at", "quality"])
    last = rows.groupBy("item").agg(F.max(F.when(F.col("quality") < 3, F.struct("at", "tie"))).alias("wrong"))
    after = rows.join(last, "item").where((F.col("quality") >= 3) & (F.col("wrong").isNull() | (F.struct("at", "tie") > F.col("wrong"))))
    runs = after.groupBy("item").agg(F.count("*").alias("run"))
    return last.join(runs, "item", "left").select(
        "item", F.least(F.lit(32), F.pow(F.lit(2), F.least(F.lit(5), F.coalesce("run", F.lit(0))))).cast("int").alias("interval_days")
    )


def review_order(df: DataFrame) -> list[Column]:
    """Order of the due queue: priority, then due day (unknown first), then the first name that isn't empty."""
    names = [F.expr(f"nullif({c}, '')") for c in ("id", "word", "content") if c in df.columns]
    return [F.desc("review_priority"), F.coalesce(F.col("next_review").cast("string"), F.lit("0000-00-00")), F.coalesce(*names, F.lit(""))]


def due_queue(df: DataFrame, today: str, n: int) -> DataFrame:
    """The first ``n`` unmastered items that are due (unknown days are)."""
    now = F.lit(today).cast("date")
    due = ~F.col("mastered") & (F.col("next_review").isNull() | (F.col("next_review") <= now))
    return df.where(due).orderBy(*review_order(df)).limit(n)


def weakest(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` unmastered items in review order."""
    return df.where(~F.col("mastered")).orderBy(*review_order(df)).limit(n)


def mastery_stats(df: DataFrame, today: str, *by: str) -> DataFrame:
    """Total, mastered, active and due items, and the percentage mastered (0.0 without items)."""
    now = F.lit(today).cast("date")
    due = ~F.col("mastered") & (F.col("next_review").isNull() | (F.col("next_review") <= now))
    out = df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("mastered").alias("mastered"), F.count_if(~F.col("mastered")).alias("active"), F.count_if(due).alias("due"))
    return out.withColumn("mastered_percent", F.coalesce(rounded(F.try_divide(100.0 * F.col("mastered"), F.col("total")), 1), F.lit(0.0)))
