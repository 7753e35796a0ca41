"""Leases over a snapshot of trials (state, lease_expiry), and capacities against requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RUNNING, WAITING
from .scan import running, scan


def lapsed(now: int) -> Column:
    """A running trial whose lease is over; one without a lease has none to lose."""
    return (F.col("state") == RUNNING) & (F.col("lease_expiry") <= now)


def claimable(now: int) -> Column:
    """Trials that wait, or run without a lease or with one that is over."""
    return (F.col("state") == WAITING) | ((F.col("state") == RUNNING) & (F.col("lease_expiry").isNull() | (F.col("lease_expiry") <= now)))


def claim_next(trials: DataFrame, now: int) -> DataFrame:
    """(study_id, trial_id): the trial that each study's next claim gets, the smallest that can be claimed."""
    return trials.where(claimable(now)).groupBy("study_id").agg(F.min("trial_id").alias("trial_id"))


def recovered(trials: DataFrame, now: int) -> DataFrame:
    """trials, with those whose lease is over waiting again and without a lease."""
    lost = F.coalesce(lapsed(now), F.lit(False))
    return trials.withColumns({"state": F.when(lost, WAITING).otherwise(F.col("state")), "lease_expiry": F.when(~lost, F.col("lease_expiry"))})


def best_fit(requests: DataFrame, devices: DataFrame, amount: str, request: str, capacity: str, device: str) -> DataFrame:
    """(request, device): the device with the least capacity that suffices, the smallest of equal ones; no row where none does.

    Requests and capacities are scanned once in falling order; the smallest capacity so far is the one that fits."""
    ask = requests.select(F.col(amount).cast("double").alias("x"), F.lit(1).alias("kind"), F.col(request).alias("key"))
    own = devices.groupBy(F.col(capacity).cast("double").alias("x")).agg(F.min(device).alias("key")).select("x", F.lit(0).alias("kind"), "key")
    both = ask.unionByName(own).where("x is not null").withColumn("fit", F.when(F.col("kind") == 0, F.struct("x", "key")))
    found = scan(both, [], [F.desc("x"), F.col("kind"), F.col("key")], {"best": running("min", "fit")})
    return found.where("kind = 1 and best is not null").select(F.col("key").alias("request"), F.col("best.key").alias("device"))
