"""Types of the history tables and the errors that operations on them raise."""

from __future__ import annotations

from pyspark.sql import types as T

PARAM_VALUE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("f", T.DoubleType()), T.StructField("i", T.LongType()), T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType())])
PARAMS = T.MapType(T.StringType(), PARAM_VALUE)
METRICS = T.MapType(T.StringType(), T.DoubleType())
DIRECTIONS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("direction", T.StringType())]))
ENV = T.StructType([T.StructField(c, T.StringType()) for c in ("os", "arch", "core_version")])

STUDIES = T.StructType([T.StructField("study_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("directions", DIRECTIONS), T.StructField("sampler", T.StringType()), T.StructField("pruner", T.StringType()), T.StructField("created_ms", T.LongType())])
TRIALS = T.StructType(
    [
        T.StructField("study_id", T.LongType()),
        T.StructField("trial_id", T.LongType()),
        T.StructField("params", PARAMS),
        T.StructField("state", T.StringType()),
        T.StructField("final", METRICS),
        T.StructField("seed", T.LongType()),
        T.StructField("env", ENV),
        T.StructField("queued_ms", T.LongType()),
        T.StructField("started_ms", T.LongType()),
        T.StructField("completed_ms", T.LongType()),
        T.StructField("lease_owner", T.StringType()),
        T.StructField("lease_expiry", T.LongType()),
    ]
)
REPORTS = T.StructType([T.StructField("study_id", T.LongType()), T.StructField("trial_id", T.LongType()), T.StructField("step", T.LongType()), T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("seq", T.LongType())])
ARTIFACTS = T.StructType([T.StructField("trial_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("bytes", T.BinaryType()), T.StructField("seq", T.LongType())])

WAITING, RUNNING, COMPLETE, PRUNED, FAILED, CANCELLED = "Waiting", "Running", "Complete", "Pruned", "Failed", "Cancelled"
STATES = (WAITING, RUNNING, COMPLETE, PRUNED, FAILED, CANCELLED)
TERMINAL = (COMPLETE, PRUNED, FAILED, CANCELLED)
#: Whose reports others are compared with.
PEERS = (COMPLETE, PRUNED)
MINIMIZE, MAXIMIZE = "minimize", "maximize"


def sign(direction: str) -> int:
    """1 where smaller is better, -1 where larger is."""
    if direction not in (MINIMIZE, MAXIMIZE):
        raise ValueError(f"no such direction: {direction}")
    return 1 if direction == MINIMIZE else -1


def is_better(a: float, b: float, direction: str) -> bool:
    return sign(direction) * a < sign(direction) * b


class StudyError(Exception):
    """Base of all errors here."""


class NotFound(StudyError):
    def __init__(self, what: str, key) -> None:
        super().__init__(f"{what} {key} does not exist")
        self.what, self.key = what, key


class InvalidDistribution(StudyError):
    def __init__(self, name: str, reason: str) -> None:
        super().__init__(f"parameter {name}: {reason}")
        self.name, self.reason = name, reason


class InvalidSpace(StudyError):
    pass


class MissingParam(StudyError):
    def __init__(self, name: str) -> None:
        super().__init__(f"no parameter {name}")
        self.name = name


class TypeMismatch(StudyError):
    def __init__(self, name: str, expected: str, found: str) -> None:
        super().__init__(f"parameter {name} is {found}, not {expected}")
        self.name, self.expected, self.found = name, expected, found


class ObjectiveFailed(StudyError):
    pass


class StorageError(StudyError):
    pass
