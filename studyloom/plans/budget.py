"""When a study stops."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Used:
    trials: int = 0
    wall_ms: int = 0
    epochs: int = 0
    steps: int = 0


@dataclass(frozen=True)
class Budget:
    """limit of one quantity: trials, wall_ms, epochs or steps; None is no limit."""

    what: str = "trials"
    limit: int | None = None

    def exhausted(self, used: Used) -> bool:
        return self.limit is not None and getattr(used, self.what) >= self.limit

    def remaining(self, used: Used) -> int | None:
        return None if self.limit is None else max(0, self.limit - getattr(used, self.what))

    def describe(self) -> str:
        return "unbounded" if self.limit is None else f"{self.limit} {self.what}"
