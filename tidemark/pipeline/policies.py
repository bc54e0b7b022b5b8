"""What to do when a stage fails."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from tidemark.pipeline.core import Stage, StageResult


@dataclass(frozen=True)
class Incident:
    """A failed attempt: an exception was raised, or a result says FAILED."""

    stage: Stage
    attempt: int
    started_at: float | None
    result: StageResult | None = None
    exception: BaseException | None = None


@dataclass(frozen=True)
class Decision:
    proceed: bool = True
    retry: bool = False
    cancel: bool = False
    reason: str | None = None


class Policy(Protocol):
    def decide(self, incident: Incident) -> Decision: ...


@dataclass(frozen=True)
class RetryPolicy:
    """Try again at once after an exception, up to the stage's number of attempts."""

    def decide(self, incident: Incident) -> Decision:
        if incident.exception is not None and incident.attempt < incident.stage.max_attempts:
            return Decision(retry=True, reason=f"attempt {incident.attempt} of {incident.stage.max_attempts} raised")
        return Decision()


@dataclass(frozen=True)
class FailurePolicy:
    """A result that says FAILED stops the pipeline, or with ``fail_fast=False`` is put up with."""

    fail_fast: bool = True

    def decide(self, incident: Incident) -> Decision:
        if incident.exception is not None or incident.result is None or not incident.result.status.is_failure:
            return Decision()
        if self.fail_fast:
            return Decision(proceed=False, cancel=True, reason=f"stage {incident.stage.id} failed")
        return Decision(reason=f"failure of stage {incident.stage.id} tolerated")


@dataclass(frozen=True)
class TimeoutPolicy:
    """Cancel once a run takes longer; executors also look while a stage is running."""

    seconds: float

    def decide(self, incident: Incident) -> Decision:
        if incident.started_at is not None and time.monotonic() - incident.started_at > self.seconds:
            return Decision(proceed=False, cancel=True, reason=f"longer than {self.seconds:g} s")
        return Decision()


class PolicyManager:
    """Merges decisions: all must let proceed, any may retry or cancel; a cancel ends the round."""

    def __init__(self, policies: Sequence[Policy] | None = None) -> None:
        self.policies = list(policies) if policies is not None else [FailurePolicy(), RetryPolicy()]

    @property
    def time_limit(self) -> float | None:
        limits = [p.seconds for p in self.policies if isinstance(p, TimeoutPolicy)]
        return min(limits) if limits else None

    def decide(self, incident: Incident) -> Decision:
        proceed, retry, reason = True, False, None
        for policy in self.policies:
            d = policy.decide(incident)
            reason = reason if reason is not None else d.reason
            if d.cancel:
                return Decision(proceed=False, cancel=True, reason=reason)
            proceed, retry = proceed and d.proceed, retry or d.retry
        return Decision(proceed, retry, False, reason)
