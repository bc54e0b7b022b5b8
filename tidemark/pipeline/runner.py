"""Executors: run a pipeline's stages, one by one or group by group."""

from __future__ import annotations

import asyncio
import contextvars
import time
from dataclasses import dataclass, field

from tidemark.pipeline.core import Context, Pipeline, Stage, StageResult, Status
from tidemark.pipeline.hooks import Event, HookManager, Notice
from tidemark.pipeline.policies import Incident, PolicyManager

#: (stage id, attempt) of the code that is running; private to each stage's task.
current_stage: contextvars.ContextVar[tuple[str, int] | None] = contextvars.ContextVar("current_stage", default=None)


@dataclass
class ExecutionResult:
    pipeline_id: str
    status: Status
    stages: list[StageResult] = field(default_factory=list)
    error: BaseException | None = None
    seconds: float = 0.0


@dataclass
class _Outcome:
    result: StageResult
    cancel: bool = False
    error: BaseException | None = None
    reason: str | None = None


class _Executor:
    def __init__(self, policies: PolicyManager | None = None, hooks: HookManager | None = None) -> None:
        self.policies, self.hooks = policies or PolicyManager(), hooks or HookManager()

    def run(self, pipeline: Pipeline, context: Context | None = None) -> ExecutionResult:
        return asyncio.run(self.execute(pipeline, context))

    def _units(self, pipeline: Pipeline) -> list[tuple[Stage, ...]]:
        raise NotImplementedError

    async def execute(self, pipeline: Pipeline, context: Context | None = None) -> ExecutionResult:
        """Never raises for a stage: an exception past its attempts gives a FAILED result that carries it."""
        context = context or Context()
        began = time.monotonic()
        out = ExecutionResult(pipeline.id, Status.RUNNING)
        self.hooks.notify(Notice(Event.BEFORE_PIPELINE, pipeline.name))
        stopped: str | None = None
        for unit in self._units(pipeline):
            outcomes = await asyncio.gather(*(self._attempts(pipeline, s, context, began) for s in unit))
            out.stages += [o.result for o in outcomes]
            broken = next((o for o in outcomes if o.error is not None or o.cancel), None)
            if broken is not None:
                # Siblings have finished; what comes after does not start.
                out.error, stopped = broken.error, broken.reason or broken.result.message
                break
        worst = [s.status for s in out.stages if not s.succeeded]
        out.status = Status.COMPLETED if not worst else Status.TIMEOUT if Status.TIMEOUT in worst else Status.FAILED
        out.seconds = time.monotonic() - began
        event = Event.PIPELINE_FAILED if stopped is not None else Event.AFTER_PIPELINE
        self.hooks.notify(Notice(event, pipeline.name, status=out.status.value, error=stopped, seconds=out.seconds))
        return out

    async def _attempts(self, pipeline: Pipeline, step: Stage, context: Context, began: float) -> _Outcome:
        attempt = 1
        while True:
            current_stage.set((step.id, attempt))
            start = time.monotonic()
            self.hooks.notify(Notice(Event.BEFORE_STAGE, pipeline.name, step.id, attempt))
            error: BaseException | None = None
            try:
                limit = self.policies.time_limit
                left = None if limit is None else max(0.0, limit - (start - began))
                result = await asyncio.wait_for(step.execute(context), left)
            except TimeoutError as e:
                result, error = StageResult(step.id, Status.TIMEOUT, str(e) or "out of time"), e
            except Exception as e:
                result, error = StageResult(step.id, Status.FAILED, f"{type(e).__name__}: {e}"), e
            seconds = time.monotonic() - start
            if result.succeeded:
                self.hooks.notify(Notice(Event.AFTER_STAGE, pipeline.name, step.id, attempt, result.status.value, None, seconds))
                return _Outcome(result)
            self.hooks.notify(Notice(Event.STAGE_FAILED, pipeline.name, step.id, attempt, result.status.value, result.message, seconds))
            decision = self.policies.decide(Incident(step, attempt, began, result, error))
            if decision.cancel or not decision.retry:
                return _Outcome(result, decision.cancel, error, decision.reason)
            attempt += 1


class SequentialExecutor(_Executor):
    """Every stage by itself, groups unrolled in order."""

    def _units(self, pipeline: Pipeline) -> list[tuple[Stage, ...]]:
        return [(s,) for s in pipeline]


class ParallelExecutor(_Executor):
    """The stages of a group together; a failure stops the next group, not the siblings."""

    def _units(self, pipeline: Pipeline) -> list[tuple[Stage, ...]]:
        return list(pipeline.groups)
