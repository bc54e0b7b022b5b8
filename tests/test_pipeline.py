import asyncio
import time

import pytest

from tidemark.pipeline import Context, FailurePolicy, HookManager, LoggingHook, MetricsHook, ParallelExecutor, Pipeline, PipelineBuilder, PolicyManager, RetryPolicy, SequentialExecutor, Stage, StageResult, Status, TimeoutPolicy, TracingHook, stage
from tidemark.pipeline.core import Registry
from tidemark.pipeline.runner import current_stage

EXECUTORS = [SequentialExecutor, ParallelExecutor]


def failing(name):
    return stage(name, lambda c: StageResult(name, Status.FAILED, "no"))


def ids(result):
    return [s.stage_id for s in result.stages]


@pytest.mark.parametrize("executor", EXECUTORS)
def test_order_and_context(executor):
    p = PipelineBuilder().named("p").add_stage(stage("a", lambda c: c.put("x", 1))).add_stage(stage("b", lambda c: c.require("x") + 1)).build()
    r = executor().run(p, Context())
    assert r.status is Status.COMPLETED and ids(r) == ["a", "b"] and r.stages[1].values["value"] == 2


@pytest.mark.parametrize("executor", EXECUTORS)
def test_retries_exceptions_only(executor):
    calls = []

    def flaky(c):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("once more")

    assert executor().run(Pipeline("p", (stage("a", flaky),))).status is Status.COMPLETED and len(calls) == 3
    calls.clear()
    r = executor().run(Pipeline("p", (stage("a", flaky, max_attempts=2), stage("b", lambda c: 1))))
    assert r.status is Status.FAILED and isinstance(r.error, OSError) and ids(r) == ["a"]


@pytest.mark.parametrize("executor", EXECUTORS)
def test_failed_results(executor):
    p = Pipeline("p", (failing("a"), stage("b", lambda c: 1)))
    assert ids(executor().run(p)) == ["a"]
    r = executor(PolicyManager([FailurePolicy(fail_fast=False), RetryPolicy()])).run(p)
    assert ids(r) == ["a", "b"] and r.status is Status.FAILED


def test_siblings_finish_and_the_next_group_does_not_start():
    done = []
    p = PipelineBuilder().named("p").add_group(failing("a"), stage("b", lambda c: (time.sleep(0.1), done.append("b")))).add_stage(stage("c", lambda c: done.append("c"))).build()
    r = ParallelExecutor().run(p)
    assert done == ["b"] and ids(r) == ["a", "b"]


def test_timeout_interrupts_a_running_stage():
    class Slow(Stage):
        async def execute(self, context):
            await asyncio.sleep(5)
            return self.completed()

    start = time.monotonic()
    r = SequentialExecutor(PolicyManager([TimeoutPolicy(0.2), RetryPolicy()])).run(Pipeline("p", (Slow("s"), stage("b", lambda c: 1))))
    assert r.status is Status.TIMEOUT and ids(r) == ["s"] and time.monotonic() - start < 3


def test_hooks_tell_failures_as_failures_and_time_each_attempt():
    m, t = MetricsHook(), TracingHook()

    class Broken:
        def notify(self, notice):
            raise RuntimeError

    r = SequentialExecutor(hooks=HookManager([Broken(), LoggingHook(), m, t])).run(Pipeline("p", (stage("a", lambda c: 1 / 0, max_attempts=2),)))
    assert r.status is Status.FAILED
    assert [(x["stage_name"], x["status"], x["attempt"]) for x in m.rows] == [("a", "FAILED", 1), ("a", "FAILED", 2), ("", "FAILED", 1)]
    assert all(s.end for s in t.spans) and sum(m.buckets["a", "FAILED"]) == 2


def test_stage_state_is_private():
    seen = {}

    def look(name):
        return stage(name, lambda c: seen.__setitem__(name, current_stage.get()))

    ParallelExecutor().run(Pipeline("p", ((look("a"), look("b")),)))
    assert seen == {"a": ("a", 1), "b": ("b", 1)}


def test_validation_and_status():
    for bad in ((), (None,), (stage("a", print), stage("a", print))):
        with pytest.raises(ValueError):
            Pipeline("p", bad)
    with pytest.raises(ValueError):
        Pipeline("", (stage("a", print),))
    assert Status.TIMEOUT.is_failure and Status.SKIPPED.is_finished and not Status.RETRYING.is_finished and Status.FAILED.can_retry
    r = Registry()
    r.register("x", dict)
    assert r.create("x", a=1) == {"a": 1}
    with pytest.raises(ValueError):
        r.register("x", dict)
    with pytest.raises(KeyError):
        r.create("y")
    c = Context()
    c.write("storage", uri="u")
    assert c.get("storage.uri") == "u" and c.get("none") is None
    with pytest.raises(KeyError):
        c.require("none")
