"""Driver-side pipelines: stages in order or side by side, with policies and hooks.

A stage's body is a lazy DataFrame plus one action; actions run in threads, so
stages of one group share the cluster.
"""

from tidemark.pipeline.core import Context, Pipeline, PipelineBuilder, Stage, StageResult, Status, stage
from tidemark.pipeline.hooks import Event, HookManager, LoggingHook, MetricsHook, TracingHook
from tidemark.pipeline.policies import Decision, FailurePolicy, Incident, PolicyManager, RetryPolicy, TimeoutPolicy
from tidemark.pipeline.runner import ExecutionResult, ParallelExecutor, SequentialExecutor

__all__ = ["Context", "Decision", "Event", "ExecutionResult", "FailurePolicy", "HookManager", "Incident", "LoggingHook", "MetricsHook", "ParallelExecutor", "Pipeline", "PipelineBuilder", "PolicyManager", "RetryPolicy", "SequentialExecutor", "Stage", "StageResult", "Status", "TimeoutPolicy", "TracingHook", "stage"]
