"""Stages, pipelines and what they share."""

from __future__ import annotations

import asyncio
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from enum import Enum
from typing import Any


class Status(Enum):
    PENDING = "PENDING"
    RUNNING = "RUNNING"
    COMPLETED = "COMPLETED"
    FAILED = "FAILED"
    CANCELLED = "CANCELLED"
    SKIPPED = "SKIPPED"
    TIMEOUT = "TIMEOUT"
    RETRYING = "RETRYING"

    @property
    def is_finished(self) -> bool:
        return self not in (Status.PENDING, Status.RUNNING, Status.RETRYING)

    @property
    def is_success(self) -> bool:
        return self is Status.COMPLETED

    @property
    def is_failure(self) -> bool:
        return self in (Status.FAILED, Status.TIMEOUT)

    can_retry = is_failure


class Context:
    """What the stages of one run share: values by key, and named providers."""

    def __init__(self, values: Mapping[str, Any] | None = None, providers: Mapping[str, Any] | None = None) -> None:
        self.values: dict[str, Any] = dict(values or {})
        self.providers: dict[str, Any] = dict(providers or {})

    def put(self, key: str | Enum, value: Any) -> None:
        self.values[_name(key)] = value

    def get(self, key: str | Enum, default: Any = None) -> Any:
        return self.values.get(_name(key), default)

    def require(self, key: str | Enum) -> Any:
        if _name(key) not in self.values:
            raise KeyError(f"nothing was stored under {_name(key)!r}")
        return self.values[_name(key)]

    def write(self, area: str, **found: Any) -> None:
        """Store several results of one area (``storage``, ``catalog`` ...) as ``area.name``."""
        for name, value in found.items():
            self.values[f"{area}.{name}"] = value


def _name(key: str | Enum) -> str:
    return str(key.value) if isinstance(key, Enum) else key


@dataclass(frozen=True)
class StageResult:
    stage_id: str
    status: Status
    message: str = ""
    values: Mapping[str, Any] = field(default_factory=dict)

    @property
    def succeeded(self) -> bool:
        return self.status.is_success


class Stage(ABC):
    """A step; ``max_attempts`` bounds how often it is tried when it raises."""

    def __init__(self, stage_id: str, max_attempts: int = 3) -> None:
        self.id, self.max_attempts = stage_id, max_attempts

    @abstractmethod
    async def execute(self, context: Context) -> StageResult: ...

    def completed(self, message: str = "", **values: Any) -> StageResult:
        return StageResult(self.id, Status.COMPLETED, message, values)

    def failed(self, message: str, **values: Any) -> StageResult:
        return StageResult(self.id, Status.FAILED, message, values)


class _Function(Stage):
    def __init__(self, stage_id: str, body: Callable[[Context], Any], max_attempts: int) -> None:
        super().__init__(stage_id, max_attempts)
        self.body = body

    async def execute(self, context: Context) -> StageResult:
        found = await asyncio.to_thread(self.body, context)
        return found if isinstance(found, StageResult) else self.completed(value=found)


def stage(stage_id: str, body: Callable[[Context], Any], max_attempts: int = 3) -> Stage:
    """A stage from a plain function, run in a thread."""
    return _Function(stage_id, body, max_attempts)


@dataclass(frozen=True)
class Pipeline:
    """Steps in order; a tuple of stages is a group that runs side by side."""

    name: str
    steps: tuple[Stage | tuple[Stage, ...], ...]
    id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        if not self.id or not self.name:
            raise ValueError("a pipeline needs an id and a name")
        stages = [s for group in self.groups for s in group]
        if not stages:
            raise ValueError("a pipeline needs at least one stage")
        if any(s is None for s in stages):
            raise ValueError("a pipeline cannot hold an empty stage")
        ids = [s.id for s in stages]
        repeated = sorted({i for i in ids if ids.count(i) > 1})
        if repeated:
            raise ValueError(f"repeated stage ids: {', '.join(repeated)}")

    @property
    def groups(self) -> tuple[tuple[Stage, ...], ...]:
        return tuple(s if isinstance(s, tuple) else (s,) for s in self.steps)

    def __iter__(self) -> Iterator[Stage]:
        return (s for group in self.groups for s in group)

    def __len__(self) -> int:
        return sum(map(len, self.groups))


class PipelineBuilder:
    """``PipelineBuilder().named("x").add_stage(a).add_group(b, c).build()``"""

    def __init__(self) -> None:
        self._name, self._steps = "", []

    def named(self, name: str) -> PipelineBuilder:
        self._name = name
        return self

    def add_stage(self, step: Stage) -> PipelineBuilder:
        self._steps.append(step)
        return self

    def add_stages(self, *steps: Stage) -> PipelineBuilder:
        self._steps += steps
        return self

    def add_group(self, *steps: Stage) -> PipelineBuilder:
        self._steps.append(tuple(steps))
        return self

    def build(self) -> Pipeline:
        return Pipeline(self._name, tuple(self._steps))


class Registry:
    """Builders of providers by name."""

    def __init__(self) -> None:
        self._builders: dict[str, Callable[..., Any]] = {}

    def register(self, name: str, builder: Callable[..., Any], replace: bool = False) -> None:
        if name in self._builders and not replace:
            raise ValueError(f"provider {name!r} is already registered")
        self._builders[name] = builder

    def create(self, name: str, *args: Any, **kwargs: Any) -> Any:
        if name not in self._builders:
            raise KeyError(f"no provider {name!r}; known: {', '.join(sorted(self._builders)) or 'none'}")
        return self._builders[name](*args, **kwargs)

    def names(self) -> list[str]:
        return sorted(self._builders)
