"""Tools and their runs: a frozen registry, availability, and runs that end in a result or a coded error."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

ID, VERSION = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*"), re.compile(r"\d+\.\d+\.\d+(?:-[\w.]+)?")
Operator = Callable[..., DataFrame]


class ToolError(Exception):
    """code: UNKNOWN_TOOL, UNAVAILABLE, INVALID_INPUT, NO_EXECUTOR, CANCELLED, TIMEOUT or FAILED."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Tool:
    id: str
    version: str
    surfaces: tuple[str, ...]
    capabilities: tuple[str, ...] = ()
    accepts: tuple[str, ...] = ()
    produces: tuple[str, ...] = ()
    executor: Operator | None = None
    validate: Callable[[dict[str, Any]], str | None] | None = None


@dataclass
class Metric:
    tool_id: str
    outcome: str
    duration_ms: float
    error_code: str | None = None


class Registry:
    def __init__(self, tools: Iterable[Tool] = ()):
        self._tools: dict[str, Tool] = {}
        for tool in tools:
            self.register(tool)

    def register(self, tool: Tool) -> None:
        if not ID.fullmatch(tool.id):
            raise ValueError(f"{tool.id!r} isn't kebab-case")
        if not VERSION.fullmatch(tool.version):
            raise ValueError(f"{tool.version!r} isn't a version")
        if tool.id in self._tools:
            raise ValueError(f"{tool.id} is registered already")
        if not tool.surfaces:
            raise ValueError(f"{tool.id} appears nowhere")
        self._tools[tool.id] = tool

    def __getitem__(self, tool_id: str) -> Tool:
        if tool_id not in self._tools:
            raise ToolError("UNKNOWN_TOOL", tool_id)
        return self._tools[tool_id]

    def listed(self, surface: str | None = None) -> list[Tool]:
        return [t for t in self._tools.values() if surface is None or surface in t.surfaces]

    def frame(self, spark: SparkSession) -> DataFrame:
        """id, version, surfaces, capabilities: for the relational predicates."""
        return spark.createDataFrame([(t.id, t.version, list(t.surfaces), list(t.capabilities)) for t in self._tools.values()], "id string, version string, surfaces array<string>, capabilities array<string>")


@dataclass
class Runner:
    """Runs tools; every run leaves a metric, and a metric's sink never changes a result."""

    registry: Registry
    capabilities: frozenset[str] = frozenset()
    metrics: list[Metric] = field(default_factory=list)
    sink: Callable[[Metric], None] | None = None
    cancelled: Callable[[], bool] = lambda: False

    def missing(self, tool_id: str) -> list[str]:
        return [c for c in self.registry[tool_id].capabilities if c not in self.capabilities]

    def run(self, tool_id: str, *inputs: DataFrame, **parameters: Any) -> DataFrame:
        started, code = time.monotonic(), None
        try:
            return self._checked(tool_id, inputs, parameters)
        except ToolError as error:
            code = error.code
            raise
        except Exception as error:
            code = "FAILED"
            raise ToolError(code, str(error)) from error
        finally:
            metric = Metric(tool_id, "succeeded" if code is None else "cancelled" if code == "CANCELLED" else "failed", (time.monotonic() - started) * 1000, code)
            self.metrics.append(metric)
            if self.sink:
                try:
                    self.sink(metric)
                except Exception:  # noqa: BLE001, S110
                    pass

    def _checked(self, tool_id: str, inputs: tuple[DataFrame, ...], parameters: dict[str, Any]) -> DataFrame:
        tool = self.registry[tool_id]
        if absent := self.missing(tool_id):
            raise ToolError("UNAVAILABLE", ", ".join(absent))
        if tool.validate and (problem := tool.validate(parameters)):
            raise ToolError("INVALID_INPUT", problem)
        if self.cancelled():
            raise ToolError("CANCELLED", tool_id)
        if tool.executor is None:
            raise ToolError("NO_EXECUTOR", tool_id)
        return tool.executor(*inputs, **parameters)

    def collect(self, frame: DataFrame, timeout: float) -> list:
        """The rows of a result; its Spark jobs are interrupted once the time is over."""
        import threading

        spark, tag, late = frame.sparkSession, f"run-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            spark.interruptTag(tag)

        timer = threading.Timer(timeout, stop)
        spark.addTag(tag)
        timer.start()
        try:
            return frame.collect()
        except Exception as error:
            if late.is_set():
                raise ToolError("TIMEOUT", f"{timeout} s") from error
            raise
        finally:
            timer.cancel()
            spark.removeTag(tag)
