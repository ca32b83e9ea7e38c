"""Recipes: small graphs of tool steps, checked and ordered on the driver, compiled to chains of lazy frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import DataFrame

from .registry import Runner, ToolError


@dataclass(frozen=True)
class Step:
    """depends_on None: the step before, if any."""

    id: str
    tool_id: str
    parameters: Mapping[str, Any] = field(default_factory=dict)
    depends_on: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Parameter:
    step_id: str
    name: str
    label: str = ""
    required: bool = False
    default: Any = None


@dataclass(frozen=True)
class Recipe:
    id: str
    name: str
    steps: tuple[Step, ...]
    parameters: tuple[Parameter, ...] = ()

    def __post_init__(self):
        if not self.id.strip() or not self.name.strip():
            raise ValueError("a recipe needs an id and a name")
        if not self.steps:
            raise ValueError("a recipe needs a step")
        ids = [s.id for s in self.steps]
        if len(set(ids)) != len(ids) or not all(i.strip() and s.tool_id.strip() for i, s in zip(ids, self.steps, strict=True)):
            raise ValueError("steps need distinct ids and a tool")
        for step, needed in self.edges().items():
            if step in needed or not set(needed) <= set(ids):
                raise ValueError(f"{step} depends on itself or on an unknown step")
        asked = [(p.step_id, p.name) for p in self.parameters]
        if len(set(asked)) != len(asked) or not {s for s, _ in asked} <= set(ids):
            raise ValueError("parameters must be unique for a known step")
        self.order()

    def edges(self) -> dict[str, tuple[str, ...]]:
        """Dependencies of each step, implied ones included."""
        before: tuple[str, ...] = ()
        out = {}
        for s in self.steps:
            out[s.id] = before if s.depends_on is None else s.depends_on
            before = (s.id,)
        return out

    def order(self) -> list[Step]:
        """Repeatedly the first step whose dependencies are done."""
        edges = self.edges()
        try:
            TopologicalSorter(edges).prepare()
        except CycleError as error:
            raise ValueError("the steps form a cycle") from error
        done: list[Step] = []
        names: set[str] = set()
        while len(done) < len(self.steps):
            step = next(s for s in self.steps if s.id not in names and names.issuperset(edges[s.id]))
            done.append(step)
            names.add(step.id)
        return done

    def with_parameters(self, step_id: str, parameters: Mapping[str, Any]) -> Recipe:
        if step_id not in {s.id for s in self.steps}:
            raise ValueError(f"{step_id} isn't in the recipe")
        return replace(self, steps=tuple(replace(s, parameters=dict(parameters)) if s.id == step_id else s for s in self.steps))


def flow_steps(steps: Sequence[Step]) -> tuple[Step, ...]:
    """Steps of a flow: each may depend on earlier ones only."""
    seen: set[str] = set()
    for s in steps:
        if not set(s.depends_on or ()) <= seen or s.id in seen:
            raise ValueError(f"{s.id} must follow what it depends on")
        seen.add(s.id)
    return tuple(steps)


def recipe_from_flow(steps: Sequence[Step], recipe_id: str, name: str, parameters: Sequence[Parameter] = ()) -> Recipe:
    if not steps:
        raise ValueError("an empty flow is no recipe")
    return Recipe(recipe_id, name, flow_steps([replace(s, depends_on=s.depends_on or ()) for s in steps]), tuple(parameters))


def quick_flow(tool_id: str, **parameters: Any) -> tuple[Step, ...]:
    """One tool as a flow."""
    return (Step(tool_id, tool_id, parameters, ()),)


@dataclass
class Progress:
    status: str
    outputs: dict[str, DataFrame]
    failed_step: str | None = None
    error: ToolError | None = None


def run_recipe(recipe: Recipe, initial: DataFrame, runner: Runner, given: Mapping[str, Mapping[str, Any]] | None = None) -> Progress:
    """All tools are checked before the first runs. A step gets its dependencies' outputs in order, a root the initial
    frame; what the user gives overrides a step's parameters. The first failure ends the run and keeps earlier outputs."""
    given = given or {}
    for step in recipe.steps:
        if absent := runner.missing(step.tool_id):
            raise ToolError("UNAVAILABLE", f"{step.tool_id}: {', '.join(absent)}")
    for p in recipe.parameters:
        known = {**{s.id: s for s in recipe.steps}[p.step_id].parameters, **given.get(p.step_id, {})}
        if p.required and p.default is None and p.name not in known:
            raise ToolError("INVALID_INPUT", f"{p.step_id} needs {p.name}")
    outputs: dict[str, DataFrame] = {}
    edges = recipe.edges()
    for step in recipe.order():
        if runner.cancelled():
            return Progress("cancelled", outputs, step.id)
        inputs = [outputs[d] for d in edges[step.id]] or [initial]
        defaults = {p.name: p.default for p in recipe.parameters if p.step_id == step.id and p.default is not None}
        try:
            outputs[step.id] = runner.run(step.tool_id, *inputs, **{**defaults, **step.parameters, **given.get(step.id, {})})
        except ToolError as error:
            return Progress("cancelled" if error.code == "CANCELLED" else "failed", outputs, step.id, error)
    return Progress("succeeded", outputs)
