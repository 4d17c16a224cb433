"""Injected models: loaded once a worker process, called over rows, with every failure a row's own error."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

from panelwright.errors import ModelLoadError

#: What this process has loaded or failed to load, by key: workers are reused by the tasks that follow.
_LOADED: dict[str, Any] = {}
_FAILED: dict[str, ModelLoadError] = {}


@dataclass(frozen=True)
class Model:
    """A model by ``name`` and how to load it. Models of one ``key`` are the same one; each object has a key of its own if none is given."""

    name: str
    load: Callable[[], Any] | None
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        if self.load is None:
            raise ModelLoadError("no model has been set", self.name)

    def get(self) -> Any:
        """The model, loaded at the first call in this process. ModelLoadError if it can't be loaded; that isn't tried again."""
        if self.key in _FAILED:
            raise _FAILED[self.key]
        if self.key not in _LOADED:
            try:
                found = self.load()
                if found is None:
                    raise ModelLoadError("the loader gives no model", self.name)
                _LOADED[self.key] = found
            except Exception as problem:
                reason = problem.reason if isinstance(problem, ModelLoadError) else f"{problem}" or type(problem).__name__
                _FAILED[self.key] = ModelLoadError(reason, self.name)
                raise _FAILED[self.key] from problem
        return _LOADED[self.key]


def preload(models: Iterable[Model]) -> None:
    """Loads models in this process, in order; the first that fails is raised."""
    for model in models:
        model.get()


def loaded_models(models: Iterable[Model]) -> dict[str, bool]:
    """Name to whether the model has been loaded in this process."""
    return {m.name: m.key in _LOADED for m in models}


def each_row(call: Callable[[Sequence], Sequence], rows: Sequence) -> Iterator[tuple[Any, str | None]]:
    """The model's output of each row, or what it says of that row. A batch that fails is tried again in halves, so a bad row fails alone."""
    try:
        found = list(call(rows))
        if len(found) != len(rows):
            raise ValueError(f"{len(found)} outputs for {len(rows)} rows")
        yield from ((x, None) for x in found)
    except Exception as problem:
        if len(rows) == 1:
            yield None, f"{problem}" or type(problem).__name__
        elif len(rows):
            half = len(rows) // 2
            yield from each_row(call, rows[:half])
            yield from each_row(call, rows[half:])
