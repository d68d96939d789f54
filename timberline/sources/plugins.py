"""Formats from elsewhere: Python functions of a line, modules and installed packages, with options and clean-up."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from importlib import import_module
from importlib.metadata import entry_points
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .parsers import FIELDS, LogFormat, Pieces, Registry, builtin_formats, record

#: What a Python parser may return beside the fields that an event has.
_FOUND = T.StructType([T.StructField("found", T.BooleanType()), *(T.StructField(f.name, T.StringType() if f.name == "attributes" else f.dataType) for f in FIELDS)])


def python_format(name: str, detect: Callable[[str], float], parse: Callable[[str], dict[str, Any] | None], priority: int = 500,
                  source_type: str = "application", **more: Any) -> LogFormat:
    """A format of two Python functions of a line, run on Arrow batches beside the built-in expressions.

    ``parse`` gives canonical fields by name (attributes as JSON text), or None. A line on which a function fails
    counts as not of the format.
    """

    @F.pandas_udf(T.DoubleType())
    def surely(lines: pd.Series) -> pd.Series:
        def one(line: str | None) -> float:
            try:
                return min(max(float(detect(line)), 0.0), 1.0) if line is not None else 0.0
            except Exception:  # noqa: BLE001  (somebody else's code)
                return 0.0

        return lines.map(one).astype("float64")

    @F.pandas_udf(_FOUND)
    def fields(lines: pd.Series) -> pd.DataFrame:
        def one(line: str | None) -> list:
            try:
                made = parse(line) if line is not None else None
            except Exception:  # noqa: BLE001
                made = None
            return [made is not None, *((made or {}).get(f.name) for f in FIELDS)]

        out = pd.DataFrame([one(x) for x in lines], columns=_FOUND.names).astype(object)
        out["found"] = out["found"].astype(bool)
        return out.where(out.notna(), None)

    def made(p: Pieces) -> Pieces:
        return {"made": fields(p["line"])}

    def event(p: Pieces) -> Pieces:
        values = {f.name: p["made"][f.name] for f in FIELDS}
        values["source_type"] = F.coalesce(values["source_type"], F.lit(source_type))
        return {"event": F.when(p["made"]["found"], record(**values))}

    return LogFormat(name, priority, source_type, lambda line: surely(line), steps=(made, event), **more)


@dataclass
class Loaded:
    """What became of a plugin: its name, the formats it added, and why it did not."""

    name: str
    formats: list[str] = field(default_factory=list)
    error: str | None = None


@dataclass
class Plugins:
    """Loads formats into a registry, and calls what they leave to be called in the end.

    A source is a ``module:attribute``, or any object: a ``LogFormat``, several of them, or a function that makes them
    and may take ``options`` by name. An object with ``close`` is closed by ``close``, last come first.

    Plugins are started together: all are made first, then tried on a copy of the registry, and what passes is
    registered in one step. ``on_error`` is ``skip``, which keeps each reason, or ``raise``: then one that fails leaves
    the registry as it was, and all that were made are closed. At most ``most`` are loaded; those beyond fail.
    A name that is taken already fails, or with ``duplicates`` as ``replace``, takes its place; that of a format that
    comes with this library only with ``replace_builtin``.
    """

    registry: Registry
    options: dict[str, dict[str, Any]] = field(default_factory=dict)
    on_error: str = "skip"
    most: int = 100
    duplicates: str = "reject"
    replace_builtin: bool = False
    loaded: list[Loaded] = field(default_factory=list)
    open: list[Any] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.on_error not in ("skip", "raise") or self.duplicates not in ("reject", "replace") or self.most < 0:
            raise ValueError("on_error is skip or raise, duplicates reject or replace, most at least 0")

    def start(self, sources: dict[str, Any]) -> list[Loaded]:
        """Loads sources by name, in the order given."""
        results, staged = [], Registry(dict(self.registry.formats), set(self.registry.disabled), self.registry.context)
        count, opened = sum(r.error is None for r in self.loaded), len(self.open)
        for name, source in sources.items():
            result, before, began = Loaded(name), dict(staged.formats), len(self.open)
            results.append(result)
            try:
                if count >= self.most:
                    raise OverflowError(f"more than {self.most} plugins")
                count += 1
                for f in self._made(name, source):
                    taken = f.name in staged.formats
                    if taken and self.duplicates == "replace" and not self.replace_builtin and staged.formats[f.name] is self._builtin(f.name):
                        raise PermissionError(f"{f.name} comes with the library")
                    staged.register(f, taken and self.duplicates == "replace")
                    result.formats.append(f.name)
            except Exception as error:  # noqa: BLE001
                staged.formats, result.formats, result.error = before, [], f"{type(error).__name__}: {error}"
                self._shut(began)
                if self.on_error == "raise":
                    self._shut(opened)
                    for r in results:
                        r.formats = []
                    self.loaded += results
                    raise
        self.registry.formats = staged.formats
        self.loaded += results
        return results

    def load(self, name: str, source: Any) -> Loaded:
        return self.start({name: source})[0]

    def load_packages(self, group: str = "timberline.formats", allowed: Iterable[str] | None = None, required: bool = False) -> list[Loaded]:
        """Everything that installed packages offer under ``group``, or what ``allowed`` names of it; with ``required``
        there must be something."""
        chosen = None if allowed is None else set(allowed)
        found = {p.name: f"{p.module}:{p.attr}" for p in sorted(entry_points(group=group), key=lambda p: p.name) if chosen is None or p.name in chosen}
        if required and not found:
            missing = Loaded(group, error="LookupError: nothing is offered")
            self.loaded.append(missing)
            if self.on_error == "raise":
                raise LookupError(f"nothing is offered under {group}")
            return [missing]
        return self.start(found)

    def _made(self, name: str, source: Any) -> list[LogFormat]:
        if isinstance(source, str):
            module, _, attribute = source.partition(":")
            source = getattr(import_module(module), attribute or "formats")
        if callable(source) and not isinstance(source, LogFormat):
            options = self.options.get(name, {})
            known = inspect.signature(source).parameters
            takes_all = any(p.kind is p.VAR_KEYWORD for p in known.values())
            if unknown := set(options) - set(known) if not takes_all else set():
                raise ValueError(f"unknown options {sorted(unknown)}")
            source = source(**options)
        if hasattr(source, "close"):
            self.open.append(source)
        found = getattr(source, "formats", source)
        found = [found] if isinstance(found, LogFormat) else list(found)
        if bad := [f for f in found if not isinstance(f, LogFormat)]:
            raise TypeError(f"not a format: {bad[0]!r}")
        return found

    def _builtin(self, name: str) -> LogFormat | None:
        return next((f for f in builtin_formats(self.registry.context) if f.name == name), None)

    def _shut(self, keep: int) -> list[str]:
        """Closes what was opened after the first ``keep``, and tells what failed to."""
        errors = []
        while len(self.open) > keep:
            try:
                self.open.pop().close()
            except Exception as error:  # noqa: BLE001
                errors.append(f"{type(error).__name__}: {error}")
        return errors

    def close(self) -> list[str]:
        """Closes what is open, and tells what failed to."""
        return self._shut(0)
