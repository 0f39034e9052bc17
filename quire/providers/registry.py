"""Named providers: encoders, completions, rerankers, index backends."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points
from typing import Any

from quire.errors import ProviderError

KINDS = ("encoder", "index", "reranker", "llm", "generator")
_FACTORIES: dict[tuple[str, str], Callable[..., Any]] = {}


def register(kind: str, name: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    """Decorator that files a provider class or factory under (kind, name)."""
    if kind not in KINDS:
        raise ProviderError(f"unknown provider kind {kind!r}")

    def file(factory: Callable[..., Any]) -> Callable[..., Any]:
        _FACTORIES[kind, name] = factory
        return factory

    return file


def _installed(kind: str) -> dict[str, Any]:
    return {e.name: e for e in entry_points(group=f"quire.{kind}")}


def get(kind: str, name: str) -> Callable[..., Any]:
    """Factory for a provider; installed plug-ins load on first use."""
    if (kind, name) not in _FACTORIES:
        plug = _installed(kind).get(name)
        if plug is None:
            raise ProviderError(f"no {kind} provider named {name!r}; have {', '.join(names(kind)) or 'none'}")
        try:
            _FACTORIES[kind, name] = plug.load()
        except Exception as e:
            raise ProviderError(f"{kind} provider {name!r} cannot be loaded: {e}") from e
    return _FACTORIES[kind, name]


def names(kind: str) -> list[str]:
    return sorted({n for k, n in _FACTORIES if k == kind} | set(_installed(kind)))
