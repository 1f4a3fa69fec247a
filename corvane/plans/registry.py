"""Named components (chunkers, embedders, stores, ...), the interfaces they keep, and retry for calls to services."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

from corvane.functions.embedding import hash_embedder
from corvane.operators import chunking


class Chunker(Protocol):
    def __call__(self, text: str) -> Iterator[tuple[str, int, int]]: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> Any: ...


class Registry:
    """Factories by kind and name. A name is given once; clearing everything brings the defaults back, clearing a kind doesn't."""

    def __init__(self):
        self._made: dict[str, dict[str, Callable]] = {}
        self._defaults()

    def _defaults(self) -> None:
        for kind, name, make in (("chunker", "fixed", chunking.FixedLength), ("chunker", "window", chunking.CharWindow), ("chunker", "semantic", chunking.Semantic), ("embedder", "hash", hash_embedder)):
            self.register(kind, name, make)

    def register(self, kind: str, name: str, make: Callable) -> None:
        if name in self._made.setdefault(kind, {}):
            raise ValueError(f"{kind} {name} is already registered")
        if not callable(make):
            raise TypeError(f"{kind} {name} can't be made")
        self._made[kind][name] = make

    def create(self, kind: str, name: str, **options: Any) -> Any:
        if name not in self._made.get(kind, {}):
            raise ValueError(f"no {kind} named {name}; there are {', '.join(self.names(kind))}")
        return self._made[kind][name](**options)

    def names(self, kind: str) -> list[str]:
        return sorted(self._made.get(kind, {}))

    def info(self) -> dict[str, list[str]]:
        return {k: self.names(k) for k in sorted(self._made)}

    def clear(self, kind: str | None = None) -> None:
        if kind:
            self._made.pop(kind, None)
        else:
            self._made.clear()
            self._defaults()


def retried(call: Callable, *, retries: int = 3, first: float = 1.0, most: float = 64.0, jitter: float = 0.25, errors: tuple = (Exception,), sleep: Callable = time.sleep) -> Any:
    """call(), tried again after waits that double, with jitter, up to a limit. For services called from tasks; Spark's own retry covers the rest."""
    for k in range(retries + 1):
        try:
            return call()
        except errors:
            if k == retries:
                raise
            sleep(min(most, first * 2**k) * (1 + random.uniform(-jitter, jitter)))


#: Status of an error by its class (fixed values); other errors are 500.
STATUS = {"ValueError": 400, "PermissionError": 403, "LookupError": 404, "KeyError": 404, "TimeoutError": 504, "ConnectionError": 503}


def status_of(error: BaseException) -> int:
    return next((STATUS[c.__name__] for c in type(error).__mro__ if c.__name__ in STATUS), 500)
