"""Registries of named extensions: a name is taken once, a miss lists what there is."""

from __future__ import annotations

from typing import Generic, TypeVar

T = TypeVar("T")


class Registry(Generic[T]):
    def __init__(self, kind: str):
        self.kind, self._items = kind, {}

    def register(self, name: str):
        def put(item: T) -> T:
            if name in self._items:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self._items[name] = item
            return item

        return put

    def __getitem__(self, name: str) -> T:
        if name not in self._items:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {self.names()}")
        return self._items[name]

    def __contains__(self, name: str) -> bool:
        return name in self._items

    def names(self) -> list[str]:
        return sorted(self._items)
