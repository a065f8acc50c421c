"""A small name -> object registry (extension points for encoders, sequence
builders, losses / metrics and predictors)."""
from __future__ import annotations


class Registry:
    def __init__(self, kind: str):
        self.kind = kind
        self._items: dict = {}

    def register(self, name: str):
        def deco(obj):
            self._items[name] = obj
            return obj
        return deco

    def get(self, name: str):
        try:
            return self._items[name]
        except KeyError:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {sorted(self._items)}") from None

    def __contains__(self, name: str) -> bool:
        return name in self._items

    def names(self):
        return sorted(self._items)
