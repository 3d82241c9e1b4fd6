"""Names for things that can be plugged in: providers, anonymisers, attackers, sources of benchmark records, text generators."""

from __future__ import annotations

from typing import Generic, TypeVar

T = TypeVar("T")


class Registry(Generic[T]):
    """Values by name, in any case; a name is given twice only with `replace`."""

    def __init__(self, kind: str, values: dict[str, T] | None = None, aliases: dict[str, str] | None = None) -> None:
        self.kind, self._aliases = kind, aliases or {}
        self._values: dict[str, T] = dict(values or {})

    def _key(self, name: str) -> str:
        key = name.strip().lower()
        return self._aliases.get(key, key)

    def register(self, name: str, value: T, replace: bool = False) -> None:
        key = name.strip().lower()
        if not key:
            raise ValueError(f"a {self.kind} needs a name")
        if key in self._values and not replace:
            raise ValueError(f"there is a {self.kind} {name!r} already")
        self._values[key] = value

    def has(self, name: str) -> bool:
        return self._key(name) in self._values

    def names(self) -> list[str]:
        return sorted(self._values)

    def get(self, name: str) -> T:
        key = self._key(name)
        if key not in self._values:
            raise ValueError(f"no such {self.kind}: {name}")
        return self._values[key]
