"""Named collections of operators, and typed parameters that check what they are given."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any


class Registry:
    """Operators by name. Names are unique; unknown ones raise KeyError."""

    def __init__(self, name: str):
        self.name, self._items = name, {}

    def register(self, name: str | None = None) -> Callable:
        def add(item: Any) -> Any:
            key = name or item.__name__
            if key in self._items or hasattr(Registry, key):
                raise ValueError(f"{key} is taken in {self.name}")
            self._items[key] = item
            return item

        return add

    def __getitem__(self, name: str) -> Any:
        if name not in self._items:
            raise KeyError(f"{self.name} has no {name}; it has {', '.join(sorted(self._items)) or 'nothing'}")
        return self._items[name]

    def get(self, name: str, default: Any = None) -> Any:
        return self._items.get(name, default)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(str(e)) from None

    def __contains__(self, name: str) -> bool:
        return name in self._items

    def __iter__(self) -> Iterator[str]:
        return iter(self._items)

    def __len__(self) -> int:
        return len(self._items)

    def items(self) -> list[tuple[str, Any]]:
        return list(self._items.items())


class Param:
    """A checked value: a scalar type, or a list, tuple or dict whose members have one."""

    def __init__(self, kind: type, default: Any = None, container: type | None = None):
        self.kind, self.container = kind, container
        self._value = None if default is None else self.checked(default)

    def checked(self, value: Any) -> Any:
        if self.container is None:
            if not isinstance(value, self.kind):
                raise TypeError(f"{self.kind.__name__} wanted, {type(value).__name__} given")
            return value
        if not isinstance(value, self.container):
            raise TypeError(f"{self.container.__name__} wanted, {type(value).__name__} given")
        for member in value.values() if isinstance(value, dict) else value:
            if not isinstance(member, self.kind):
                raise TypeError(f"members of {self.kind.__name__} wanted, {type(member).__name__} given")
        return value

    def get(self) -> Any:
        return self._value

    def set(self, value: Any) -> None:
        self._value = self.checked(value)


PARAMS = Registry("params")
for _name, _kind in (("Int", int), ("Float", float), ("Str", str), ("Bool", bool)):
    PARAMS.register(f"{_name}Param")(lambda default=None, k=_kind: Param(k, default))
    PARAMS.register(f"{_name}ListParam")(lambda default=None, k=_kind: Param(k, default, list))
    PARAMS.register(f"{_name}TupleParam")(lambda default=None, k=_kind: Param(k, default, tuple))
for _name, _container in (("List", list), ("Tuple", tuple), ("Dict", dict)):
    PARAMS.register(f"{_name}Param")(lambda kind, default=None, c=_container: Param(kind, default, c))
