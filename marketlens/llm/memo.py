"""A bounded memory of values for words that come up again and again."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """``memo[key]`` computes a value once while it stays in memory.

    Two generations of at most ``limit`` keys each: when the young one is full it becomes the
    old one, so common keys survive and memory stays bounded. Keys above ``longest`` characters
    are computed each time.
    """

    def __init__(self, make: Callable, limit: int = 200_000, longest: int = 48):
        super().__init__()
        self._make, self._limit, self._longest, self._old = make, limit, longest, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if not isinstance(key, str) or len(key) <= self._longest:
            if len(self) >= self._limit:
                self._old = dict(self)
                self.clear()
            self[key] = value
        return value
