"""A bounded cache of driver-side values, such as persisted DataFrames, that drops what was used longest ago."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable


class LruCache:
    """At most ``capacity`` values; ``dropped`` is called with each value that leaves without being asked for."""

    def __init__(self, capacity: int, dropped: Callable | None = None):
        if capacity < 1:
            raise ValueError("a cache holds one value or more")
        self.capacity, self.dropped, self._held = capacity, dropped, OrderedDict()
        self.hits = self.misses = 0

    def get(self, key, default=None):
        if key not in self._held:
            self.misses += 1
            return default
        self.hits += 1
        self._held.move_to_end(key)
        return self._held[key]

    def put(self, key, value):
        """Keep a value as the newest; returns the one that it replaces or pushes out, if any."""
        old = self._held.pop(key, None)
        self._held[key] = value
        if len(self._held) > self.capacity:
            _, old = self._held.popitem(last=False)
            if self.dropped is not None:
                self.dropped(old)
        return old

    def remove(self, key):
        return self._held.pop(key, None)

    def __len__(self) -> int:
        return len(self._held)

    def stats(self) -> tuple[int, int]:
        return self.hits, self.misses

    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0


def frames(capacity: int = 16) -> LruCache:
    """A cache of persisted DataFrames: one that leaves is unpersisted."""
    return LruCache(capacity, lambda df: df.unpersist())
