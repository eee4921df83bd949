"""A bounded memo that keeps what was used lately."""

from __future__ import annotations


class Memo(dict):
    """memo[key] computes a missing value; when full, entries unused since the last time go."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.half, self.old = compute, most // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
