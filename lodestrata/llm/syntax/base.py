"""What the parsers share: the error that unwinds to a synchronising point, and a bounded memo."""

from __future__ import annotations

from typing import NamedTuple


class Fault(NamedTuple):
    """A syntax error: 1-based line, and what was wrong."""

    line: int
    cause: str


class Panic(Exception):
    """Raised inside a statement; caught where parsing can go on."""

    def __init__(self, at: int, cause: str) -> None:
        super().__init__(cause)
        self.at, self.cause = at, cause


class Memo(dict):
    """A dictionary emptied when full: results are the same with any memory, only the time differs."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most = most

    def keep(self, key, value):
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value
