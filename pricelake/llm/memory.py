"""What a Python worker remembers between batches: one operator's words at a time.

Workers live on after a task and serve the next operator; without this, each
would keep the words of every operator that it ever ran.
"""

from __future__ import annotations

from typing import Protocol


class Memory(Protocol):
    def forget(self) -> None: ...


_used: list[Memory] = []


def use(memory: Memory) -> None:
    """From now on this memory is the worker's only one; what another one holds goes."""
    if not _used or _used[0] is not memory:
        for x in _used:
            x.forget()
        _used[:] = [memory]
