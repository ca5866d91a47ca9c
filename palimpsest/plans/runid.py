"""Numeric load ids: 43 bits of milliseconds since 2026, 8 bits of node, 12 bits of sequence; increasing within a process."""

from __future__ import annotations

import threading
import time

EPOCH_MS = 1_767_225_600_000  # 2026-01-01T00:00:00Z


class RunIds:
    def __init__(self, node: int = 0, clock=time.time):
        if not 0 <= node < 256:
            raise ValueError("a node is 0 to 255")
        self.node, self.clock, self.lock, self.last = node, clock, threading.Lock(), -1

    def next(self) -> int:
        with self.lock:
            tick = max(0, int(self.clock() * 1000) - EPOCH_MS) << 12
            # A full or late clock goes on from the last one: sequence overflows into milliseconds.
            self.last = max(self.last + 1, tick)
            return ((self.last >> 12) << 20 | self.node << 12 | (self.last & 0xFFF)) & ((1 << 63) - 1)


def parts(run_id: int) -> tuple[int, int, int]:
    """(milliseconds since 1970, node, sequence)."""
    return (run_id >> 20) + EPOCH_MS, run_id >> 12 & 0xFF, run_id & 0xFFF
