"""The schedule of a scan: thresholds from float32 distances, the minimum size, and the stop and step rules."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np

f32 = np.float32


def threshold(dist: float, columns: int) -> int:
    """The largest squared distance at ``dist``, a root mean square per column: truncated float32 arithmetic."""
    d = f32(dist)
    return int(f32(f32(d * d) * f32(columns)))


def minimum_size(events: int, percent: float = 0.5, count: int | None = None) -> int:
    """Events a cluster needs: given, or a percentage of all; never below 2."""
    m = count if count is not None else int(float(f32(events)) / 100.0 * float(f32(percent)))
    return max(m, 2)


def grid(first: float, last: float | None, step: float) -> list[float]:
    """The distances of a scan that neither doubles its step nor stops early; float32 sums."""
    out, d = [f32(first)], f32(first)
    last = f32(first if last is None else last)
    step = f32(step)
    if step <= 0:
        raise ValueError("step must be positive")
    while d != last and len(out) < 1_000_000:
        d = f32(d + step) if last > f32(first) else f32(d - step)
        if (d > last) if last > f32(first) else (d < last):
            break
        out.append(d)
    return [float(x) for x in out]


@dataclass
class Pass:
    """The figures of one pass, as they are reported."""

    index: int
    dist: float
    threshold: int
    raw: int
    retained: int
    assigned: int
    events: int

    @property
    def percent(self) -> np.float32:
        return f32(100.0 * self.assigned / self.events) if self.events else f32(0)


@dataclass
class Schedule:
    """Decides after each pass whether and where to go on. ``dist`` and ``step`` keep what they are after the end."""

    first: float
    last: float | None = None
    step: float = 0.5
    stop_percent: float = 95.0
    go_on_decrease: bool = False
    passes: list[Pass] = field(default_factory=list)
    reason: str = ""
    #: Seconds of each pass, and when the running one began.
    seconds: list[float] = field(default_factory=list)
    began: float = field(default_factory=time.monotonic)

    def __post_init__(self) -> None:
        self.dist = f32(self.first)
        self.last = f32(self.first if self.last is None else self.last)
        self.step = f32(self.step)
        self.down = f32(self.first) > self.last
        if self.step <= 0 and self.dist != self.last:
            raise ValueError("step must be positive")

    @property
    def best(self) -> Pass | None:
        """The pass with most retained clusters, of equal ones the later when ascending."""
        if not self.passes:
            return None
        return max(self.passes, key=lambda p: (p.retained, -p.index if self.down else p.index))

    def done(self, now: Pass) -> bool:
        """Records a pass; True if it was the last one. The rules are checked in this order."""
        before = self.passes[-1] if self.passes else None
        most = max((p.retained for p in self.passes), default=0)
        self.passes.append(now)
        at = time.monotonic()
        self.seconds.append(at - self.began)
        self.began = at
        if self.dist == self.last:
            self.reason = "last distance"
            return True
        if self.down:
            if now.retained == 0:
                self.reason = "none retained"
                return True
            self.dist = f32(self.dist - self.step)
            if self.dist < self.last:
                self.reason = "past last distance"
                return True
        else:
            if (now.raw == 1 and now.retained >= 1 and now.index > 0) or float(now.percent) >= self.stop_percent:
                self.reason = "enough assigned"
                return True
            gain = f32(now.percent - (before.percent if before else f32(0)))
            alone = now.retained == 1 and now.percent > 50 and float(gain) <= 0.1
            full = now.percent >= 99 and before is not None and now.retained == before.retained and float(gain) <= 0.1
            if alone or full:
                self.step = f32(self.step * f32(2))
            self.dist = f32(self.dist + self.step)
            if now.raw == 0 and before is not None and before.raw == 0:
                self.dist = f32(self.dist + self.step)
            if self.dist > self.last:
                self.reason = "past last distance"
                return True
        if not self.go_on_decrease and now.retained < most:
            self.reason = "fewer retained"
            return True
        return False

    def leftover_threshold(self, columns: int) -> int:
        """The cutoff for held-out events: one step past where the scan ended."""
        return threshold(f32(self.dist + self.step), columns)
