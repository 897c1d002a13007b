import numpy as np
import pytest

from epsforest.functions.schedule import Pass, Schedule, grid, minimum_size, threshold


def test_float32_grid():
    g = grid(1, 10, 0.1)
    assert len(g) == 90 and abs(g[-1] - 9.900002) < 1e-6
    real = [int((1 + 0.1 * k) ** 2 * 3) for k in range(90)]
    assert sum(threshold(d, 3) != t for d, t in zip(g, real, strict=True)) == 7


def test_threshold_and_minimum():
    assert threshold(10, 2) == 200 and threshold(1.5, 2) == 4
    assert minimum_size(1500, 0.5) == 7 and minimum_size(10, 0.001) == 2 and minimum_size(10, count=1) == 2


def run(schedule, figures, events=1000):
    for k, (raw, kept, assigned) in enumerate(figures):
        if schedule.done(Pass(k, float(schedule.dist), 0, raw, kept, assigned, events)):
            return k
    raise AssertionError("never stopped")


def test_stops():
    assert run(Schedule(1, 3, 1), [(5, 1, 10), (5, 2, 20), (5, 3, 30)]) == 2  # lands on the last distance
    assert run(Schedule(1, 30, 1), [(5, 1, 10), (5, 2, 960)]) == 1  # enough assigned
    assert run(Schedule(1, 30, 1), [(5, 3, 10), (5, 2, 20)]) == 1  # fewer retained
    s = Schedule(1, 30, 1, go_on_decrease=True)
    assert run(s, [(5, 3, 10), (5, 2, 20), (1, 1, 30)]) == 2 and s.reason == "enough assigned"
    assert run(Schedule(5, 1, 1), [(5, 3, 10), (5, 0, 0)]) == 1  # descending, none retained


def test_steps_double_and_skip():
    s = Schedule(1, 100, 1, stop_percent=99.9)
    for k in range(2):
        s.done(Pass(k, float(s.dist), 0, 3, 1, 600, 1000))
    assert s.step == 2 and s.dist == np.float32(4)
    s = Schedule(1, 100, 1)
    for k in range(2):
        s.done(Pass(k, float(s.dist), 0, 0, 0, 0, 1000))
    assert s.dist == np.float32(4)  # one extra step after two empty passes


def test_best_and_leftover():
    s = Schedule(1, 3, 1, go_on_decrease=True)
    run(s, [(5, 2, 10), (5, 2, 20), (5, 1, 30)])
    assert s.best.index == 1
    assert s.leftover_threshold(2) == threshold(4, 2)
    with pytest.raises(ValueError):
        Schedule(1, 3, 0)
