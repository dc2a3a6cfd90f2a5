"""A claim waits with one timer, whatever is due, and tells each step once, however its pages fall into batches."""

import random

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from lossgrid.streaming import clocks

HOUR = clocks.HOUR_MS


class Handle:
    """What a processor gets of Spark: a value and timers of one key."""

    def __init__(self):
        self.timers, self.value, self.most = set(), None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def registerTimer(self, t):
        self.timers.add(t)
        self.most = max(self.most, len(self.timers))

    def deleteTimer(self, t):
        self.timers.discard(t)


def test_one_timer_tells_all_steps_once():
    draw = random.Random(4)
    for _ in range(400):
        handle, claim = Handle(), clocks.Clocks(3)
        claim.init(handle)
        late, mark, seen, told = draw.choice([0, HOUR, 10 * HOUR]), -1, [], []
        left = sorted(draw.randrange(1, 90) * HOUR // 2 for _ in range(draw.randint(1, 9)))
        while True:
            # pages come in any order, none later than the lateness allowed
            size = draw.randint(0, 3) if left else 0
            batch, left, ended = left[:size], left[size:], not left
            if batch := [t for t in batch if t > mark]:
                draw.shuffle(batch)
                list(claim.handleInputRows((1,), iter([Row(claim_id=1, at=None, at_ms=t) for t in batch]), TimerValues(-1, mark)))
            rung = 0
            for t in sorted(t for t in handle.timers if t < mark):
                told += [(r["step"], r["at_ms"]) for r in claim.handleExpiredTimer((1,), TimerValues(-1, mark), ExpiredTimerInfo(t))]
                handle.timers.discard(t)
                rung += 1
            assert rung <= 1 and len(handle.timers) <= 1
            seen += batch
            if ended:
                break
            mark = max([mark, *(t - late for t in seen)]) if left else 10**12
        assert sorted(told) == sorted(clocks.due(sorted(seen)[:3], 3).items())


def test_the_timer_is_that_of_the_first_step():
    handle, claim = Handle(), clocks.Clocks()
    claim.init(handle)
    list(claim.handleInputRows((1,), iter([Row(claim_id=1, at=None, at_ms=h * HOUR) for h in range(8)]), TimerValues(-1, -1)))
    assert handle.timers == {4 * HOUR}
