"""Fair queues of a run's requests: a fixed priority of roles that cannot starve the oldest request."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Roles by priority, and how often the oldest request may be passed over.
ROLES, MOST_BYPASSED = ("elements", "relation", "preliminary", "extract"), 8
OUT = "run long, seq long, verdict string, ticket long, role string, bypassed long"
STATE = "served long, queues string"


class FairQueue:
    """Requests in one queue for each role. A request has been passed over as often as others were served since it came, so
    only the number served is kept with it."""

    def __init__(self, roles: Sequence[str], most_bypassed: int, served: int = 0, queues: str = ""):
        self.most, self.served = most_bypassed, served
        known = json.loads(queues) if queues else {}
        self.queues = {r: deque(map(tuple, known.get(r, ()))) for r in roles}

    def plain(self) -> tuple[int, str]:
        return self.served, json.dumps({r: list(q) for r, q in self.queues.items() if q})

    def add(self, role: str, at: int, seq: int, ticket: int) -> bool:
        if role not in self.queues:
            return False
        self.queues[role].append((at, seq, ticket, self.served))
        return True

    def take(self) -> tuple[int, str, int] | None:
        """(ticket, role, how often it was passed over) of the next request: the first of the first role that waits, unless
        the oldest of all first ones has been passed over too often."""
        waiting = [(r, q[0]) for r, q in self.queues.items() if q]
        if not waiting:
            return None
        role, head = min(waiting, key=lambda x: x[1][:2])
        if self.served - head[3] < self.most:
            role, head = waiting[0]
        self.queues[role].popleft()
        self.served += 1
        return head[2], role, self.served - 1 - head[3]


def queue_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, roles: Sequence[str] = ROLES, most_bypassed: int = MOST_BYPASSED) -> Iterator[pd.DataFrame]:
    """One run's events by time and seq: `enqueue` of a role's ticket, or `dequeue` by a free slot. A trigger's events of one
    run are ordered as a whole. Verdicts: queued, unknown_role, served, or idle where nothing waits."""
    queue = FairQueue(roles, most_bypassed, *(state.get if state.exists else ()))
    every = pd.concat(list(batches)).sort_values(["at", "seq"])
    rows: list[tuple] = []
    for at, seq, action, role, ticket in zip(*(every[c].tolist() for c in ("at", "seq", "action", "role", "ticket")), strict=True):
        if action == "enqueue":
            rows.append((key[0], seq, "queued" if queue.add(role, at, seq, ticket) else "unknown_role", ticket, role, None))
        else:
            found = queue.take()
            rows.append((key[0], seq, "served", *found) if found else (key[0], seq, "idle", None, None, None))
    state.update(queue.plain())
    yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")]).astype({"ticket": "Int64", "bypassed": "Int64"})


def served(events: DataFrame) -> DataFrame:
    """events (streaming): run, at, seq, action, role, ticket -> a verdict for each. State is kept per run, in the store of
    the stream's checkpoint, so a restarted stream goes on with the same queues."""
    return events.groupBy("run").applyInPandasWithState(queue_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


class Replay:
    """State of a batch replay: the streaming step runs over all of a run's events at once."""

    def __init__(self) -> None:
        self.exists, self.get = False, ()

    def update(self, value: tuple) -> None:
        self.exists, self.get = True, value


def replayed(events: DataFrame) -> DataFrame:
    """The same verdicts over a table of events."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return next(queue_step(key, iter([pdf]), Replay()))

    return events.groupBy("run").applyInPandas(fold, OUT)
