"""Job events as streams: leases with fencing, idempotent commits, rate limits and progress.

Windows with watermarks (tumbling, sliding, session) are additions of this engine; leases, heartbeats, fenced commits
and outbox delivery follow the durable job queue they re-express.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds of a lease, and attempts of a job.
LEASE_SECONDS, MOST_ATTEMPTS = 120, 3
OUT = "job long, seq long, at long, owner string, token long, verdict string"
STATE = "owner string, token long, expires long, state string, due long, attempts long"


class Lease:
    """One job: a claim takes a free or expired lease, from whoever held it, and gets a greater fencing token; while a lease
    runs nobody gets it, its owner neither. A heartbeat, commit or failure needs the running lease and its token. After a
    failure the job waits 2^attempt seconds, and is failed after MOST_ATTEMPTS."""

    __slots__ = ("owner", "token", "expires", "state", "due", "attempts")

    def __init__(self, owner: str = "", token: int = 0, expires: int = 0, state: str = "pending", due: int = 0, attempts: int = 0):
        self.owner, self.token, self.expires, self.state, self.due, self.attempts = owner, token, expires, state, due, attempts

    def plain(self) -> tuple:
        return self.owner, self.token, self.expires, self.state, self.due, self.attempts

    def take(self, at: int, owner: str, action: str, token: int) -> str:
        """The verdict on one event."""
        held = self.owner != "" and at < self.expires
        if self.state != "pending":
            return "refused_" + self.state
        if action == "claim":
            if held:
                return "refused_leased"
            if at < self.due:
                return "refused_waiting"
            self.owner, self.token, self.expires, self.attempts = owner, self.token + 1, at + LEASE_SECONDS, self.attempts + 1
            return "claimed"
        if action == "cancel":
            self.state = "cancelled"
        elif not held or owner != self.owner or token != self.token:
            return "refused_fenced"
        elif action == "heartbeat":
            self.expires = at + LEASE_SECONDS
            return "renewed"
        elif action == "fail":
            self.state = "failed" if self.attempts >= MOST_ATTEMPTS else "pending"
            self.owner, self.due = "", at + 2**self.attempts
        else:
            self.state = "committed"
        return self.state


FIELDS = ("seq", "at", "owner", "action", "token")


def lease_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One job's events in order of time. A trigger's events of one job are ordered as a whole, however many batches hold
    them; seq orders events of one second."""
    lease = Lease(*(state.get if state.exists else ()))
    every = pd.concat(list(batches)).sort_values(["at", "seq"])
    rows = []
    for seq, at, owner, action, token in zip(*(every[c].tolist() for c in FIELDS), strict=True):
        verdict = lease.take(at, owner, action, token)
        rows.append((key[0], seq, at, owner, lease.token, verdict))
    state.update(lease.plain())
    yield pd.DataFrame(rows, columns=["job", "seq", "at", "owner", "token", "verdict"])


def replayed(events: DataFrame) -> DataFrame:
    """The same verdicts over a table of events: jobs are dealt out by key and each task goes once through its rows in
    order, with the lease of the job it is at. A job of any number of events takes the memory of one batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, lease = object(), Lease()
        for pdf in batches:
            tokens, verdicts = [], []
            for job, _, at, owner, action, token in zip(*(pdf[c].tolist() for c in ("job", *FIELDS)), strict=True):
                if job != now:
                    now, lease = job, Lease()
                verdicts.append(lease.take(at, owner, action, token))
                tokens.append(lease.token)
            yield pd.DataFrame({"job": pdf["job"], "seq": pdf["seq"], "at": pdf["at"], "owner": pdf["owner"], "token": tokens, "verdict": verdicts})

    rows = events.select("job", *FIELDS).repartition("job").sortWithinPartitions("job", "at", "seq")
    return rows.mapInPandas(run, OUT)


def leases(events: DataFrame) -> DataFrame:
    """events (streaming): job, seq, at (seconds), owner, action, token -> a verdict for each. State is kept per job."""
    return events.groupBy("job").applyInPandasWithState(lease_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def once(events: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """At-least-once deliveries made idempotent: repeats of a key within the watermark are dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def rate(events: DataFrame, subject: str, time: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per subject and tumbling bucket."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width).alias("bucket"), subject).agg(F.count("*").alias("n"))


def sliding(events: DataFrame, time: str, width: str, step: str, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, width, step).alias("bucket")).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, subject: str, time: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("session"), subject).agg(F.count("*").alias("n"))


def commit_once(batch: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch sink: each batch writes its own folder, so a replayed batch overwrites itself and nothing else."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def pending(outbox: DataFrame, sent: DataFrame, now: int) -> DataFrame:
    """Outbox events that are due and not marked as sent."""
    return outbox.filter(F.col("due") <= now).join(sent.select("event_id"), "event_id", "left_anti")


def commit_with_next(batch: DataFrame, batch_id: int, path: str, next_kind: dict[str, str]) -> None:
    """foreachBatch sink for committed jobs (job, run, kind, token, payload, at): the artifact, the job that follows its kind
    and the event that tells of it are one write, so none of them is there without the others; a replayed batch writes the
    same folder again. Of several commits of a job the one of the greatest token stands."""
    last = batch.groupBy("job").agg(F.max(F.struct("token", "at", "run", "kind", "payload")).alias("c")).select("job", "c.*")
    follows = F.create_map(*[F.lit(v) for pair in next_kind.items() for v in pair])[F.col("kind")] if next_kind else F.lit(None).cast("string")
    rows = F.array(
        F.struct(F.lit("artifact").alias("record"), F.col("kind").alias("kind"), F.col("payload").alias("payload"), F.col("at").alias("due")),
        F.struct(F.lit("job").alias("record"), follows.alias("kind"), F.lit(None).cast("string").alias("payload"), F.col("at").alias("due")),
        F.struct(F.lit("event").alias("record"), F.concat(F.lit("committed:"), "kind").alias("kind"), F.col("job").cast("string").alias("payload"), F.col("at").alias("due")),
    )
    out = last.select("job", "run", "token", F.inline(F.filter(rows, lambda r: r["kind"].isNotNull())))
    out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
