"""Roles and progress of the members of a replica set: bookkeeping, without a network."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import QueryParseError

ROLES = ("primary", "secondary", "arbiter")


@dataclass
class Member:
    id: str
    host: str
    port: int = 6380
    role: str = "secondary"
    last_heartbeat: int | None = None
    oplog_ts: int = 0
    healthy: bool = True


@dataclass
class ReplicaSet:
    name: str
    local_id: str
    members: dict[str, Member] = field(default_factory=dict)

    def add(self, member: Member) -> None:
        if member.role not in ROLES:
            raise QueryParseError(f"no role {member.role}")
        self.members[member.id] = member

    def remove(self, member_id: str) -> None:
        self.members.pop(member_id, None)

    def primary(self) -> Member | None:
        return next((m for m in self.members.values() if m.role == "primary"), None)

    def secondaries(self) -> list[Member]:
        return [m for m in self.members.values() if m.role == "secondary"]

    def is_primary(self) -> bool:
        return self.local_id in self.members and self.members[self.local_id].role == "primary"

    def heartbeat(self, member_id: str, oplog_ts: int) -> None:
        """A sign of life of a member that has applied the log up to ``oplog_ts``; of a stranger, nothing."""
        if (m := self.members.get(member_id)) is not None:
            m.last_heartbeat, m.oplog_ts, m.healthy = int(time.time()), oplog_ts, True

    def status(self, spark: SparkSession) -> DataFrame:
        """(set, id, host, role, healthy, oplog_ts, lag) of each member; lag counts log entries behind the most advanced."""
        top = max((m.oplog_ts for m in self.members.values()), default=0)
        rows = [(self.name, m.id, f"{m.host}:{m.port}", m.role, m.healthy, m.oplog_ts, top - m.oplog_ts) for m in self.members.values()]
        return spark.createDataFrame(rows, "set string, id string, host string, role string, healthy boolean, oplog_ts bigint, lag bigint")
