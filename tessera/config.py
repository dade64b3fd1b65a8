"""Settings of an engine: where collections live, what roles apply, and Spark's own settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass
class Settings:
    data_dir: str = "tessera-data"
    require_auth: bool = False
    default_roles: list[str] = field(default_factory=lambda: ["readWrite"])
    change_buffer: int = 10_000
    oplog_mb: int = 512
    transaction_timeout_s: float = 30.0
    shards: list[str] = field(default_factory=lambda: ["shard0"])
    virtual_nodes: int = 16
    spark: dict[str, str] = field(default_factory=dict)

    @property
    def oplog_entries(self) -> int:
        """About 500 bytes an entry."""
        return self.oplog_mb * (1 << 20) // 500

    @classmethod
    def load(cls, path: str) -> Settings:
        """Settings of a JSON file; what it leaves out keeps its default, and unknown names are an error."""
        return cls(**json.loads(Path(path).read_text()))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    def builder(self, builder):
        """A SparkSession builder with these settings' Spark configuration."""
        for k, v in self.spark.items():
            builder = builder.config(k, v)
        return builder
