"""All settings in one frozen value that is passed explicitly; nothing reads the environment on import."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any


@dataclass(frozen=True)
class Settings:
    """Paths may be any that Spark's file systems reach."""

    root: str
    app_name: str = "orderloom"
    # source
    source_format: str = "kafka"
    kafka_servers: str = "localhost:9092"
    topic: str = "retail.orders"
    starting_offsets: str = "earliest"
    files_per_trigger: int = 10
    offsets_per_trigger: int = 1_000_000
    # time and state
    live_window: str = "1 minute"
    live_watermark: str = "2 minutes"
    dedup_watermark: str = "10 minutes"
    bounded_dedup: bool = False
    # waiting for the first raw files
    wait_seconds: float = 180.0
    poll_seconds: float = 5.0
    # versioned table
    catalog: str = "lake"
    namespace: str = "retail"
    table: str = "orders"
    # delivery
    outbox_batch: int = 50
    outbox_pause: float = 1.0
    outbox_settle: int = 20
    outbox_give_up: int = 4
    send_seconds: float = 5.0
    consumer_retries: int = 2
    consumer_pause: float = 1.0
    consumer_dead: int = 1000
    error_chars: int = 2000
    # serving
    jdbc_url: str | None = None
    jdbc_properties: dict[str, str] = field(default_factory=dict)
    summary_table: str = "sales_summary"
    daily_table: str = "sales_daily"
    page_default: int = 100
    page_most: int = 1000

    def at(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    @property
    def raw(self) -> str:
        return self.at("raw", "orders")

    @property
    def trusted(self) -> str:
        return self.at("trusted", "orders")

    @property
    def daily(self) -> str:
        return self.at("aggregates", "daily")

    @property
    def summary(self) -> str:
        return self.at("aggregates", "summary")

    @property
    def versioned(self) -> str:
        return self.at("versioned", self.namespace, self.table)

    @property
    def serving(self) -> str:
        return self.at("serving")

    def checkpoint(self, query: str) -> str:
        return self.at("checkpoints", query)

    @property
    def table_name(self) -> str:
        """The three-part name of the versioned table."""
        return f"{self.catalog}.{self.namespace}.{self.table}"

    def but(self, **changes: Any) -> Settings:
        return replace(self, **changes)
