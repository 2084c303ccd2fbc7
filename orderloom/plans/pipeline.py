"""The finite pipeline: quality, aggregates, versioned table, reconciliation, publication; a failure stops the rest."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..contracts import EmptyInput, not_empty
from ..operators import metrics, quality
from ..settings import Settings
from ..sources.files import table
from ..sources.versions import VersionedTable
from . import serving


@dataclass
class Stage:
    name: str
    run: Callable[[], dict]
    status: str = "waiting"
    seconds: float = 0.0
    evidence: dict = field(default_factory=dict)
    error: str | None = None


class PipelineFailed(RuntimeError):
    def __init__(self, stages: list[Stage]):
        failed = next(s for s in stages if s.status == "failed")
        super().__init__(f"{failed.name}: {failed.error}")
        self.stages = stages


def run_stages(stages: list[Stage]) -> list[Stage]:
    """In order; after a failure the rest is skipped and PipelineFailed carries the statuses."""
    broken: Exception | None = None
    for stage in stages:
        if broken:
            stage.status = "skipped"
            continue
        began = time.monotonic()
        try:
            stage.evidence = stage.run()
            stage.status = "done"
        except Exception as e:  # noqa: BLE001  any failure stops the pipeline
            stage.status, stage.error, broken = "failed", f"{type(e).__name__}: {e}", e
        stage.seconds = time.monotonic() - began
    if broken:
        raise PipelineFailed(stages) from broken
    return stages


def write_daily(trusted: DataFrame, path: str) -> None:
    """Replaces all days; those without sales any more disappear."""
    days = metrics.daily(trusted).repartition(int(trusted.sparkSession.conf.get("spark.sql.shuffle.partitions")), "eventDate")  # a file a day, opened by all tasks
    days.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("eventDate").parquet(path)


def write_summary(trusted: DataFrame, path: str) -> None:
    metrics.summary(trusted).coalesce(1).write.mode("overwrite").parquet(path)


def finite(spark: SparkSession, settings: Settings) -> list[Stage]:
    """The five stages over the trusted layer."""
    orders = lambda: table(spark, settings.trusted)

    def check() -> dict:
        return quality.gate(not_empty(orders(), "the trusted layer"))

    def aggregate() -> dict:
        df = not_empty(orders(), "the trusted layer")
        write_daily(df, settings.daily)
        write_summary(df, settings.summary)
        return {"days": table(spark, settings.daily).select("eventDate").distinct().count()}

    def version() -> dict:
        store = VersionedTable(spark, settings.versioned)
        snapshot = store.create_or_replace(not_empty(orders(), "the trusted layer"))
        return {"snapshot": snapshot.snapshot_id, "rows": store.compare()}

    def reconcile() -> dict:
        summary = not_empty(table(spark, settings.summary), "the summary")
        return quality.reconciliation(orders(), VersionedTable(spark, settings.versioned).read(), summary)

    def publish() -> dict:
        models = serving.summary_model(table(spark, settings.summary)), serving.daily_model(table(spark, settings.daily))
        if settings.jdbc_url:
            done = serving.publish_jdbc(*models, settings.jdbc_url, settings.summary_table, settings.daily_table, settings.jdbc_properties)
        else:
            done = serving.publish_files(*models, settings.serving)
        return {"summary": done.summary_rows, "daily": done.daily_rows}

    return [Stage("quality", check), Stage("aggregates", aggregate), Stage("table", version), Stage("reconciliation", reconcile), Stage("publication", publish)]


def run(spark: SparkSession, settings: Settings) -> list[Stage]:
    return run_stages(finite(spark, settings))


__all__ = ["EmptyInput", "PipelineFailed", "Stage", "finite", "run", "run_stages", "write_daily", "write_summary"]
