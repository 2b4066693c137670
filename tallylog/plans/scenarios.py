"""The six standing queries on a window that ends at ``until``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallylog.operators.aggregate import aggregate, bucket_count
from tallylog.operators.filters import LogFilters
from tallylog.operators.paging import find_page, newest_page


@dataclass(frozen=True)
class Scenario:
    """A page (no bucket) or a bucket count."""

    filters: LogFilters
    limit: int = 100
    bucket: str | None = None
    group_by: str | None = None

    def run(self, logs: DataFrame, rollup: DataFrame | None = None) -> DataFrame:
        if self.bucket is None and rollup is None:
            return find_page(logs, self.filters, self.limit)
        if self.bucket is None:
            return newest_page(logs, self.filters, self.limit, rollup=rollup)
        if rollup is None:
            return bucket_count(logs, self.filters, self.bucket, self.group_by)
        return aggregate(logs, rollup, self.filters, self.bucket, self.group_by)


def scenarios(
    since_day: str,
    since_week: str,
    until: str,
    service: str = "service-007",
    attribute: tuple[str, str] = ("tenant_id", "tenant-000123"),
    q: str = "nEeDlE_%\\pAtH",
) -> dict[str, Scenario]:
    """Recent, by service, by level, by attribute, by text, and the primary bucket count."""
    week = {"since": since_week, "until": until}
    day = {"since": since_day, "until": until}
    return {
        "recent_page": Scenario(LogFilters(**day)),
        "service_page": Scenario(LogFilters(service=service, **week)),
        "level_page": Scenario(LogFilters(level="error", **week)),
        "attribute_page": Scenario(LogFilters(attributes=[attribute], **week)),
        "search_page": Scenario(LogFilters(q=q, **week)),
        "primary_buckets": Scenario(LogFilters(**day), bucket="5m", group_by="service"),
    }
