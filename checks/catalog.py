"""What a check is, and the register of all checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from caretrail.session import shared_folder
from checks.views import oracle, view

AS_OF = "2024-09-01 12:00:00"


@dataclass(frozen=True)
class Check:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, covers: str, views: str = "", sql: str | None = None):
    """Register a query. It gets its views as frames, in the order named; ``sql`` sees them as tables."""
    names = views.split()

    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*[view(spark, sf_dir, v) for v in names])

        assert name not in CHECKS
        CHECKS[name] = Check(name, covers, run, oracle(sql, *names) if sql else None)
        return fn

    return register


def scratch(spark: SparkSession, name: str) -> str:
    return shared_folder(spark, f"{name}-{uuid.uuid4().hex[:12]}")
