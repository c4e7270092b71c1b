"""Stores: named tables in a folder, with connection, health and namespaces as partitions."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.errors import ConfigurationError, NotConnectedError, NotFoundError, OperationError

HEALTHY, DEGRADED, UNHEALTHY = "healthy", "degraded", "unhealthy"


@dataclass(frozen=True)
class StoreConfig:
    """path: the folder of the tables. default_ns: what a missing namespace means. slow_seconds: a probe that takes longer is degraded."""

    path: str
    default_ns: str = "default"
    slow_seconds: float = 30.0
    format: str = "parquet"
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.path or not self.default_ns or self.slow_seconds <= 0:
            raise ConfigurationError("path and default_ns must be given, slow_seconds positive")
        if self.format not in ("parquet", "json", "csv", "orc"):
            raise ConfigurationError(f"no such format: {self.format}")


@dataclass(frozen=True)
class Health:
    status: str
    latency_seconds: float
    checked_at: datetime
    message: str | None = None

    @property
    def is_usable(self) -> bool:
        return self.status != UNHEALTHY


def probe(check: Callable[[], None], slow_seconds: float) -> Health:
    begin = time.monotonic()
    try:
        check()
    except Exception as e:  # the report is what a failing store gives
        return Health(UNHEALTHY, time.monotonic() - begin, datetime.now(UTC), str(e).splitlines()[0])
    took = time.monotonic() - begin
    return Health(DEGRADED if took > slow_seconds else HEALTHY, took, datetime.now(UTC))


class Store:
    """Tables of one folder, each partitioned by namespace, so that a read of one prunes the others."""

    name = "tables"

    def __init__(self, spark: SparkSession, config: StoreConfig):
        self.spark, self.config, self._on = spark, config, False

    def connect(self) -> Store:
        self._on = True
        return self

    def disconnect(self) -> None:
        self._on = False

    @property
    def is_connected(self) -> bool:
        return self._on

    def _path(self, table: str) -> str:
        if not self._on:
            raise NotConnectedError(self.config.path)
        return f"{self.config.path.rstrip('/')}/{table}"

    def healthcheck(self, table: str) -> Health:
        return probe(lambda: self.scan(table).limit(1).collect(), self.config.slow_seconds)

    def scan(self, table: str, ns: str | None = None, every_ns: bool = False) -> DataFrame:
        """Rows of one namespace (the default one, if none is named), or of all."""
        path = self._path(table)
        try:
            df = self.spark.read.format(self.config.format).options(**self.config.options).load(path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise NotFoundError(table) from None
            raise OperationError(str(e).splitlines()[0]) from e
        return df if every_ns or "ns" not in df.columns else df.where(F.col("ns") == (ns or self.config.default_ns))

    def write(self, table: str, df: DataFrame, mode: str = "append") -> None:
        writer = df.write.mode(mode).format(self.config.format).options(**self.config.options)
        (writer.partitionBy("ns") if "ns" in df.columns else writer).save(self._path(table))


def build_store(spark: SparkSession, config: StoreConfig) -> Store:
    """A connected store: the configuration holds, or it could not have been made."""
    return Store(spark, config).connect()
