"""Query registry: one Spark plan and (when SQL can express it) one DuckDB
oracle text per operator ID.

``rnd`` names double columns that both sides round (to 9 places, or
``"name:places"``), so that summation-order noise in the last bits does not
break the value hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACES = 9


@dataclass
class Entry:
    key: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    rnd: tuple[str, ...] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.fn(spark, sf_dir)
        if self.rnd:
            df = df.withColumns({c: F.round(F.col(c), n) for c, n in self._places()})
        return df

    def _places(self):
        out = []
        for item in self.rnd:
            name, _, n = item.partition(":")
            out.append((name, int(n) if n else PLACES))
        return out

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.rnd:
            return self.sql
        rep = ", ".join(f'round("{c}", {n}) AS "{c}"' for c, n in self._places())
        return f"SELECT * REPLACE ({rep}) FROM (\n{self.sql}\n) AS q"


REGISTRY: dict[str, Entry] = {}


def query(key: str, sql: str | None = None, rnd: tuple[str, ...] | list[str] = ()):
    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(key, fn, sql, tuple(rnd))
        return fn
    return deco
