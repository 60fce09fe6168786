"""Versioned tables of a run: what a stage saves is seen when its commit row is there.

    <root>/<table>/<version>/...   the rows of one version
    <root>/commits/...             one line of JSON a commit

A stage writes its tables as new versions, which nobody reads yet, and then adds
one line that names all of them. That line is the switch: a stage that fails
before it leaves the tables as they were, tables of one stage change together,
and a stage may read the table that it saves anew. The line also holds the
parameters the stage was run with, the versions it read, and what was counted
while its rows were written. Versions that no commit names any more can be emptied.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def saved_lines(spark: SparkSession, path: str) -> list[dict]:
    """The JSON lines below a path, none where it is absent. A few, written one by one."""
    try:
        return [json.loads(r[0]) for r in spark.read.text(path).collect()]
    except AnalysisException:
        return []


def add_line(spark: SparkSession, path: str, line: Mapping) -> None:
    spark.range(0, 1, 1, 1).select(F.lit(json.dumps(line, default=str)).alias("value")).write.mode("append").text(path)


@dataclass(frozen=True)
class Commit:
    number: int
    stage: str
    tables: Mapping[str, str]  # version of each table that the stage saved
    schemas: Mapping[str, str]
    params: Mapping[str, object]
    inputs: Mapping[str, str]  # version of each table that it read
    counts: Mapping[str, Mapping[str, int]]


@dataclass
class Stages:
    """The tables below one root. One writer at a time."""

    spark: SparkSession
    root: str
    _commits: list[Commit] | None = None
    _pending: dict[str, tuple[str, str, dict[str, int]]] = field(default_factory=dict)

    @property
    def commits(self) -> list[Commit]:
        """All commits, oldest first."""
        if self._commits is None:
            found = [Commit(**line) for line in saved_lines(self.spark, f"{self.root}/commits")]
            self._commits = sorted(found, key=lambda c: c.number)
        return self._commits

    def of(self, table: str) -> Commit:
        """The commit that a table's current version came with."""
        for commit in reversed(self.commits):
            if table in commit.tables:
                return commit
        raise FileNotFoundError(f"no saved table {table} under {self.root}; run the stage that writes it first")

    def has(self, table: str) -> bool:
        return any(table in c.tables for c in self.commits)

    def read(self, table: str) -> DataFrame:
        """The current version; what the running stage has written itself goes first."""
        if table in self._pending:
            version, schema, _ = self._pending[table]
        else:
            commit = self.of(table)
            version, schema = commit.tables[table], commit.schemas[table]
        return self._at(table, version, schema)

    def _at(self, table: str, version: str, schema: str) -> DataFrame:
        # With its schema, which a table without rows and a partition column would not tell.
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{self.root}/{table}/{version}")

    def write(
        self, table: str, df: DataFrame, counts: Mapping[str, Column] | None = None, partition_by: Sequence[str] = ()
    ) -> DataFrame:
        """Save a version that is seen after ``commit``, and read it back.

        *counts* are aggregates observed while the rows are written, which takes no pass of its own.
        """
        version = uuid.uuid4().hex
        observed = Observation(f"{table}-{version}") if counts else None
        rows = df.observe(observed, *(c.cast("long").alias(n) for n, c in counts.items())) if counts else df
        rows.write.partitionBy(*partition_by).parquet(f"{self.root}/{table}/{version}")
        found = {n: v or 0 for n, v in observed.get.items()} if observed else {}
        last = [f for f in df.schema if f.name in partition_by]
        schema = T.StructType([f for f in df.schema if f.name not in partition_by] + last).json()
        self._pending[table] = (version, schema, found)
        return self._at(table, version, schema)

    def commit(self, stage: str, params: Mapping[str, object] | None = None, inputs: Sequence[str] = ()) -> Commit:
        """Switch to all tables written since the last commit, together. *inputs* are the saved tables they come from."""
        done = Commit(
            number=max((c.number for c in self.commits), default=0) + 1,
            stage=stage,
            tables={t: v for t, (v, _, _) in self._pending.items()},
            schemas={t: s for t, (_, s, _) in self._pending.items()},
            params=json.loads(json.dumps(params or {}, default=str)),
            inputs={t: self.of(t).tables[t] for t in inputs},
            counts={t: c for t, (_, _, c) in self._pending.items() if c},
        )
        add_line(self.spark, f"{self.root}/commits", done.__dict__)
        self.commits.append(done)
        self._pending = {}
        return done

    def check(self, table: str, params: Mapping[str, object]) -> None:
        """Raise where a saved table was made with other parameters, or from versions replaced since."""
        commit = self.of(table)
        wanted = json.loads(json.dumps(params, default=str))
        other = sorted(k for k, v in wanted.items() if k in commit.params and commit.params[k] != v)
        if other:
            raise ValueError(f"the saved table {table} was made with other values of {', '.join(other)}; run {commit.stage} again")
        old = sorted(t for t, v in commit.inputs.items() if self.of(t).tables[t] != v)
        if old:
            raise ValueError(f"the saved table {table} was made before {', '.join(old)} was saved anew; run {commit.stage} again")

    def vacuum(self) -> list[str]:
        """Empty the versions that later commits have replaced; returns their paths."""
        emptied = []
        for table in {t for c in self.commits for t in c.tables}:
            current = self.of(table).tables[table]
            for c in self.commits:
                if table in c.tables and c.tables[table] != current:
                    path = f"{self.root}/{table}/{c.tables[table]}"
                    nothing = self.spark.createDataFrame([], T.StructType.fromJson(json.loads(c.schemas[table])))
                    nothing.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
                    emptied.append(path)
        return emptied


def rows_count() -> dict[str, Column]:
    return {"rows": F.count(F.lit(1))}
