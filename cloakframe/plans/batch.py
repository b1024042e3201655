"""Batches of files: a log of attempts, failures kept to their file, and resumed runs that do only what is open.

The log is a table of the workspace, so each attempt is a commit: a driver that is lost leaves the
files that are done as done.  A batch has at most ``QUEUE`` files (the cap is the feature); a few of
them run beside each other, and each is one Spark job over its own segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.edits import QUEUE
from cloakframe.plans.pipeline import Options, run
from cloakframe.plans.workspace import TABLES, Workspace

#: Fixed value: files of a batch that run at once.
WORKERS = 3
OPEN, DONE, FAILED = "open", "done", "failed"


def status_of(log: DataFrame, by: tuple[str, ...] = ("batch", "file_id")) -> DataFrame:
    """status, attempts and error of each file: what its last entry says; ``open`` entries are no attempts.

    log: batch, file_id, seq, status, error.
    """
    last = F.max_by(F.struct("status", "error"), "seq").alias("x")
    return log.groupBy(*by).agg(last, F.count_if(F.col("status") != OPEN).alias("attempts")).select(*by, "x.status", "attempts", "x.error")


@dataclass
class Batch:
    workspace: Workspace
    name: str
    #: Results go to ``out/file=<hash of the file's name>``.
    out: str
    options: Options = field(default_factory=Options)

    def _append(self, rows: list[tuple]) -> None:
        """rows: file_id, status, error; an entry's number is that of the commit."""
        spark = self.workspace.spark
        self.workspace.log.update(lambda s: ({"attempts": ("append", spark.createDataFrame([(self.name, f, s.version + 1, st, e) for f, st, e in rows], TABLES["attempts"]))}, {}), tries=50)

    def status(self) -> DataFrame:
        return status_of(self.workspace.read("attempts").where(F.col("batch") == self.name))

    def add(self, files: list[str]) -> None:
        """Files that are not in the batch yet become open; more than the queue takes are refused as a whole."""
        known = {r.file_id for r in self.status().collect()}
        new = [f for f in dict.fromkeys(files) if f not in known]
        if len(known) + len(new) > QUEUE:
            raise ValueError(f"a batch has at most {QUEUE} files")
        if new:
            self._append([(f, OPEN, None) for f in new])

    def path(self, file_id: str) -> str:
        return f"{self.out.rstrip('/')}/file={hashlib.sha256(file_id.encode()).hexdigest()[:16]}"

    def run(self, read: Callable[[str], DataFrame]) -> DataFrame:
        """Every file that is not done is read, rewritten with the workspace's state and written; returns the statuses."""
        todo = sorted(r.file_id for r in self.status().where(F.col("status") != DONE).collect())

        def one(file_id: str) -> None:
            try:
                done = run(read(file_id), self.options, self.workspace, file_id)
                done.segments.write.mode("overwrite").parquet(self.path(file_id))
            except Exception as e:  # noqa: BLE001 - one file's failure is none of the others'
                self._append([(file_id, FAILED, f"{type(e).__name__}: {e}"[:500])])
            else:
                self._append([(file_id, DONE, None)])

        with ThreadPoolExecutor(WORKERS) as pool:
            list(pool.map(one, todo))
        return self.status()
