"""A ledger of sample results, so that a long run can stop and go on.

Results of some samples are written to a folder of their own and then entered in the
ledger, which is what makes them count: a run that dies in between leaves a folder that
nobody reads. A rerun computes only the samples that are not entered; of two runs that
entered the same sample, the folder that is first by name counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ShardLedger:
    """Results by sample below ``root``, a folder all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def entries(self) -> dict[int, str]:
        """The folder that holds each finished sample."""
        try:
            rows = self.spark.read.schema("sample_id int, folder string").parquet(f"{self.root}/ledger").collect()
        except AnalysisException:
            return {}  # nothing entered yet
        out: dict[int, str] = {}
        for sample_id, folder in rows:  # one row a sample and run
            out[sample_id] = min(folder, out.get(sample_id, folder))
        return out

    def missing(self, sample_ids: Iterable[int]) -> list[int]:
        done = self.entries()
        return [i for i in sample_ids if i not in done]

    def run(self, compute: Callable[[list[int]], DataFrame], sample_ids: Sequence[int]) -> list[int]:
        """Computes the samples that are missing, all in one job, and enters them.

        ``compute`` takes sample ids and gives their rows with a ``sample_id``. Samples
        without rows are entered too. Gives what it computed.
        """
        ids = self.missing(sample_ids)
        if not ids:
            return []
        folder = f"part-of-{uuid.uuid4().hex}"
        compute(ids).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        entered = self.spark.createDataFrame([(int(i), folder) for i in ids], "sample_id int, folder string")
        entered.coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")
        return ids

    def read(self, sample_ids: Sequence[int]) -> tuple[DataFrame | None, list[int]]:
        """Rows of the samples that are there, and the ids of those that are not."""
        done = self.entries()
        by_folder: dict[str, list[int]] = {}
        for i in sample_ids:
            if i in done:
                by_folder.setdefault(done[i], []).append(i)
        out = None
        for folder, ids in sorted(by_folder.items()):
            rows = self.spark.read.parquet(f"{self.root}/{folder}").where(F.col("sample_id").isin(ids))
            out = rows if out is None else out.unionByName(rows)
        return out, [i for i in sample_ids if i not in done]
