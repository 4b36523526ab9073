"""Saved analysis runs (W2, G1-G3) as two tables under a commit log, ``runs`` and ``charts``.

A run and its charts become visible together; two writers cannot lose a run; a delete is one log entry that readers
merge (the cascade names the key of both tables)."""
from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import CommitLog

RUN = ("id string, title string, dataset_source string, dataset_id string, dataset_name string, dataset_url string, "
       "num_rows long, num_columns long, column_names array<string>, analysis_config string, analysis_result string, "
       "created_at timestamp, updated_at timestamp")
CHART = "analysis_id string, chart_type string, title string, plotly_json string, display_order int"


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, self.root, {"runs": RUN, "charts": CHART}, {"runs": "id", "charts": "analysis_id"})

    def runs(self) -> DataFrame:
        return self.log.read("runs").drop("_version")

    def charts(self) -> DataFrame:
        return self.log.read("charts").drop("_version")

    # -- W2
    def save(self, run: dict, charts: list[dict]) -> str:
        """One run row plus its charts; ``display_order`` is the list position (posexplode)."""
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        row = {**{k: None for k in [c.split()[0] for c in RUN.split(", ")]}, **run}
        row["created_at"] = row["created_at"] or now
        row["updated_at"] = row["updated_at"] or now
        for k in ("analysis_config", "analysis_result"):
            if not isinstance(row[k], str) and row[k] is not None:
                row[k] = json.dumps(row[k])
        packed = self.spark.createDataFrame([(run["id"], [(c["chart_type"], c["title"], c["plotly_json"]) for c in charts])],
                                            "analysis_id string, c array<struct<chart_type:string,title:string,plotly_json:string>>")
        rows = packed.select("analysis_id", F.posexplode("c").alias("display_order", "x")).select(
            "analysis_id", "x.chart_type", "x.title", "x.plotly_json", F.col("display_order").cast("int"))
        self.log.append({"runs": self.spark.createDataFrame([row], RUN), "charts": rows})
        return run["id"]

    # -- G1 / J3
    def get(self, run_id: str) -> DataFrame:
        """The run with its charts in display order (an empty frame when absent)."""
        ch = self.charts().where(F.col("analysis_id") == run_id).groupBy("analysis_id").agg(
            F.array_sort(F.collect_list(F.struct("display_order", "chart_type", "title", "plotly_json"))).alias("charts"))
        return self.runs().where(F.col("id") == run_id).join(ch, F.col("id") == F.col("analysis_id"), "left") \
            .drop("analysis_id")

    # -- G2 / T1
    def list(self) -> DataFrame:
        return self.runs().orderBy(F.col("created_at").desc())

    # -- G3
    def delete(self, run_id: str) -> bool:
        """Whether the run was there; its charts go with it."""
        if self.runs().where(F.col("id") == run_id).isEmpty():
            return False
        return self.log.delete({"runs": [run_id], "charts": [run_id]})
