"""Captures on a plan: paced, idempotent, every outcome a row; and files parsed with their failures kept."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOMES = ("captured", "already_captured", "missing", "refused", "failed")


@dataclass
class Runner:
    """Runs due tasks in order with a floor between requests.

    ``fetch(task) -> (status, payload)``. A refusal (403) is checked against ``canary``, a request known to work: where
    that is refused too, the source blocks us and the refusals of this run say nothing about the tasks.
    """

    fetch: Callable[[dict], tuple[int, bytes | None]]
    done: set
    canary: dict | None = None
    floor: float = 0.35
    sleep: Callable[[float], None] = time.sleep

    def run(self, tasks: list[dict], now: int) -> Iterator[dict]:
        for task in sorted((t for t in tasks if t["capture_ts"] <= now < t["anchor_ts"]), key=lambda t: (t["capture_ts"], t["task_id"])):
            if task["task_id"] in self.done:
                yield {**task, "outcome": "already_captured", "payload": None, "trustworthy": True}
                continue
            self.sleep(self.floor)
            try:
                status, payload = self.fetch(task)
            except Exception as error:  # noqa: BLE001 - a failure is an outcome
                yield {**task, "outcome": "failed", "payload": repr(error).encode(), "trustworthy": True}
                continue
            outcome = "captured" if status < 400 else "missing" if status == 404 else "refused" if status == 403 else "failed"
            trusted = outcome != "refused" or (self.canary is not None and self.fetch(self.canary)[0] < 400)
            if outcome == "captured":
                self.done.add(task["task_id"])
            yield {**task, "outcome": outcome, "payload": payload, "trustworthy": trusted}


def slot_grid(spark: SparkSession, first_day: int, last_day: int, step: int = 1800) -> DataFrame:
    """Every slot of every day (epoch days, both inclusive)."""
    return spark.range(first_day, last_day + 1).select(F.col("id").alias("day"), F.explode(F.sequence(F.lit(0), F.lit(86_400 - step), F.lit(step))).alias("second")).select("day", (F.col("day") * 86_400 + F.col("second")).alias("slot_ts"))


def guaranteed(anchors: DataFrame, tasks: DataFrame) -> DataFrame:
    """Anchors (game_id, anchor_ts) with how many of their tasks come before them, and whether any does."""
    early = tasks.join(anchors, "game_id").where("capture_ts < anchor_ts").groupBy("game_id").agg(F.count(F.lit(1)).alias("n_tasks"))
    return anchors.join(early, "game_id", "left").select("game_id", "anchor_ts", F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"), F.col("n_tasks").isNotNull().alias("covered"))


def parsed(files: DataFrame, parse: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Rows of each file (path, content), one after another; a file that cannot be parsed is one row with its error."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = [{**r, "path": path, "error": None} for r in parse(bytes(content))]
                except Exception as error:  # noqa: BLE001 - a failure is a row
                    rows = [{"path": path, "error": f"{type(error).__name__}: {error}"}]
                if rows:
                    yield pd.DataFrame(rows).reindex(columns=["path", "error", *names])

    return files.select("path", "content").mapInPandas(run, f"path string, error string, {schema}")
