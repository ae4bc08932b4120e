"""Runs of many conditions and seeds that can be stopped and taken up again.

A run is a folder with one small log and one prediction table per cell (condition and seed), under a
key that also covers the inputs and settings.  A cell is finished once its log says ``ok``; the log is written after
the predictions, so a run that dies leaves no half-finished cell behind.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, functions as F

from spandoc.operators import metrics as m
from spandoc.plans import conditions, joint
from spandoc.plans.evaluation import Setup
from spandoc.plans.storage import forget

LOG_SCHEMA = "condition string, base string, seed bigint, key string, status string, error string, seconds double"


@dataclass(frozen=True)
class Cell:
    condition: str
    seed: int | None

    @property
    def name(self) -> str:
        return self.condition if self.seed is None else f"{self.condition}_s{self.seed}"


def cells(names: list[str], seeds: list[int]) -> list[Cell]:
    return [Cell(n, s) for n in names for s in (seeds or [None])]


def inputs_digest(setup: Setup) -> str:
    """A digest of the entities and spans that does not depend on their order."""
    def fold(df: DataFrame) -> list:
        row = df.select(F.xxhash64(*df.columns).alias("h")).agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.bit_xor("h"), F.lit(0))).first()
        return [str(v) for v in row]

    return sha256(json.dumps([fold(setup.entities), fold(setup.spans)]).encode()).hexdigest()


def key_of(cell: Cell, setup: Setup, digest: str) -> str:
    settings = [cell.condition, cell.seed, digest, setup.alpha, setup.max_features, setup.min_df, setup.scheme.labels, setup.scheme.gap]
    return sha256(json.dumps(settings).encode()).hexdigest()[:32]


def require(wanted: list[Cell], log: DataFrame) -> None:
    """Raises an error that names the cells of ``wanted`` that ``log`` does not have as finished, and why."""
    ended = {r.condition: r for r in log.select("condition", "status", "error").collect()}
    missing = [c.name for c in wanted if c.name not in ended or ended[c.name].status != "ok"]
    if missing:
        why = [f"{n} ({ended[n].status}: {ended[n].error})" if n in ended else f"{n} (not run)" for n in missing]
        raise RuntimeError(f"{len(missing)} of {len(wanted)} cells are not finished: " + "; ".join(why))


class Runs:
    """The run kept below ``folder``, which all executors share."""

    def __init__(self, setup: Setup, folder: str):
        self.setup, self.folder = setup, folder.rstrip("/")
        self.spark = setup.entities.sparkSession

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def log(self) -> DataFrame:
        """The last entry of every cell: condition, base, seed, key, status, error, seconds."""
        if not self._exists(f"{self.folder}/log"):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.folder}/log/*")

    def predictions(self) -> DataFrame:
        """condition, base, seed, phase, entity_id, grp, y_true, y_pred of the finished cells."""
        done = self.log().filter("status = 'ok'").select("key", "condition", "base", "seed")
        schema = "key string, phase string, entity_id string, grp string, y_true double, y_pred double"
        if not self._exists(f"{self.folder}/predictions"):
            return self.spark.createDataFrame([], schema).join(done, "key").drop("key")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/predictions/*").join(F.broadcast(done), "key").drop("key")

    def _write(self, kind: str, key: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/{key}")

    def _enter(self, cell: Cell, key: str, status: str, error: str | None, seconds: float) -> None:
        row = [(cell.name, cell.condition, cell.seed, key, status, error, seconds)]
        self._write("log", key, self.spark.createDataFrame(row, LOG_SCHEMA))

    def run(self, wanted: list[Cell], at_once: int = 12) -> DataFrame:
        """Runs the cells that are not finished, ``at_once`` of them in one job; returns the log of ``wanted``.

        A job that fails is tried again cell by cell, so one bad cell costs no other.  Failed cells are entered as
        ``failed`` and tried again by the next run.
        """
        digest = inputs_digest(self.setup)
        keys = {c: key_of(c, self.setup, digest) for c in wanted}
        done = {r.key for r in self.log().filter("status = 'ok'").select("key").collect()}
        todo = [c for c in wanted if keys[c] not in done]
        for lo in range(0, len(todo), at_once):
            block = todo[lo:lo + at_once]
            try:
                self._fit(block, keys)
            except Exception:  # found out cell by cell
                for cell in block:
                    started = time.time()
                    try:
                        self._fit([cell], keys)
                    except Exception as e:
                        self._enter(cell, keys[cell], "failed", f"{type(e).__name__}: {e}"[:500], time.time() - started)
        return self.log().filter(F.col("key").isin(*keys.values()))

    def _fit(self, block: list[Cell], keys: dict[Cell, str]) -> None:
        started = time.time()
        for cell in block:
            conditions.resolve(cell.name)
        preds = joint.fitted(self.setup, [c.name for c in block])  # stored, so a cell only reads its rows
        seconds = (time.time() - started) / len(block)
        for cell in block:
            own = preds.filter(F.col("condition") == cell.name)
            self._write("predictions", keys[cell], own.select(F.lit(keys[cell]).alias("key"), "phase", "entity_id", "grp", "y_true", "y_pred"))
            self._enter(cell, keys[cell], "ok", None, seconds)
        forget(preds)

    def table(self) -> DataFrame:
        """One row per condition, seed and phase with its metrics; failed cells have one row without."""
        scored = m.metrics(self.predictions(), ["condition", "phase"])
        return self.log().drop("key", "seconds").join(scored, "condition", "left")
