"""A run's own folder: finished stages, model state after each step, and tables written on the way."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


class RunStore:
    """What a run has finished, in a folder that driver and executors share.

    ``tables`` holds the stages, ``notes`` small results, ``steps`` the state of the model after each
    epoch or tree, ``work`` the tables in between. What has its success mark is finished;
    anything else is made anew. A run started again in the same folder, after a lost driver or with
    more steps, reads what is finished and goes on after the last step. Its settings must be those of the
    run that began; its inputs are taken to be the same.
    """

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark, self.path = spark, path.rstrip("/")
        wanted = json.loads(json.dumps(settings))
        begun = self.note("settings", lambda: wanted)
        if begun != wanted:
            other = sorted(k for k in {*begun, *wanted} if begun.get(k) != wanted.get(k))
            raise ValueError(f"{path} holds a run with other settings: {', '.join(other)}")

    @property
    def work(self) -> str:
        return f"{self.path}/work"

    def note(self, name: str, make: Callable[[], object]):
        """The stored value ``name``; made and stored if there is none yet. Values are JSON."""
        place = f"{self.path}/notes/{name}"
        if not self._finished(place):
            self._write(place, make())
        return json.loads(self.spark.read.text(place).first()["value"])

    def tables(self, *names: str, make: Callable[[], Iterable[DataFrame]]) -> list[DataFrame]:
        """The stored tables; all of them are made and written if one is missing."""
        places = [f"{self.path}/tables/{name}" for name in names]
        if not all(map(self._finished, places)):
            for df, place in zip(make(), places):
                df.write.mode("overwrite").parquet(place)
        return [self.spark.read.parquet(place) for place in places]

    def steps(self) -> list[dict]:
        """States of the finished steps, in order, up to the first gap."""
        places = []
        while self._finished(self._step(len(places))):
            places.append(self._step(len(places)))
        if not places:
            return []
        found = [json.loads(r["value"]) for r in self.spark.read.text(places).collect()]
        return [s["state"] for s in sorted(found, key=lambda s: s["step"])]

    def add_step(self, step: int, state: dict) -> None:
        """Store what step ``step``, from 0, has added to the model."""
        self._write(self._step(step), {"step": step, "state": state})

    def remove(self) -> None:
        """Delete the folder, with all tables that the run's results read."""
        files, place = self._at(self.path)
        files.delete(place, True)

    def _step(self, step: int) -> str:
        return f"{self.path}/steps/{step:06d}"

    def _write(self, place: str, value: object) -> None:
        row = self.spark.createDataFrame([(json.dumps(value, default=lambda x: x.item()),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(place)

    def _finished(self, place: str) -> bool:
        files, mark = self._at(f"{place}/_SUCCESS")
        return files.exists(mark)

    def _at(self, path: str):
        """The file system of a path, and the path, as the cluster's configuration has them."""
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(context._jsc.hadoopConfiguration()), place
