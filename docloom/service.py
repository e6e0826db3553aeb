"""The façade of an application: paths in, counts and messages, and runs over what was loaded."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pipeline, sinks
from .operators import report
from .sources import images

# Messages and states.
LOADED, FINISHED, IDLE = "已加载 {} 张图片", "处理完成，输出目录：{}", "等待"
LOG_FORMAT = "%(asctime)s [%(levelname)s] %(name)s: %(message)s"


class Workflow:
    """Loads paths one after the other (all that was loaded counts) and runs over them."""

    def __init__(self, spark: SparkSession, output: str = "output"):
        self.spark, self.output, self.paths = spark, output, []

    def add(self, path: str) -> int:
        """Load a folder, archive or image; gives how many files are loaded so far."""
        self.paths.append(path)
        return self.files().count()

    def clear(self) -> None:
        self.paths = []

    def files(self) -> DataFrame:
        """path, content of all that is loaded; a file in an archive is archive!member."""
        found = images.loaded(self.spark, self.paths)
        return found.select(F.when(F.col("member") == "", F.col("path")).otherwise(F.concat("path", F.lit("!"), "member")).alias("path"), "content")

    def load(self, path: str) -> dict:
        """Count so far and its message."""
        count = self.add(path)
        return {"count": count, "message": LOADED.format(count)}

    def run(self, backend: Callable | None = None, prepare: Callable[[bytes], bytes] | None = None) -> DataFrame:
        """The rename plan by a recogniser; without one, every file waits. No target bears the name of a file that is in the output folder."""
        if backend is None:
            return report.waiting(self.files().select(F.col("path").alias("file")))
        fields = pipeline.from_images(pipeline.numbered(self.files()), backend, prepare=prepare)
        return pipeline.rename_plan(fields, self.output, sinks.existing_names(self.spark, self.output))

    def finished(self) -> str:
        return FINISHED.format(self.output)


class Controller:
    """What a user interface holds: loading a path replaces what was loaded before, and starting runs over it."""

    def __init__(self, spark: SparkSession, output: str = "output"):
        self.spark, self.output, self.workflow = spark, output, None

    def load_file(self, path: str) -> int:
        """How many files the path holds."""
        self.workflow = Workflow(self.spark, self.output)
        return self.workflow.add(path)

    def start(self, backend: Callable | None = None) -> DataFrame | list:
        """The run over what is loaded; nothing if nothing is."""
        return self.workflow.run(backend) if self.workflow else []


def progress(spark: SparkSession) -> dict:
    """Tasks done and in all of the stages that run now, whole percent, and the state."""
    tracker = spark.sparkContext.statusTracker()
    stages = [x for x in map(tracker.getStageInfo, tracker.getActiveStageIds()) if x]
    done, total = sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
    return {"current": done, "total": total, "percent": int(done / total * 100) if total else 0, "status": IDLE if not total else ""}


def logger(path: str, name: str = "docloom") -> logging.Logger:
    """The driver's log, in a file; set up once."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.FileHandler(path, encoding="utf-8")
        handler.setFormatter(logging.Formatter(LOG_FORMAT))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log
