"""Token tables (TSV) and pluggable recognisers of images."""

from __future__ import annotations

import csv
import io
import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Languages that the program is called with, and the message where it is missing.
PROGRAM_LANGUAGES, PROGRAM_MISSING = "chi_sim+eng", "OCR组件不存在"
TOKENS = "path string, in_pos int, text string, conf string, x int, y int, w int, h int"
GEOMETRY = ["left", "top", "width", "height"]


def parsed_tsv(text: str) -> list[tuple]:
    """Kept tokens of a TSV with header, in order; a bad row ends the reading, what was read stays."""
    out = []
    try:
        for row in csv.DictReader(io.StringIO(text), delimiter="\t"):
            word = row.get("text", "").strip()
            if word and row.get("conf", "") != "-1":
                out.append((word, row.get("conf", ""), *(int(row.get(g) or 0) for g in GEOMETRY)))
    except (AttributeError, ValueError):
        pass
    return out


def tsv_tokens(files: DataFrame) -> DataFrame:
    """Tokens of TSV files (path, content): each file is parsed as a whole, as quotes may span lines."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, *t) for p, c in zip(batch["path"], batch["content"], strict=True) for i, t in enumerate(parsed_tsv(bytes(c or b"").decode("utf-8", "replace")))]
            yield pd.DataFrame(rows, columns=["path", "in_pos", "text", "conf", "x", "y", "w", "h"])

    return files.select("path", "content").mapInPandas(parse, TOKENS)


def recognised(images: DataFrame, backend: Callable[[str, bytes], list[tuple]], prepare: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """Tokens of images (path, content) by a backend that gives (text, conf, x, y, w, h) per token; a failure gives none and its message.

    `prepare` (such as preprocess.prepared) is applied to an image's bytes first. Adds `error`: empty, or
    what either raised for that image (then the row's token is null).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, i, *t, "") for i, t in enumerate(backend(path, prepare(bytes(content)) if prepare else bytes(content)))]
                except Exception as e:  # noqa: BLE001 - any failure of a backend is the image's own
                    rows.append((path, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "in_pos", "text", "conf", "x", "y", "w", "h", "error"]).astype({c: "Int32" for c in ("in_pos", "x", "y", "w", "h")})

    return images.select("path", "content").mapInPandas(run, TOKENS + ", error string")


class ProgramBackend:
    """A backend out of a program that reads an image file and writes `output`.tsv: program image output -l languages tsv.

    Each image is one call; its files lie in a folder of their own on the worker, which goes afterwards.
    """

    def __init__(self, program: str, data: str | None = None, languages: str = PROGRAM_LANGUAGES):
        self.program, self.data, self.languages = program, data, languages

    def __call__(self, path: str, content: bytes) -> list[tuple]:
        if not shutil.which(self.program):
            raise FileNotFoundError(PROGRAM_MISSING)
        with tempfile.TemporaryDirectory() as folder:
            image, output = f"{folder}/image{os.path.splitext(path)[1] or '.jpg'}", f"{folder}/output"
            with open(image, "wb") as f:
                f.write(content)
            env = os.environ | ({"TESSDATA_PREFIX": self.data} if self.data else {})
            ran = subprocess.run([self.program, image, output, "-l", self.languages, "tsv"], env=env, capture_output=True)
            if not os.path.exists(f"{output}.tsv"):
                raise RuntimeError(ran.stderr.decode("utf-8", "replace").strip() or f"{self.program} wrote nothing")
            with open(f"{output}.tsv", encoding="utf-8", errors="replace", newline="") as f:
                return parsed_tsv(f.read())


class LineBackend:
    """A backend out of an engine that knows lines of text but no places.

    `load` makes the engine, once per worker and only when the first image comes; where it can't be
    made, images have no lines. The engine gives the lines of an image's bytes.
    """

    def __init__(self, load: Callable[[], Callable[[bytes], list[str]]]):
        self.load, self.engine, self.failed = load, None, False

    def __call__(self, path: str, content: bytes) -> list[tuple]:
        if self.engine is None and not self.failed:
            try:
                self.engine = self.load()
            except Exception:  # noqa: BLE001 - an engine that isn't there recognises nothing
                self.failed = True
        return [] if self.engine is None else [(line, "", 0, 0, 0, 0) for line in self.engine(content)]


def from_table(images: DataFrame, tokens: DataFrame) -> DataFrame:
    """The default backend: tokens recognised elsewhere, looked up by path."""
    return images.select("path").join(tokens, "path", "left").withColumn("error", F.lit(""))
