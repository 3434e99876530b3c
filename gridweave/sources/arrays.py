"""Array files and text series as DataFrames, and dense results for a driver.

Array files are read by executors through Spark's binary source, so they may lie
in any store that Spark reads.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import with_index

ROWS = 64


def read_array(spark: SparkSession, path: str, key: str | None = None, kind: str = "float") -> DataFrame:
    """(path, i, j, v) of 2-D .npy files, or of one array of .npz files.

    A task holds one file's array and gives its pixels on by blocks of rows.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                got = np.load(io.BytesIO(content), allow_pickle=False)
                image = np.atleast_2d(got if key is None else got[key])
                h, w = image.shape
                for top in range(0, h, ROWS):
                    block = image[top : top + ROWS]
                    yield pd.DataFrame({"path": name, "i": np.repeat(np.arange(top, top + len(block), dtype=np.int32), w), "j": np.tile(np.arange(w, dtype=np.int32), len(block)), "v": block.ravel().astype(np.float32 if kind == "float" else np.int32)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"path string, i int, j int, v {kind}")


def subsample(pixels: DataFrame, step: int = 2) -> DataFrame:
    """Every step-th row and column, renumbered."""
    kept = pixels.where((F.col("i") % step == 0) & (F.col("j") % step == 0))
    return kept.withColumns({"i": F.floor(F.col("i") / step).cast("int"), "j": F.floor(F.col("j") / step).cast("int")})


def crop(pixels: DataFrame, top: int, bottom: int, left: int, right: int) -> DataFrame:
    """Rows top..bottom-1 and columns left..right-1, renumbered from zero."""
    kept = pixels.where(F.col("i").between(top, bottom - 1) & F.col("j").between(left, right - 1))
    return kept.withColumns({"i": F.col("i") - top, "j": F.col("j") - left})


def read_series(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(k, columns...) of a comma-separated text without header; k is the row."""
    schema = ", ".join(f"{c} double" for c in columns)
    rows = spark.read.schema(schema).option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    return with_index(rows, "k").select(F.col("k").cast("int").alias("k"), *columns)


def upload(df: DataFrame) -> DataFrame:
    """Keep a source in executor memory for the queries that follow."""
    return df.persist()


def to_dense(pixels: DataFrame, value: str = "v", fill: float = 0.0) -> np.ndarray:
    """A 2-D array on the driver, for display; absent cells are ``fill``.

    This is a sink: the result must fit the driver, like any image to be shown.
    """
    got = pixels.select("i", "j", value).toPandas()
    if got.empty:
        return np.zeros((0, 0))
    out = np.full((got["i"].max() + 1, got["j"].max() + 1), fill, dtype=float)
    out[got["i"], got["j"]] = got[value]
    return out


def log_counts(counts: DataFrame, value: str = "v") -> DataFrame:
    """(i, j, log(count + 1))."""
    return counts.select("i", "j", F.log1p(value).alias(value))


def draw_counts(counts: DataFrame, value: str = "v") -> np.ndarray:
    """``log_counts`` as an image."""
    return to_dense(log_counts(counts, value), value)


def write_series(df: DataFrame, path: str) -> None:
    """Numbers as comma-separated text without header; a file a partition."""
    df.select(*[F.col(c).cast("double") for c in df.columns]).write.csv(path)


def write_pgm(image: np.ndarray) -> bytes:
    """An 8-bit grey map of an image, scaled to its range."""
    low, high = float(np.min(image)), float(np.max(image))
    grey = np.zeros(image.shape, np.uint8) if high == low else ((image - low) * (255 / (high - low))).astype(np.uint8)
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + grey.tobytes()
