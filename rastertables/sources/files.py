"""File scans: images and arrays to pixel rows, text labels, result folders."""
from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES, ARRAYS = ("png", "jpg", "jpeg"), ("npy",)
PIXELS = "path string, channel int, z int, y int, x int, value float"


def by_suffix(files: DataFrame) -> DataFrame:
    """Files with their kind; unsupported types carry an error text instead."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(suffix.isin(*IMAGES), "image").when(suffix.isin(*ARRAYS), "array")
    return files.withColumns({"suffix": suffix, "kind": kind, "error": F.when(kind.isNull(), F.concat(F.lit("unsupported file type "), suffix))})


def _array_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arrays of two, three or four dimensions, one slice at a time so that a batch stays small."""
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.ndim not in (2, 3, 4):
                    raise ValueError(f"array has {a.ndim} dimensions, expected 2 to 4")
            except Exception as e:   # One bad file must not end the scan
                yield pd.DataFrame({"path": [path], "channel": [-1], "z": [-1], "y": [-1], "x": [-1], "value": [np.float32(0)], "error": [str(e)]})
                continue
            a = a.reshape((1,) * (4 - a.ndim) + a.shape)
            yy, xx = np.divmod(np.arange(a.shape[2] * a.shape[3]), a.shape[3])
            for c in range(a.shape[0]):
                for z in range(a.shape[1]):
                    yield pd.DataFrame({"path": path, "channel": c, "z": z, "y": yy, "x": xx, "value": a[c, z].ravel().astype(np.float32), "error": None})


def decode_arrays(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixel rows and error rows of (path, content) array files."""
    rows = files.select("path", "content").mapInPandas(_array_rows, PIXELS + ", error string")
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").select("path", "error")


def scan_arrays(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return decode_arrays(spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path))


def scan_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """8-bit PNG and JPEG files as pixel rows: grey is one channel, colour is red, green, blue, alpha is dropped. Depths
    above 8 bits are turned away from the PNG header, since the image reader would keep only their low byte."""
    heads = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")   # The two readers spell local paths differently
    deep = heads.where(F.conv(F.hex(F.substring("content", 25, 1)), 16, 10).cast("int") > 8).select(same("path").alias("path"))
    img = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(path).select("image.*")
    img = img.withColumn("path", same("origin")).join(deep, "path", "left_anti")

    def rows(batches):
        for pdf in batches:
            for p, h, w, n, data in zip(pdf["path"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                planes = [a[..., 0]] if n == 1 else [a[..., 2], a[..., 1], a[..., 0]]   # Stored blue first
                yy, xx = np.divmod(np.arange(h * w), w)
                for c, plane in enumerate(planes):
                    yield pd.DataFrame({"path": p, "channel": c, "z": 0, "y": yy, "x": xx, "value": plane.ravel().astype(np.float32)})

    return img.mapInPandas(rows, PIXELS), deep.withColumn("error", F.lit("more than 8 bits per channel"))


def encode_arrays(pixels: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """One array file per plane as (path, content): the counterpart of the array scan."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((height, width), np.float32)
        a[pdf["y"], pdf["x"]] = pdf["value"]
        buf = io.BytesIO()
        np.save(buf, a)
        return pd.DataFrame({"path": ["/".join(str(pdf[k].iloc[0]) for k in keys) + ".npy"], "content": [buf.getvalue()]})

    return pixels.groupBy(*keys).applyInPandas(pack, "path string, content binary")


def to_czyx(cells: DataFrame, order: str = "CZYX") -> DataFrame:
    """Cells (coords array<int>, axes string, value) with any axis letters as channel, z, y, x rows. I and Q count as
    slices and S as channel; other axes are read at their first index; missing axes are 0."""
    axes = F.translate(F.upper("axes"), "IQS", "ZZC")
    letters = F.split(axes, "")
    first = F.forall(F.zip_with("coords", letters, lambda c, a: a.isin(*order) | (c == 0)), lambda ok: ok)
    at = lambda a: F.coalesce(F.try_element_at("coords", F.nullif(F.array_position(letters, a), F.lit(0)).cast("int")), F.lit(0))
    keep = cells.where(first)
    return keep.withColumns({"channel": at("C"), "z": at("Z"), "y": at("Y"), "x": at("X")}).drop("coords", "axes")


def parse_run_folder(name) -> dict:
    """Method, prompt, seed and draw of a result folder such as sam_points_s3_d1."""
    pat = r"^([a-z0-9]+)_([a-z]+)_s(\d+)_d(\d+)$"
    part = lambda k: F.when(F.regexp_extract(name, pat, k) != "", F.regexp_extract(name, pat, k))
    return {"method": part(1), "prompt": part(2), "seed": part(3).cast("int"), "draw": part(4).cast("int")}
