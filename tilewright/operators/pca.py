"""Principal components of bands: one model, or one for each tile."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: sampled rows a tile.
SAMPLE = 1100


@dataclass
class PCAModel:
    """Means and loadings (bands x components); the largest loading of a component is positive."""

    bands: list[str]
    mean: np.ndarray
    loadings: np.ndarray
    variance: np.ndarray

    def row(self) -> dict:
        """As a parameter row, to be kept as JSON or Parquet."""
        return {"bands": self.bands, "mean": self.mean.tolist(), "loadings": self.loadings.tolist(), "variance": self.variance.tolist()}

    @classmethod
    def of_row(cls, row: dict) -> PCAModel:
        return cls(list(row["bands"]), *(np.array(row[k], float) for k in ("mean", "loadings", "variance")))


def components_of(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variances and loadings in falling order, signs fixed."""
    w, v = np.linalg.eigh(cov)
    order = np.argsort(-w, kind="stable")
    w, v = w[order], v[:, order]
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return w, v * np.where(sign == 0, 1, sign)


def sampled(pixels: DataFrame, bands: Sequence[str], per_tile: int = SAMPLE, remove_black: bool = True) -> DataFrame:
    """About ``per_tile`` cells of each tile, the same in every run: a hash of the cell below the tile's share. Rows with a null, and black ones, are dropped first."""
    d = pixels.na.drop("any", subset=list(bands))
    if remove_black:
        d = d.where(F.greatest(*(F.abs(F.col(b)) for b in bands), F.lit(0)) > 0)
    n = d.groupBy("tile_name").agg(F.count(F.lit(1)).alias("_n"))
    h = F.pmod(F.xxhash64("tile_name", "px", "py"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return d.join(n, "tile_name").where(h < F.lit(float(per_tile)) / F.col("_n")).drop("_n")


def pca_model(rows: DataFrame, bands: Sequence[str]) -> PCAModel:
    """Means, then centred cross products: each task adds up its own in numpy, and they are summed by matrix entry.

    Only a matrix of bands x bands reaches the driver. Centred, not scaled.
    Rows with a null or NaN don't count; fewer than two rows are an error.
    """
    bands = list(bands)
    d = rows.na.drop("any", subset=bands).select(*(F.col(b).cast("double").alias(b) for b in bands))
    first = d.agg(F.count(F.lit(1)), *(F.avg(b) for b in bands)).first()
    if first[0] < 2:
        raise ValueError("A PCA needs two rows without nulls")
    mean, k = np.array(first[1:], float), len(bands)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["at", "v"])

    cov = np.zeros(k * k)
    for r in d.mapInArrow(products, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        cov[r["at"]] = r["v"]
    cov = cov.reshape(k, k) / (first[0] - 1)
    w, v = components_of(mean, cov)
    return PCAModel(bands, mean, v, w)


def scored(df: DataFrame, model: PCAModel, n_comp: int = 2) -> DataFrame:
    """With pc1 .. of each row as plain expressions; null where a band is. Means are subtracted."""
    pc = {}
    for k in range(n_comp):
        e = F.lit(0.0)
        for b, m, w in zip(model.bands, model.mean.tolist(), model.loadings[:, k].tolist(), strict=True):
            e = e + (F.col(b).cast("double") - m) * w
        pc[f"pc{k + 1}"] = e
    return df.withColumns(pc)


def pca_local(pixels: DataFrame, bands: Sequence[str], n_comp: int = 2) -> DataFrame:
    """tile_name, px, py, pc1 ..: each tile's own components. Cells with a null are left out; a tile must fit in a task."""
    bands = list(bands)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[bands].to_numpy(float)
        ok = ~np.isnan(x).any(1)
        pdf, x = pdf[ok], x[ok]
        x = x - x.mean(0) if len(x) else x
        v = components_of(x, np.cov(x, rowvar=False).reshape(len(bands), len(bands)))[1] if len(x) > 1 else np.eye(len(bands))
        return pdf[["tile_name", "px", "py"]].assign(**{f"pc{k + 1}": x @ v[:, k] for k in range(n_comp)})

    return pixels.select("tile_name", "px", "py", *bands).groupBy("tile_name").applyInPandas(one, "tile_name string, px int, py int, " + ", ".join(f"pc{k + 1} double" for k in range(n_comp)))
