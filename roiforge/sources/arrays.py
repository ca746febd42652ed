"""In-memory images as tables of pixels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def montage(spark: SparkSession, intensities, labels=None, names: Sequence[str] | None = None, volumes: bool = False) -> DataFrame:
    """An image (h, w) or a stack (n, h, w), or with volumes a volume (d, h, w) or several (n, d, h, w), as pixels of slides.

    Without labels every image is one region. Negative intensities are counted from their minimum. Background is left out.
    """
    values = np.asarray(intensities)
    mask = np.ones_like(values, dtype=np.int64) if labels is None else np.asarray(labels).astype(np.int64)
    if values.shape != mask.shape:
        raise ValueError(f"images {values.shape} and masks {mask.shape} differ in shape")
    whole = 3 if volumes else 2
    if values.ndim not in (whole, whole + 1):
        raise ValueError(f"arrays of {whole} or {whole + 1} dimensions are needed")
    if values.ndim == whole:
        values, mask = values[None], mask[None]
    if not volumes:
        values, mask = values[:, None], mask[:, None]
    if values.size and values.min() < 0:
        values = values - values.min()
    n, z, y, x = np.nonzero(mask)
    slides = np.array([str(s) for s in names] if names is not None else [f"slide{k}" for k in range(len(values))], dtype=object)
    frame = pd.DataFrame({"slide_id": slides[n], "t": np.zeros(len(n), dtype=np.int64), "label": mask[n, z, y, x], "x": x.astype(np.int64), "y": y.astype(np.int64), "z": z.astype(np.int64), "inten": values[n, z, y, x].astype(np.int64)})
    return spark.createDataFrame(frame, "slide_id string, t long, label long, x long, y long, z long, inten long")
