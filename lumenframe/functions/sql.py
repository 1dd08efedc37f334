"""The scalar functions for SQL text: temporary SQL functions, which the optimizer inlines, and views over a folder of tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: name(parameters) -> (type, body)
FUNCTIONS = {
    "half_even(x DOUBLE)": ("BIGINT", "CAST(rint(x) AS BIGINT)"),
    "wrap_index(i BIGINT, n BIGINT)": ("BIGINT", "pmod(i, n)"),
    "unit_draw(salt STRING, k STRING)": ("DOUBLE", "CAST(conv(substring(md5(concat_ws('|', salt, coalesce(k, ''))), 1, 8), 16, 10) AS DOUBLE) / 4294967296.0D"),
    "source_frames(latents BIGINT)": ("BIGINT", "4 * latents - 3"),
    "padded_frames(n BIGINT)": ("BIGINT", "CASE WHEN n = 1 THEN 1 ELSE 17 * greatest(0, CAST(ceil((n - 5) / 17) AS BIGINT)) + 5 END"),
    "shift_sigma(x DOUBLE, s DOUBLE)": ("DOUBLE", "s * x / (1 + (s - 1) * x)"),
    "pose_index(f BIGINT, n_video BIGINT, n_camera BIGINT)": (
        "BIGINT",
        "CASE WHEN n_camera <= 0 THEN NULL WHEN n_camera = n_video THEN f WHEN abs(n_camera - n_video) <= 1 THEN least(f, n_camera - 1)"
        " ELSE least(CAST(rint(f * ((n_camera - 1) / greatest(1, n_video - 1))) AS BIGINT), n_camera - 1) END",
    ),
}


def register(spark: SparkSession, sf_dir: str | None = None, tables: list[str] = ()) -> SparkSession:
    """Make the functions known to ``spark.sql``, and the named tables of a folder known as views."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udf.register("trimmed_mean", trimmed_mean)
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark


@F.pandas_udf(DoubleType())
def trimmed_mean(values: pd.Series) -> float:
    """Mean without the lowest and the highest tenth: an aggregate function of our own, for SQL as well.

    Spark hands a group's values to it as a whole, so it is for groups that fit one task.
    """
    v = np.sort(values.dropna().to_numpy(float))
    k = len(v) // 10
    return float(v[k : len(v) - k].mean()) if len(v) else None
