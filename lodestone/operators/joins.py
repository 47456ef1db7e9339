"""Equi-joins of photogrammetry, provenance and atlas tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def views(names: DataFrame, intrinsics: DataFrame, distortions: DataFrame, poses: DataFrame) -> DataFrame:
    """Cameras that all four tables know; the distortion is joined but written as 0."""
    at = names.join(intrinsics, "camera_id").join(distortions, "camera_id").join(poses, "camera_id")
    return at.withColumn("distortion", F.lit(0.0))


def points_with_features(points: DataFrame, errors: DataFrame, observations: DataFrame, features: DataFrame) -> DataFrame:
    """Points with their detection error and, in key order, their features; missing features count as zeros."""
    long = observations.join(features, ["camera_id", "feature_id"], "left").fillna({"u": 0.0, "v": 0.0})
    lists = long.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("camera_id", "feature_id", "u", "v"))).alias("features"))
    return points.join(errors, "point_id").join(lists, "point_id", "left")


def tiles_of_views(views_: DataFrame, tiles: DataFrame) -> DataFrame:
    """Views with their atlas tile; a view without one is an error."""
    at = views_.join(tiles, "name", "left")
    return at.withColumn("tx", F.when(F.col("tx").isNull(), F.raise_error(F.concat(F.lit("no tile for "), "name"))).otherwise(F.col("tx")))


def camera_measurements(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Measurements of points with their cameras."""
    long = points.select("idx", F.explode("measurements").alias("m")).select("idx", "m.camera", "m.u", "m.v")
    return long.join(cameras, "camera")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")
