"""Schemas of the entities. Times in a clip are float seconds; -1 marks an untimed annotation."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "clips": "clip_id string, data_source string, country string",
    "annotations": "uid string, project string, clip_id string, key string, value double, start_time double, end_time double, label_type string",
    "video_paths": "clip_id string, path string",
    "datasets": "name string, category string, license string",
    "captions": "uid bigint, clip_id string, model_name string, caption string, data_source string, start_time double, end_time double",
    "vectors": "row_id bigint, clip_id string, vec array<float>",
    "trajectories": "clip_id string, frames array<struct<x: float, y: float, z: float, speed: float, acceleration: float, jerk: float, curvature: float>>",
    "perception": "clip_id string, class string, n int, loc array<array<double>>",
    "classifier_scores": "run_id string, clip_id string, p double",
    "classifier_weights": "run_id string, coef array<double>, intercept double",
    "cluster_assignments": "run_id string, clip_id string, cluster_id int, distance double",
    "centroids": "run_id string, cluster_id int, vec array<double>",
    "topics": "run_id string, cluster_id int, description string, keywords array<string>",
    "clip_lists": "hash string, clip_id string",
    "metrics": "model string, clip_id string, metric string, value double",
    "metric_series": "model string, clip_id string, start_time bigint, traj_idx int, metric string, value double",
    "votes": "id bigint, match_id string, arena string, input_id string, model_a string, model_b string, winner string, username string, criterion string, created_at bigint, duration_ms bigint",
    "segments": "video_id string, start_sec double, end_sec double, kind string, value string",
    "grants": "username string, data_source string",
    "obstacles": "clip_id string, track_id bigint, timestamp_us bigint, center_x double, center_y double, size_x double, size_y double, yaw double",
    "ego": "clip_id string, timestamp_us bigint, x double, y double, yaw double",
}

#: Value of start_time and end_time of an annotation without times.
UNTIMED = -1.0
DEFAULT_CATEGORY = "Other/unknown"


def schema(entity: str) -> StructType:
    return StructType.fromDDL(_DDL[entity])


def check_columns(df, entity: str) -> None:
    """Raise ValueError if df lacks a column of the entity or has another type there."""
    have = {f.name: f.dataType for f in df.schema}
    for f in schema(entity):
        if f.name not in have:
            raise ValueError(f"{entity}: no column {f.name}")
        if have[f.name] != f.dataType:
            raise ValueError(f"{entity}.{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}")
