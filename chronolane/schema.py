"""Schemas of stored tables, and the normalisation that happens once, at ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


_D, _L, _S, _B = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()

#: One row per sampled frame.
TRACKING = _struct(
    video_file=_S, frame_number=_L, elapsed_time_sec=_D, sampling_interval_frames=T.IntegerType(),
    mouse_surface_temp_mean=_D, mouse_surface_temp_median=_D, mouse_surface_temp_min=_D, mouse_surface_temp_max=_D,
    floor_temp_mean=_D, floor_temp_median=_D, floor_temp_min=_D, floor_temp_max=_D, mouse_minus_floor_temp_mean=_D,
    mouse_roi_center_x=_D, mouse_roi_center_y=_D, mouse_roi_radius_px=_D, floor_roi_center_x=_D, floor_roi_center_y=_D,
    floor_roi_radius_px=_D, floor_roi_shift_direction=_S, floor_roi_shift_distance_px=_D, mouse_centroid_x=_D,
    mouse_centroid_y=_D, mouse_area_px=_L, mouse_bbox_x=_L, mouse_bbox_y=_L, mouse_bbox_width=_L, mouse_bbox_height=_L,
    tracking_confidence=_D, mouse_roi_valid=_B, floor_roi_valid=_B, detection_method=_S, qc_flag=_S, qc_notes=_S,
)

#: One row per stationary interval, closed at both ends.
BOUTS = _struct(video_file=_S, bout_index=_L, bout_start_sec=_D, bout_end_sec=_D, bout_duration_sec=_D, n_samples=_L)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself, or an error that names every missing column."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_optional(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with every column of ``schema`` that it lacks added as a typed NULL."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}) if set(schema.names) - set(df.columns) else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Float columns with NaN as NULL, so one null algebra holds everywhere after ingest."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
