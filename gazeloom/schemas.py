"""Declared schemas of the input tables."""
from pyspark.sql import types as T

_XY = "STRUCT<x: DOUBLE, y: DOUBLE>"

GAZE_SAMPLES = "session STRING, ts DOUBLE, x DOUBLE, y DOUBLE, confidence DOUBLE, topic STRING, duration_ms DOUBLE"
FIXATION_EXPORT = (
    "session STRING, id INT, start_frame_index INT, end_frame_index INT, norm_pos_x DOUBLE, norm_pos_y DOUBLE"
)
BLINK_EVENTS = "session STRING, ts DOUBLE, kind STRING"
NOTIFY_EVENTS = "session STRING, ts DOUBLE, topic STRING"
WORLD_FRAMES = "session STRING, ts DOUBLE"
MARKER_DETECTIONS = f"session STRING, frame INT, marker_id INT, yaw DOUBLE, corners ARRAY<{_XY}>"
FRAME_GEOMETRY = "session STRING, frame INT, h ARRAY<DOUBLE>, warp_w INT, warp_h INT, rotated BOOLEAN"
FRAME_SIGNALS = (
    "session STRING, frame INT, panel_color STRING, panel_shape STRING, contour_raw BOOLEAN, has_grid BOOLEAN, "
    "has_homography BOOLEAN, grid_source STRING, target_clear BOOLEAN, has_template BOOLEAN, "
    "ft DOUBLE, fc DOUBLE, bocc DOUBLE"
)
CELL_OCCLUSION = "session STRING, frame INT, row INT, col INT, occ DOUBLE"
PANEL_POLYGONS = f"session STRING, frame INT, poly ARRAY<{_XY}>"
PANEL_DOTS = "session STRING, panel INT, t0 DOUBLE, t1 DOUBLE, t DOUBLE, dot INT, x DOUBLE, y DOUBLE"
TRIAL_PLAN = "session STRING, block INT, pos INT, trial INT, name STRING, note STRING"
TRIAL_PLAN_NESTED = "session STRING, note STRING, blocks ARRAY<STRUCT<block: INT, trials: ARRAY<STRUCT<trial: INT, name: STRING>>>>"
BOARD_LAYOUT = "col INT, row INT, color STRING, shape STRING, is_piece BOOLEAN"
CALIBRATION_ARTIFACT = (
    "participant STRING, apply BOOLEAN, calib_segment_times ARRAY<DOUBLE>, "
    "panel_offsets ARRAY<STRUCT<t: DOUBLE, off_x: DOUBLE, off_y: DOUBLE, seg: INT, n_dots: INT>>, "
    "stats STRUCT<base_px: DOUBLE, corr_px: DOUBLE, gain: DOUBLE, gain_lo: DOUBLE, gain_hi: DOUBLE, "
    "n_points: INT, reason: STRING>, "
    "uncertainty STRUCT<jitter_cov_px: STRUCT<sigma_major: DOUBLE, sigma_minor: DOUBLE, angle_deg: DOUBLE>, "
    "conf_var_factor: STRUCT<conf: ARRAY<DOUBLE>, factor: ARRAY<DOUBLE>>, "
    "spatial_var_factor: STRUCT<model: STRING, ecc: ARRAY<DOUBLE>, factor: ARRAY<DOUBLE>>, "
    "jitter_rms_px: DOUBLE, n_samples: INT, units: STRING, bias_cov_px: ARRAY<ARRAY<DOUBLE>>>, "
    "fingerprint STRING, units STRING"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
