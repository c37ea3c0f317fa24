"""Names, constants and column lists of the data model."""

from __future__ import annotations

# What the tables' readers expect, name by name and in this order, and the limits that the results depend on.

KEYS = ("id", "people_id")
#: BODY_25 points of the two wrists.
HANDS = {"right": 4, "left": 7}
WIDE = ("id", "people_id", "frame", "frame_timestamp", "nx_4", "ny_4", "c_4", "nx_7", "ny_7", "c_7")

MOVEMENT_SPEED = 0.5
SPEED_THRESHOLDS = {"0p5": 0.5, "1p0": 1.0, "2p0": 2.0}
MIN_STAT_SAMPLES = 10
ZERO_RESULTANT = 1e-12
NECK_TOLERANCE = 1e-6

FRAME_TABLE = """
    id people_id frame frame_timestamp source_observed frame_inferred clock_known timestamp_inferred right_confidence right_nx right_ny right_nx_smooth
    right_ny_smooth right_valid right_observed right_interpolated right_neck_distance right_neck_angle right_above_neck right_velocity_x right_velocity_y
    right_speed right_accel_x right_accel_y right_accel_magnitude right_step_distance left_confidence left_nx left_ny left_nx_smooth left_ny_smooth
    left_valid left_observed left_interpolated left_neck_distance left_neck_angle left_above_neck left_velocity_x left_velocity_y left_speed left_accel_x
    left_accel_y left_accel_magnitude left_step_distance both_hands_valid pair_separation pair_angle centroid_x centroid_y mirror_error_x mirror_error_y
"""
FRAME_TABLE_MORE = """
    right_jerk_x right_jerk_y right_jerk_magnitude left_jerk_x left_jerk_y left_jerk_magnitude
"""
SEQUENCE_TABLE = """
    id people_id frames_source frames_grid frames_missing_grid n_timed_frames n_timestamp_inferred n_missing_timestamps t_start t_end duration_s
    right_n_observed right_n_interpolated right_n_valid right_frac_observed right_frac_interpolated right_frac_valid right_mean_speed right_max_speed
    right_mean_accel_magnitude right_max_accel_magnitude right_path_length right_nx_range right_ny_range right_mean_neck_distance right_angle_mean
    right_angle_std right_time_to_peak_speed right_early_speed_mean right_late_speed_mean left_n_observed left_n_interpolated left_n_valid
    left_frac_observed left_frac_interpolated left_frac_valid left_mean_speed left_max_speed left_mean_accel_magnitude left_max_accel_magnitude
    left_path_length left_nx_range left_ny_range left_mean_neck_distance left_angle_mean left_angle_std left_time_to_peak_speed left_early_speed_mean
    left_late_speed_mean n_both_hands frac_both_hands mean_pair_separation max_pair_separation mean_mirror_error_x mean_mirror_error_y
    time_to_peak_pair_separation
"""
SEQUENCE_TABLE_MORE = """
    right_speed_min right_speed_p05 right_speed_p25 right_speed_p50 right_speed_p75 right_speed_p95 right_speed_max right_speed_std
    right_accel_magnitude_min right_accel_magnitude_p05 right_accel_magnitude_p25 right_accel_magnitude_p50 right_accel_magnitude_p75
    right_accel_magnitude_p95 right_accel_magnitude_max right_accel_magnitude_std right_jerk_magnitude_min right_jerk_magnitude_p05
    right_jerk_magnitude_p25 right_jerk_magnitude_p50 right_jerk_magnitude_p75 right_jerk_magnitude_p95 right_jerk_magnitude_max right_jerk_magnitude_std
    right_neck_distance_min right_neck_distance_p05 right_neck_distance_p25 right_neck_distance_p50 right_neck_distance_p75 right_neck_distance_p95
    right_neck_distance_max right_neck_distance_std right_nx_min right_nx_max right_nx_std right_ny_min right_ny_max right_ny_std right_reversals_x
    right_reversals_y right_reversals_radial right_reversals_per_s right_hull_area right_ellipse_area right_bbox_area right_cv_speed right_mean_over_max
    right_t_peak_rel right_early_late_speed_ratio right_speed_skew right_speed_kurtosis right_frac_speed_gt_0p5 right_frac_speed_gt_1p0
    right_frac_speed_gt_2p0 right_speed_sq_mean right_speed_sq_sum right_n_speed right_longest_moving_s left_speed_min left_speed_p05 left_speed_p25
    left_speed_p50 left_speed_p75 left_speed_p95 left_speed_max left_speed_std left_accel_magnitude_min left_accel_magnitude_p05 left_accel_magnitude_p25
    left_accel_magnitude_p50 left_accel_magnitude_p75 left_accel_magnitude_p95 left_accel_magnitude_max left_accel_magnitude_std left_jerk_magnitude_min
    left_jerk_magnitude_p05 left_jerk_magnitude_p25 left_jerk_magnitude_p50 left_jerk_magnitude_p75 left_jerk_magnitude_p95 left_jerk_magnitude_max
    left_jerk_magnitude_std left_neck_distance_min left_neck_distance_p05 left_neck_distance_p25 left_neck_distance_p50 left_neck_distance_p75
    left_neck_distance_p95 left_neck_distance_max left_neck_distance_std left_nx_min left_nx_max left_nx_std left_ny_min left_ny_max left_ny_std
    left_reversals_x left_reversals_y left_reversals_radial left_reversals_per_s left_hull_area left_ellipse_area left_bbox_area left_cv_speed
    left_mean_over_max left_t_peak_rel left_early_late_speed_ratio left_speed_skew left_speed_kurtosis left_frac_speed_gt_0p5 left_frac_speed_gt_1p0
    left_frac_speed_gt_2p0 left_speed_sq_mean left_speed_sq_sum left_n_speed left_longest_moving_s cos_phase_mean cos_phase_median cos_phase_std
    cos_phase_p05 cos_phase_p95 frac_cos_gt_0p8 frac_cos_lt_m0p2 n_cos_phase coactivity_frac_0p5 coactivity_frac_1p0 coactivity_bout_n
    coactivity_bout_mean_s coactivity_bout_max_s mirror_error_x_std mirror_error_y_std abs_y_pair_sum_mean pair_elevation_mean bbox_area_wrists
"""
LABEL_FIELDS = ("indoor_outdoor", "show_type", "hands_free", "sitting_standing", "screen_interaction", "sex", "age")

# End of the fixed values.

FRAME_COLUMNS = tuple(FRAME_TABLE.split())
EXTENDED_FRAME_COLUMNS = FRAME_COLUMNS + tuple(FRAME_TABLE_MORE.split())
SEQUENCE_COLUMNS = tuple(SEQUENCE_TABLE.split())
EXTENDED_SEQUENCE_COLUMNS = SEQUENCE_COLUMNS + tuple(SEQUENCE_TABLE_MORE.split())
