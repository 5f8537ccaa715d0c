"""User-level operators. Every one takes DataFrames and returns DataFrames."""

from .climate import (
    annual_climate,
    annual_evaporation,
    annual_precipitation,
    annual_temperature,
    climate_files_merge,
    climate_folder,
    climate_wide_to_long,
    peak_snow,
    snow_disappearance,
    two_digit_year_fix,
)
from .daily import fill_daily_columns, fill_daily_gaps, interpolated_runs, missing_day_sites, resolve_long_gaps, sample_overlay
from .estimate import concentration_surface, daily_from_surface, estimate_errors, fit_surface, held_out_estimates, residual_bridge
from .explain import mean_abs_shap, shap_dependence, shapley_sampling, site_mean_filter
from .forest import exact_forest, out_of_bag_residuals, train_test_errors
from .harmonise import harmonise, model_frame
from .landscape import (
    backfill_maps,
    backfill_series,
    basin_attribute,
    class_maps,
    class_proportions,
    climate_zone_lookup,
    complete_composition,
    geology_proportions,
    sentinel_to_null,
    sites_per_zone,
)
from .lowflow import (
    annual_baseflow,
    baseflow_out_of_range,
    complete_water_years,
    driest_year_tally,
    in_range_sites,
    low_flow_normalised,
    low_flow_q5,
    site_year_stats,
)
from .model import forest_fit, forest_importance, forest_residuals, train_test_eval
from .report import (
    driver_correlation,
    driver_histograms,
    flow_condition,
    improvement_by_zone_flow,
    poor_residual_means,
    record_grid,
    relative_improvement,
    residual_class_counts,
    residual_classes,
    site_improvement,
    site_profile,
    snow_aridity_residual,
    zone_class_shares,
)
from .screening import (
    final_record_filter,
    model_window_inputs,
    record_summary,
    sample_segments,
    segment_classes,
    site_screen_coavailable,
    site_screen_continuity,
    site_screen_counts,
)
from .separation import baseflow_separation, end_members
from .storage import flashiness_index, recession_points, recession_slope, storage_drawdown
