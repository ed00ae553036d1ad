"""Registered queries of the engine's own operators, over records made of the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hustings.functions.core import tidy
from hustings.operators import corpus, duplicates, fusion, off_hours, ordering, organisations, periodicity, profile, rare, registry_match, report, triage, windows
from hustings.oracles import ORACLES
from hustings.oracles_triage import ORACLES as TRIAGE_ORACLES
from hustings.plans.catalog import Catalog
from hustings.sources.adapters import hearing_catalog, surge_catalog, test_catalog

Query = Callable[[SparkSession, str], DataFrame]

TABLES: dict[str, Callable[[Catalog], DataFrame]] = {
    "pr1_counts_per_minute": profile.counts_per_minute,
    "pr2_name_frequency": profile.name_frequency,
    "pr3_counts_per_hour": profile.counts_per_hour,
    "pr4_basic_quality": profile.basic_quality,
    "pr5_name_text_features": profile.name_text_features,
    "pr6_bucket_profiles": profile.bucket_profiles,
    "pr7_day_hour_profiles": profile.day_hour_profiles,
    "pr8_name_lengths": profile.name_lengths,
    "de1_top_repeated_names": duplicates.top_repeated_names,
    "de2_repeated_same_bucket": duplicates.repeated_same_bucket,
    "de3_repeated_same_minute": duplicates.repeated_same_minute,
    "de4_position_switching_names": duplicates.position_switching_names,
    "de5_repeated_same_bucket_summary": duplicates.repeated_same_bucket_summary,
    "dn1_candidate_blocks": duplicates.candidate_blocks,
    "dn2_skipped_blocks": duplicates.skipped_blocks,
    "dn3_similarity_edges": duplicates.similarity_edges,
    "dn4_cluster_members": duplicates.cluster_members,
    "dn5_cluster_summary": duplicates.cluster_summary,
    "dn6_cluster_time_concentration": duplicates.cluster_time_concentration,
    "dn7_cluster_time_concentration_summary": duplicates.cluster_time_concentration_summary,
    "or1_organization_counts": organisations.organization_counts,
    "or2_organization_minute_bursts": organisations.organization_minute_bursts,
    "or3_blank_rate_by_bucket": organisations.blank_rate_by_bucket,
    "or4_blank_rate_by_bucket_position": organisations.blank_rate_by_bucket_position,
    "or5_blank_rate_summary": organisations.blank_rate_summary,
    "rn1_singleton_names": rare.singleton_names,
    "rn2_name_windows": rare.name_windows,
    "rn3_unique_ratio_windows": rare.unique_ratio_windows,
    "rn4_weird_names": rare.weird_names,
    "rn5_rarity_by_bucket": rare.rarity_by_bucket,
    "rn6_rarity_high_windows": rare.rarity_high_windows,
    "rn7_rarity_top_records": rare.rarity_top_records,
    "rn8_rarity_lookup_coverage": rare.rarity_lookup_coverage,
    "rn9_unmatched_first_tokens": rare.rarity_unmatched_first_tokens,
    "rn10_unmatched_last_tokens": rare.rarity_unmatched_last_tokens,
    "pe1_autocorr": periodicity.autocorr,
    "pe2_autocorr_significant": periodicity.autocorr_significant,
    "pe3_spectrum_top": periodicity.spectrum_top,
    "pe4_spectrum_significant": periodicity.spectrum_significant,
    "pe5_null_distribution": periodicity.null_distribution,
    "pe6_clockface_distribution": periodicity.clockface_distribution,
    "pe6_clockface_test": periodicity.clockface_test,
    "pe7_clockface_top_minutes": periodicity.clockface_top_minutes,
    "pe8_clockface_null": periodicity.clockface_null,
    "pe9_rolling_fano": periodicity.rolling_fano,
    "pe10_rolling_fano_summary": periodicity.rolling_fano_summary,
    "bu1_burst_windows": windows.burst_windows,
    "bu1_burst_window_tests": windows.burst_window_tests,
    "bu2_burst_significant_windows": windows.burst_significant_windows,
    "bu3_burst_null_distribution": windows.burst_null_distribution,
    "bu4_burst_calibrated_windows": windows.burst_calibrated_windows,
    "bu6_hourly_rates": windows.hourly_rates,
    "bu6_day_hour_rates": windows.day_hour_rates,
    "bu7_burst_summary": windows.burst_summary,
    "ps1_swing_windows": windows.swing_windows,
    "ps1_swing_window_tests": windows.swing_window_tests,
    "ps2_swing_significant_windows": windows.swing_significant_windows,
    "ps3_swing_null_distribution": windows.swing_null_distribution,
    "ps3_swing_calibrated_windows": windows.swing_calibrated_windows,
    "ps4_pro_rate_by_hour": windows.pro_rate_by_hour,
    "ps5_time_bucket_bands": windows.time_bucket_bands,
    "ps5_time_bucket_profiles": windows.time_bucket_profiles,
    "ps6_time_of_day_bands": windows.time_of_day_bands,
    "ps6_time_of_day_bucket_profiles": windows.time_of_day_bucket_profiles,
    "ps7_day_bucket_bands": windows.day_bucket_bands,
    "ps7_day_bucket_profiles": windows.day_bucket_profiles,
    "ps9_direction_runs": windows.direction_runs,
    "ps10_direction_runs_summary": windows.direction_runs_summary,
    "oh1_off_hours_totals": off_hours.off_hours_totals,
    "oh2_hourly_distribution": off_hours.hourly_distribution,
    "oh3_hour_of_week_distribution": off_hours.hour_of_week_distribution,
    "oh4_date_hour_distribution": off_hours.date_hour_distribution,
    "oh5_window_limits": off_hours.window_limits,
    "oh5_day_alerts": off_hours.day_alerts,
    "oh5_window_control_profile": off_hours.window_control_profile,
    "oh6_date_hour_residuals": off_hours.date_hour_residuals,
    "oh7_model_fit_diagnostics": off_hours.model_fit_diagnostics,
    "oh8_flag_channel_summary": off_hours.flag_channel_summary,
    "oh9_flagged_windows": off_hours.flagged_windows,
    "oh10_alert_runs": off_hours.alert_runs,
    "so1_sortedness_metrics": ordering.sortedness_metrics,
    "so2_bucket_ordering": ordering.bucket_ordering,
    "so3_bucket_ordering_summary": ordering.bucket_ordering_summary,
    "so4_minute_ordering": ordering.minute_ordering,
    "vr0_assignments": registry_match.assignments,
    "vr1_match_overview": registry_match.match_overview,
    "vr2_match_by_position": registry_match.match_by_position,
    "vr3_match_by_bucket": registry_match.match_by_bucket,
    "vr4_match_by_bucket_position": registry_match.match_by_bucket_position,
    "vr5_matched_names": registry_match.matched_names,
    "vr6_unmatched_names": registry_match.unmatched_names,
    "vr7_match_tier_summary": registry_match.match_tier_summary,
    "vr8_match_uncertainty_summary": registry_match.match_uncertainty_summary,
    "vr9_exact_by_position": registry_match.exact_by_position,
    "cp1_volume_changepoints": fusion.volume_changepoints,
    "cp2_pro_rate_changepoints": fusion.pro_rate_changepoints,
    "cp3_all_changepoints": fusion.all_changepoints,
    "mv1_anomaly_features": fusion.anomaly_features,
    "mv2_bucket_anomaly_scores": fusion.bucket_anomaly_scores,
    "mv3_top_bucket_anomalies": fusion.top_bucket_anomalies,
    "mv4_robust_features": fusion.robust_features,
    "co0_base_signals": fusion.base_signals,
    "co1_ranked_windows": fusion.ranked_windows,
    "co2_high_priority_windows": fusion.high_priority_windows,
    "co3_evidence_bundle_windows": fusion.evidence_bundle_windows,
    "qu1_raw_vs_dedup_metrics": report.raw_vs_dedup_metrics,
    "qu2_data_quality_warnings": report.data_quality_warnings,
    "hc1_stance_by_deadline": report.stance_by_deadline,
    "hc2_deadline_ramp_metrics": report.deadline_ramp_metrics,
    "tr10_lens_comparison": report.lens_comparison,
    "hc3_hearing_markers": report.hearing_markers,
    "fv1_day_vectors": report.day_vectors,
    "fv2_global_baselines": report.global_baselines,
    "fv2_name_cues": report.name_cues,
    "ch2_burst_significance_by_window": report.burst_significance_by_window,
    "ch2_burst_ratio_by_window": report.burst_ratio_by_window,
    "ch3_changepoints_by_hour": report.changepoints_by_hour,
    "ch3_cluster_size_histogram": report.cluster_size_histogram,
    "ch3_evidence_flag_counts": report.evidence_flag_counts,
    "ch1_changepoint_timeline": report.changepoint_timeline,
    "ch1_composite_timeline": report.composite_timeline,
    "ch5_day_slot_heat": report.day_slot_heat,
    "ch5_rolling_pro_rate": report.rolling_pro_rate,
}

#: Over records with surges, so that detectors find something.
SURGES: dict[str, Callable[[Catalog], DataFrame]] = {
    "bu2_burst_significant_windows_surge": windows.burst_significant_windows,
    "ps2_swing_significant_windows_surge": windows.swing_significant_windows,
    "rn1_singleton_names_surge": rare.singleton_names,
    "tr5_contract_violations": triage.contract_violations,
    "tr6_window_evidence_queue": triage.window_evidence_queue,
    "tr6_statistical_queue": triage.statistical_queue_raw,
    "tr7_record_evidence_queue": triage.record_evidence_queue,
    "tr8_cluster_evidence_queue": triage.cluster_evidence_queue,
    "tr9_triage_summary": triage.triage_summary,
    "tr10_queue_exact_row_dedup": triage.statistical_queue_dedup,
    "tr10_lenses_side_by_side": triage.lenses_side_by_side,
    "tr10_lens_summary": triage.lens_summary,
    "tr11_score_breakdown": triage.score_breakdown,
    "fv1_report_vector": corpus.report_vector,
    "tr12_window_measures": triage.window_measures,
    "tr13_window_cluster_overlaps": triage.window_cluster_overlaps,
}

#: Over records of a hearing whose times are all given.
HEARINGS: dict[str, Callable[[Catalog], DataFrame]] = {"hc3_process_markers": report.hearing_markers, "n9_hearing_minutes": report.hearing_minutes}


def _query(build: Callable[[Catalog], DataFrame], catalog: Callable[[SparkSession, str], Catalog] = test_catalog) -> Query:
    return lambda spark, sf_dir: tidy(catalog(spark, sf_dir).get(build))


QUERIES: dict[str, Query] = {name: _query(build) for name, build in TABLES.items()} | {name: _query(build, surge_catalog) for name, build in SURGES.items()} | {name: _query(build, hearing_catalog) for name, build in HEARINGS.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, sql in (ORACLES | TRIAGE_ORACLES).items() if name in QUERIES}
