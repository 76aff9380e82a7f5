"""The result tables that a run leaves behind: a file for each, from the query that makes it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from . import sinks
from .catalogue import PLANS

#: Table -> query; a table's columns are the query's.
TABLES = {
    "token_tier": "token_tier_counts", "token_tier_pauses": "tier_stats", "token_tier_gaps": "tier_gaps", "token_classes": "token_classes", "token_class_types": "token_class_types",
    "alignment_summary": "alignment_record", "alignment_offsets": "offset_bins_filled", "unit_comparison": "compare_both_ways", "unit_comparison_window": "compare_in_window", "tier_copies": "tier_copies",
    "phrase_labels": "label_distributions", "files_by_directory": "files_by_directory", "encodings": "encodings_by_directory", "speaker_coverage": "speaker_coverage",
    "capitalisation": "capitalisation_seven", "word_internal_marks": "word_internal_marks", "truncation_position": "truncation_position", "marker_inventory": "marker_scan", "zero_word_units": "zero_word_categories",
    "per_file_stats": "per_doc_stats", "cue_adjacency": "cue_adjacency", "cue_base_rate": "cue_base_rate", "window_scores": "window_local_prf", "window_answers": "window_answers", "position_buckets": "position_bucket_f1",
    "baselines": "random_baseline_100", "baseline_comparison": "a_vs_b_pivot_100", "verdicts": "verdict_vs_baseline_100", "degenerate_windows": "degeneracy_old_new", "collapse": "collapse_metrics", "longest_runs": "longest_runs_top",
    "document_scores": "boundary_prf_doc", "genre_scores": "genre_macro_micro", "excluded_documents": "masked_excluded", "run_comparison": "run_compare_inner", "segment_ratio": "segment_ratio_total", "selection": "decile_selection",
}


def write(spark: SparkSession, sf_dir: str, folder: str, names: Iterable[str] | None = None) -> list[str]:
    """Writes the named tables, or all of them, as CSV with four digits; the paths."""
    out = []
    for name in names or TABLES:
        out.append(f"{folder.rstrip('/')}/{name}")
        sinks.write_csv(sinks.rounded(PLANS[TABLES[name]](spark, sf_dir)), out[-1])
    return out
