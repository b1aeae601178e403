"""Evaluation analytics as Spark DataFrame operators.

The names below are the library's public list; each is imported from its module when it is first asked for.
"""

from importlib import import_module

_WHERE = {
    "functions.exprs": ["block_from_key", "parse_key", "resolve_key", "safe_element_id", "window_id", "challenge_id", "sample_block", "sample_commit", "rtf", "rtf_gate", "economic_score", "element_category", "adaptive_delta", "match_percentage", "box_iou", "adaptive_iou_bar", "time_decay", "exact_match", "numeric_match", "prediction_problem", "record_hash", "truth_type"],
    "operators.select": ["tail_filter", "latest_commit_filter", "latest_commit_for_element", "latest_validator_index", "exclude", "exclude_blacklist", "element_keys", "prior_scored", "with_uids", "extract_scores", "dedup_by_model_revision", "registry_select", "repo_facts", "latest_private_commit", "common_history", "mark_weak_quads", "weak_quads", "as_of", "warmup_trim", "sample", "audit_candidates", "historical_sample", "window_shard_dedup"],
    "operators.match": ["greedy_match", "compare_outputs", "comparison_verdicts", "soft_drift", "optimal_pairs", "frame_f1", "union_area", "set_iou", "polygon_area_iou", "polygon_iou", "label_modes", "project_truth", "project_shapes", "both_pairs"],
    "operators.metrics": ["register_metric", "register_shared", "element_pillars", "pillar_catalog", "precision_recall", "average_precision", "per_class_report", "mean_average_precision"],
    "operators.aggregate": ["mean_by_miner", "mode_commit", "challenge_map", "clip_means", "inactive_miners", "median", "p95_index", "values_at", "weighted_median"],
    "operators.rank": ["top_rows", "provisional_winner", "tiebreak", "final_routing", "ranked_shares", "allocate_weights", "ewma"],
    "functions.raster": ["raster", "mask_overlap", "shape_iou"],
    "sources.shards": ["append_shards", "read_tail", "write_by_day"],
    "operators.audit": ["audit_export", "merge_failed_tuples", "target_status", "compact_index", "rescored"],
    "plans.winner": ["eligible_rows", "winners", "window_weights"],
    "streaming.ops": ["tumbling_scores", "sliding_scores", "sliding_scores_stream", "dedup_stream", "ewma_stream", "streak_stream", "warmup_stream", "upsert_writer", "read_upserts"],
}
_MODULE = {name: module for module, names in _WHERE.items() for name in names}
__all__ = sorted(_MODULE)


def __getattr__(name: str):
    if name not in _MODULE:
        raise AttributeError(name)
    return getattr(import_module(f".{_MODULE[name]}", __name__), name)
