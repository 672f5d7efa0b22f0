"""Column functions."""

from tideglass.functions.scalar import (
    average_path_length,
    batch_id,
    batch_round,
    deviation_signal,
    ewma_bound,
    hoeffding_bound,
    java_hash,
    ks_confirm_threshold,
    ks_threshold,
    parse_exp_id,
    parse_extra,
    shard_of,
    uniform,
)

__all__ = ["average_path_length", "batch_id", "batch_round", "deviation_signal", "ewma_bound", "hoeffding_bound", "java_hash", "ks_confirm_threshold", "ks_threshold", "parse_exp_id", "parse_extra", "shard_of", "uniform"]
