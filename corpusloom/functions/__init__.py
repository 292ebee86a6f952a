"""Column expressions and driver-side scalar helpers."""

from corpusloom.functions.scalars import (
    attention_mask,
    checkpoint_name,
    eval_file_name,
    label_mask,
    pad_to,
    python_round,
    run_name,
    source_of_path,
    source_of_top,
    tokens_checksum,
)

__all__ = [
    "attention_mask",
    "checkpoint_name",
    "eval_file_name",
    "label_mask",
    "pad_to",
    "python_round",
    "run_name",
    "source_of_path",
    "source_of_top",
    "tokens_checksum",
]
