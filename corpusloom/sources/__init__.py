"""Readers of corpora and reports, and writers of every stage's result."""

from corpusloom.sources.readers import (
    MissingSourceError,
    check_sources,
    dataset_manifest,
    file_manifest,
    file_table,
    files_by_folder,
    list_files,
    manifest_difference,
    read_packed,
    read_source,
    read_sources,
    read_split,
    read_text,
    read_token_report,
    scan_report,
)
from corpusloom.sources.writers import (
    append_metrics,
    replace_splits,
    write_config,
    write_eval_results,
    write_json,
    write_mixture,
    write_one_file,
    write_packed,
    write_report,
    write_splits,
)

__all__ = [
    "MissingSourceError",
    "append_metrics",
    "check_sources",
    "dataset_manifest",
    "file_manifest",
    "file_table",
    "files_by_folder",
    "list_files",
    "manifest_difference",
    "read_packed",
    "read_source",
    "read_sources",
    "read_split",
    "read_text",
    "read_token_report",
    "replace_splits",
    "scan_report",
    "write_config",
    "write_eval_results",
    "write_json",
    "write_mixture",
    "write_one_file",
    "write_packed",
    "write_report",
    "write_splits",
]
