"""Readers and writers of log folders and result tables."""
from emberlog.sources.readers import (  # noqa: F401
    cap_rows_per_file, large_file_flag, read_allowlist, read_candidates, read_results, scan_json_logs,
    scan_logs, scan_text_logs,
)
from emberlog.sources.writers import (  # noqa: F401
    write_anomalies, write_candidates, write_summary, write_verdict_results,
)
