"""Sources and sinks: CSV ingest, the hourly test series, label/note JSON files, exports."""
