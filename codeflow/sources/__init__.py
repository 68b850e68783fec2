"""Sources and sinks: source files, snapshots, reports."""
