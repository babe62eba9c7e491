"""Sources and sinks: dimension tables, ledger readers/writers, rule files, fixture views."""
