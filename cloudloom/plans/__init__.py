"""The class table, the thresholds, the end-to-end plan and the registered queries."""
