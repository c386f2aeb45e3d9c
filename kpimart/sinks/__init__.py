"""kpimart.sinks."""
