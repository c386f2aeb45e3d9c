"""kpimart.streaming."""
