"""kpimart.sources."""
