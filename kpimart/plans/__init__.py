"""kpimart.plans."""
