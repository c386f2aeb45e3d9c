"""kpimart.operators."""
