"""Jobs chained end to end."""
