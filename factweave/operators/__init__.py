"""operators of the fact-graph engine."""
