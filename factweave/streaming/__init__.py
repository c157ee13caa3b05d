"""streaming of the fact-graph engine."""
