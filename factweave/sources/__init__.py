"""sources of the fact-graph engine."""
