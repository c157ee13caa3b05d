"""plans of the fact-graph engine."""
