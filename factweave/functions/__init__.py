"""functions of the fact-graph engine."""
