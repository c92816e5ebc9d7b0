"""Query catalogue over the operators."""
