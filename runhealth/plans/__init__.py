"""Compositions of operators, and the query catalogue over the test tables."""
