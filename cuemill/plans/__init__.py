"""Whole jobs, from input tables to results, chained from the operators."""
