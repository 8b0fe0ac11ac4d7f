"""Whole studies: the regression grid, the mediation models, and the registered queries."""
