"""Spark tables of one-dimensional signals: perturb, measure, align with task harm."""
