"""Whole workflows: prepare a dataset, and the registered queries with their SQL twins."""
