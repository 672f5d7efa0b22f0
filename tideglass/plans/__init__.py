"""Experiment plans."""
