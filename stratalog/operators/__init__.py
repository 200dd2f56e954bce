"""Operators on operation logs, runs and sketches."""
