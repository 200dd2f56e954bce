"""Versioned key/value operation logs as DataFrames: state, scans, runs, sketches, limits."""
