"""Scenario grids, threshold sweeps and reports."""
