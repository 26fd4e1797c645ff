"""Continuous loading of turn logs."""
