"""Spatial and borehole analytics on Spark."""
