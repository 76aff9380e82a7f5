"""Segmentation analytics on Spark: sources, boundary operators, metrics, plans and streams."""
