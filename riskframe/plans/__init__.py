"""Composed pipelines: training frame and feature stores."""
