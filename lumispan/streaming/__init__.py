"""Ordered state: edit logs, cameras and rates."""
