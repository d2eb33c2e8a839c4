"""Scans, sinks, manifests and the seams to networks."""
