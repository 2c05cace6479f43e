"""Arriving manifests: an extension, for batch analyses need none of it."""
