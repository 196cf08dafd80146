"""Streams: state by key, and windows by silence."""
