"""Overrides as a stream of events. An addition of this package: what it models has no streaming."""
