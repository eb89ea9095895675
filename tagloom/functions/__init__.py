"""Part of the event engine."""
