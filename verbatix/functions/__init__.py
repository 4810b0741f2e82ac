"""Part of the text-diagnostics engine."""
