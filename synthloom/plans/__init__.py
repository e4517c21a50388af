"""Driver-side planning: specs, their compilation to columns, drift edits and fault plans."""
