"""Column-level building blocks: random draws, text damage, time formats, value lists."""
