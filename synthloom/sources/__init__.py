"""Sources and sinks: synthetic tables and streams, prepared rows, datasets, topics."""
