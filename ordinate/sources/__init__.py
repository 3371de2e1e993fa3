"""Sources and sinks: generated rows, literal rows, run files."""
