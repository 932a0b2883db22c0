"""Standing queries over streams of changed datasets."""
