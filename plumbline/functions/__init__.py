"""Column-level building blocks: detectors, masks, number parsing, text tokens."""
