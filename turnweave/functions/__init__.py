"""Column functions: times, labels, texts."""
