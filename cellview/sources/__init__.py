"""Reading, writing, sampling and generating tables."""
