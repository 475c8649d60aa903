"""Media timelines, samples and containers as DataFrames."""
