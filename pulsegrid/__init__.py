"""PulseGrid: windowed-signal analytics on Spark DataFrames."""
