"""tesselle: a PySpark engine for building and judging contiguous spatial partitions."""
