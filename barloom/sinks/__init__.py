"""Writers of raw partitions, price datasets and result files."""
