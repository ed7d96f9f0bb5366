"""DataFrame operators: hits and domains, matching, labels and splits, metrics."""
