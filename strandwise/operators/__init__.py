"""DataFrame operators: statistics, k-mers, orders, alignments, similarity joins and graphs."""
