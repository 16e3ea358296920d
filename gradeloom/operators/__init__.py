"""DataFrame-to-DataFrame operators: positions, splits, reports, runs, weights."""
