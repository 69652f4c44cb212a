"""DataFrame operators: mapping, roll-up, corrections, page geometry, folds, blocks, control tables."""
