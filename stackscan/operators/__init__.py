"""DataFrame operators: evidence, matching, roll-up, history, quality."""
