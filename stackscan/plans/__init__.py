"""End-to-end scans and the registered queries over the test tables."""
