"""DataFrame operators: behaviour, correlation, signals, confidence, blocks, store and graph."""
