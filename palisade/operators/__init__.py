"""DataFrame operators: retrieval, metrics, history, agents."""
