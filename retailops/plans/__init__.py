"""Query plans: the registered keys (``catalog``) and their SQL oracles."""
