"""Query plans bound to the driver's tables."""
