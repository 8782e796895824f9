"""Analytics over versioned, content-addressed directory trees, written for Spark."""
