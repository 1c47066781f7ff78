"""larder: versioned key-value stores, request replay and application descriptors on Spark."""
