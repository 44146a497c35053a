"""Multi-version key-value operators over versioned rows."""
