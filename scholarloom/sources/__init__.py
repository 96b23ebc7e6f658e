"""Landing and normalising raw payload tables."""
