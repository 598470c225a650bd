"""Column -> Column functions; everything runs inside the JVM unless noted."""
