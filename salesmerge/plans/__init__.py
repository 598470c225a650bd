"""End-to-end plans and the views that feed them from the test tables."""
