"""Consolidation of property-sale reports from many sources, as Spark jobs."""
