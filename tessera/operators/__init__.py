"""Operators on tables of MCUs, blocks, samples, pixels and tiles."""
