"""Whole queries put together from operators, over the driver's tables."""
