"""Operators on ticks, bars, labels and logs."""
