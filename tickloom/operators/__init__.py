"""Operators on keyed, time-ordered DataFrames."""
