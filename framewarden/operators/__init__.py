"""Sequence, interval and lag operators over DataFrames."""
