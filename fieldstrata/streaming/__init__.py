"""The label stream."""
