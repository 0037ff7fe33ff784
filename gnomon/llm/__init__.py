"""Operators of a training-data pipeline. Nothing outside this subpackage and its tests imports it."""
