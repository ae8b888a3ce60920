"""Operators of a training-data pipeline. Nothing else in loomframe imports this subpackage."""
