"""Operators of a training-data pipeline, each by one stated method.

Nothing outside this package imports it. See the README for the list, the methods and
the measured figures.
"""
