"""Operators for the preparation of training data.

Nothing outside this folder imports it; ``queries`` and ``oracles`` are picked up by the driver entry if
the folder is there.
"""
