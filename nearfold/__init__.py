"""Distributed k-nearest-neighbour joins and the learning built on them, as PySpark DataFrame operators."""
