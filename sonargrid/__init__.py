"""Sonargrid: sampled multi-channel recordings, their metadata and markers as Spark DataFrames."""

__version__ = "0.1.0"
