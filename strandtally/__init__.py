"""Strand-neutral k-mer abundance on Spark: exact counts, a blocked counting sketch, spectra and reports."""

from strandtally.config import ConfigError, SketchConfig

__all__ = ["ConfigError", "SketchConfig"]
