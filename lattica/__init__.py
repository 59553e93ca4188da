"""lattica: exact density clustering over parameter grids, Spark first."""

__version__ = "0.1.0"
