"""Raster, mask and vector analytics on Spark DataFrames."""
from .session import get_session, materialize

__all__ = ["get_session", "materialize"]
__version__ = "0.1.0"
