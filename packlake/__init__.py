"""Analytics over corpora of zipped XML document packages, as Spark jobs."""

from packlake.limits import SCREEN, Limits

__all__ = ["SCREEN", "Limits"]
