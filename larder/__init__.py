"""Demand forecasting and stock replenishment analytics as Spark DataFrame jobs.

Every public function takes DataFrames (and a frozen :class:`~larder.settings.Settings`)
and returns a lazy DataFrame.  Nothing here runs a Spark action unless its docstring says so.
"""

from larder.settings import Settings

__all__ = ["Settings"]
