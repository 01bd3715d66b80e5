"""Development-finance flow analytics on Spark DataFrames.

Every operator takes and returns a lazy ``DataFrame`` so that it chains with
``DataFrame.transform``; nothing collects to the driver and no Python UDF is used.
"""

from fluxbook.settings import FlowSettings

__all__ = ["FlowSettings"]
