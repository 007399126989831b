"""Data-skipping indexes and data-preparation operators on Spark DataFrames."""

from siftlake.index import Const, DataFrameIndexManager, IndexConf, IndexedDataFrame, QueryContext

__all__ = ["Const", "DataFrameIndexManager", "IndexConf", "IndexedDataFrame", "QueryContext"]
