"""riskloom: portfolio-wide due-diligence and risk analytics on Spark.

Every operator takes DataFrames and returns a lazy DataFrame; nothing is
collected to the driver except small, size-checked parameter tables.
"""

__version__ = "0.1.0"
