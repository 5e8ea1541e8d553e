"""slimwire: Spark jobs that normalize, count, reduce and analyse logs of LLM chat requests.

Every operator is a DataFrame -> DataFrame function; nothing runs on the driver
beyond building plans. See README.md for the module map.
"""

__version__ = "0.1.0"
