"""pipewright: event pipeline operations on Spark.

Schema registry, validate-and-route, dead letter queue, consumer lag and
pipeline topology as DataFrame-to-DataFrame operators, in batch and with
Structured Streaming. See README.md.
"""

__version__ = "0.1.0"
