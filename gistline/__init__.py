"""gistline: reduce, learn from, judge and account for captured text output, on Spark.

The public surface is DataFrame -> DataFrame functions:

``functions``  column expressions (text, regex, fingerprint, redaction, JSON, formats)
``operators``  jobs over lines, sessions, events, samples and profiles
``plans``      composed pipelines: reduce, judge, learn, and the registered queries
``sources``    reading and writing session tables, the bundled rule sets, sealing
``streaming``  Structured Streaming twins of the incremental jobs
"""

__version__ = "0.1.0"
