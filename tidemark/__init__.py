"""tidemark: customer-retention analytics as Spark DataFrame jobs.

Raw tables -> staging -> feature and risk marts -> chart queries, scoring,
survival, drift and text checks, all expressed over whole tables with an
explicit ``as_of`` date.
"""

__version__ = "0.1.0"
