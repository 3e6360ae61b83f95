"""shieldline — prompt-screening analytics as Spark jobs.

Text normalisation, injection scoring, rule matching, model fusion and
enrichment run as column expressions over DataFrames; log analytics, review
and retraining run as aggregations, windows and joins; Structured Streaming
runs the same functions incrementally.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python UDFs defined in this package are pickled by value, so
    executors need not have the package installed (or on their path)."""
    import sys

    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older pyspark: rely on --py-files
        pass


_ship_by_value()
