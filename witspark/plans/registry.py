"""Registry of the queries by name, with the SQL each is checked against."""

from __future__ import annotations

from witspark.sources.tables import check_events

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame callable; `{EV}` in `sql` is the event table."""

    def add(build):
        def run(spark, sf_dir):
            # The tables hold UTC wall-clock times without a zone.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, sf_dir)

        run.__doc__ = build.__doc__
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.replace("{EV}", check_events())
        return build

    return add


def load() -> None:
    """Import every module that registers queries."""

    import importlib

    for module in (
        "sources",
        "ingest",
        "redaction",
        "integrity",
        "projection",
        "detection",
        "contracts",
        "observers",
        "corpus",
        "reports",
        "exports",
        "streams",
    ):
        importlib.import_module(f"witspark.plans.{module}")
