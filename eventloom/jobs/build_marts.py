"""Load event files into the raw table, build staging and daily mart, run the checks.

Ends with an error if a check of severity error fails.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from eventloom.plans import quality
from eventloom.plans.incremental import materialize_table, materialize_view
from eventloom.plans.marts import fct_daily_revenue, latest_mart_rows, stg_events
from eventloom.session import configure
from eventloom.sources.events import EVENT_NAMES, PLATFORMS
from eventloom.sources.load import load_raw_events, read_loaded


def layer_checks(raw: DataFrame, staged: DataFrame, mart: DataFrame) -> list[DataFrame]:
    """Summaries of the declared checks of the three layers."""
    required = [quality.not_null_check(c) for c in ("event_time", "user_id", "event_name")]
    return [
        quality.run_checks(
            raw, [*required, quality.accepted_values_check("event_name", EVENT_NAMES)]
        ),
        quality.run_checks(staged, required),
        quality.run_checks(
            mart,
            [
                quality.not_null_check("event_date"),
                quality.not_null_check("platform"),
                quality.accepted_values_check("platform", PLATFORMS),
            ],
        ),
    ]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--events", required=True, help="event files")
    parser.add_argument("--warehouse", required=True, help="folder of the tables")
    parser.add_argument("--load", required=True, help="name of this load; a repeat replaces it")
    args = parser.parse_args(argv)
    spark = configure(SparkSession.builder.appName("build-marts").getOrCreate())
    raw_path = f"{args.warehouse}/events"
    rejects = f"{args.warehouse}/rejects"
    load_raw_events(spark.read.parquet(args.events), raw_path, rejects, args.load)
    raw = read_loaded(spark, raw_path)
    staged = materialize_view(stg_events(raw), "stg_events")
    mart = materialize_table(fct_daily_revenue(staged), f"{args.warehouse}/fct_daily_revenue")
    failed = []
    for summary in layer_checks(raw, staged, mart):
        summary.show(truncate=False)
        failed += [r["test"] for r in summary.where("status = 'fail'").collect()]
    latest_mart_rows(mart).show(truncate=False)
    if failed:
        raise SystemExit(f"failed checks: {', '.join(failed)}")


if __name__ == "__main__":
    main()
