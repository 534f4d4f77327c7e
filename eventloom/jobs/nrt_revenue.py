"""Near-real-time revenue: from a counter or Kafka to the console, a table or JDBC.

The table keeps versions and exact buyers. The console shows buyers by sketch. JDBC
receives the new totals of changed groups, so its table must keep the last version
per (window_start, platform) by updated_at.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from eventloom.session import configure
from eventloom.sinks.jdbc import write_jdbc
from eventloom.sinks.streams import console_sink
from eventloom.sources.streams import kafka_events, rate_events
from eventloom.streaming.nrt import nrt_revenue_1m, nrt_stream


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--source", choices=["rate", "kafka"], default="rate")
    parser.add_argument("--sink", choices=["console", "table", "jdbc"], default="console")
    parser.add_argument("--checkpoint", required=True)
    parser.add_argument("--trigger", default="10 seconds")
    parser.add_argument("--rows-per-second", type=int, default=50)
    parser.add_argument("--bootstrap", default="localhost:9092")
    parser.add_argument("--topic", default="events")
    parser.add_argument("--table", help="folder of the versioned table (table and jdbc)")
    parser.add_argument("--jdbc-url")
    parser.add_argument("--jdbc-table", default="revenue_1m_nrt")
    parser.add_argument("--jdbc-user")
    parser.add_argument("--jdbc-password")
    args = parser.parse_args(argv)
    if args.sink != "console" and not args.table:
        parser.error("--table is needed by this sink")
    if args.sink == "jdbc" and not args.jdbc_url:
        parser.error("--jdbc-url is needed by this sink")
    return args


def start(spark: SparkSession, args: argparse.Namespace) -> StreamingQuery:
    if args.source == "kafka":
        events = kafka_events(spark, args.bootstrap, args.topic)
    else:
        events = rate_events(spark, args.rows_per_second)
    trigger = {"processingTime": args.trigger}
    if args.sink == "console":
        return console_sink(nrt_revenue_1m(events, exact=False), args.checkpoint, trigger)
    emit = None
    if args.sink == "jdbc":
        login = {"user": args.jdbc_user, "password": args.jdbc_password}
        properties = {k: v for k, v in login.items() if v is not None}

        def emit(totals: DataFrame, batch_id: int) -> None:
            write_jdbc(totals, args.jdbc_url, args.jdbc_table, properties)

    return nrt_stream(events, args.table, args.checkpoint, trigger, emit)


def main(argv: list[str] | None = None) -> None:
    spark = configure(SparkSession.builder.appName("nrt-revenue").getOrCreate())
    start(spark, parse(argv)).awaitTermination()


if __name__ == "__main__":
    main()
