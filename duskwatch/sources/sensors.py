"""Scans of raw sensor records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.columns import parse_iso_utc
from duskwatch.schemas import EVE_EVENT, HOST_ALERT
from duskwatch.sources.tail import EventTail

# Loose fields are read as text and cast where they are used, so one field of an odd type never costs the record.
_JSON = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def read_host_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Host-sensor alerts, one JSON object per line; bad lines keep their text in ``_corrupt_record``."""
    return spark.read.schema(HOST_ALERT).options(**_JSON).json(path)


def read_network_events(spark: SparkSession, path: str) -> DataFrame:
    """Network-sensor event lines, bad lines included."""
    return spark.read.schema(EVE_EVENT).options(**_JSON).json(path)


def stream_network_events(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """New event files of a folder as a stream of alerts; blank and bad lines are left out. A file that grows is read once: see ``tail_network_events``.

    Starting from now instead of from the first file is ``latestFirst`` with
    ``maxFileAge``, or a start-time filter on the result.
    """
    events = spark.readStream.schema(EVE_EVENT).options(**_JSON, **options).json(folder)
    return events.filter(~unreadable() & (F.col("event_type") == "alert"))


def tail_network_events(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Alerts that are written to a growing event file, or to the files of a folder, from now on (``from="start"``: from their beginning).

    Files are followed by position, through rotation and restarts; blank and bad lines are left out. ``path`` and ``position`` say where a line began.
    """
    spark.dataSource.register(EventTail)
    lines = spark.readStream.format("event_tail").options(path=path, **options).load()
    events = parse_lines(lines, "line", EVE_EVENT)
    return events.filter(~unreadable() & (F.col("event_type") == "alert"))


def unreadable() -> Column:
    """The line is no JSON object. A container of another type (text for an object) also fills ``_corrupt_record``, but the rest of it is read."""
    return F.col("_corrupt_record").isNotNull() & F.json_object_keys("_corrupt_record").isNull()


def parse_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON text already in a table, parsed as the file scans parse it, each line once. Blank lines are dropped.

    The parsed record passes through a generator, over which the optimizer copies no expression, so filters and columns
    above it read the record instead of parsing the line again.
    """
    kept = [c for c in lines.columns if c != column]
    parsed = lines.filter(F.col(column).rlike(r"\S")).select(*kept, F.explode(F.array(F.from_json(F.col(column), schema, _JSON))).alias("r"))
    return parsed.select(*kept, "r.*")


def flow_events(events: DataFrame) -> DataFrame:
    return events.filter(~unreadable() & (F.col("event_type") == "flow"))


def scan_counts(events: DataFrame) -> DataFrame:
    """Flows extracted and lines skipped as unreadable, in one pass."""
    bad = unreadable()
    return events.agg(
        F.count_if(~bad & (F.col("event_type") == "flow")).alias("extracted"), F.count_if(bad).alias("skipped")
    )


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def _flag(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), c.try_cast("boolean").cast("double"), F.lit(0.0))


def flow_features(events: DataFrame, *keep: str) -> DataFrame:
    """The 14 model inputs of a flow and its ``alerted`` flag, all doubles."""
    flow, tcp = F.col("flow"), F.col("tcp")
    span = F.unix_micros(parse_iso_utc(flow["end"]).cast("timestamp")) - F.unix_micros(
        parse_iso_utc(flow["start"]).cast("timestamp")
    )
    base = events.select(
        *keep,
        _number(F.col("dest_port")).alias("destination_port"),
        F.when(span > 0, span / 1e6).otherwise(_number(flow["age"])).alias("duration_seconds"),
        _number(flow["pkts_toserver"]).alias("pkts_to_server"),
        _number(flow["pkts_toclient"]).alias("pkts_to_client"),
        _number(flow["bytes_toserver"]).alias("bytes_to_server"),
        _number(flow["bytes_toclient"]).alias("bytes_to_client"),
        _flag(tcp["syn"]).alias("syn_flag"),
        _flag(tcp["fin"]).alias("fin_flag"),
        _flag(tcp["psh"]).alias("psh_flag"),
        _flag(tcp["ack"]).alias("ack_flag"),
        _flag(flow["alerted"]).alias("alerted"),
    )
    return with_flow_rates(base, *keep)


def with_flow_rates(base: DataFrame, *keep: str) -> DataFrame:
    """Totals and per-second rates (0 for flows without duration) in model order."""
    packets = F.col("pkts_to_server") + F.col("pkts_to_client")
    size = F.col("bytes_to_server") + F.col("bytes_to_client")
    seconds = F.col("duration_seconds")
    return base.select(
        *keep,
        "destination_port",
        "duration_seconds",
        "pkts_to_server",
        "pkts_to_client",
        "bytes_to_server",
        "bytes_to_client",
        packets.alias("total_packets"),
        size.alias("total_bytes"),
        F.when(seconds > 0, packets / seconds).otherwise(0.0).alias("packets_per_second"),
        F.when(seconds > 0, size / seconds).otherwise(0.0).alias("bytes_per_second"),
        "syn_flag",
        "fin_flag",
        "psh_flag",
        "ack_flag",
        "alerted",
    )
