"""Log files to events: SSH auth logs, web access logs, Windows event tables."""

from __future__ import annotations

import csv
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import schemas as S
from vigil.sources.csvrecords import csv_records, csv_rows

# Fixed patterns: the three kinds of SSH lines, and access log lines.
_STAMP = r"^(\w+)\s+(\d+)\s+(\S+).*"
SSH_FAILED = _STAMP + r"Failed (?:password|publickey) for (?:invalid user )?(\S+) from ([0-9a-fA-F:.]+) port (\d+)"
SSH_ACCEPTED = _STAMP + r"Accepted (?:password|publickey) for (\S+) from ([0-9a-fA-F:.]+) port (\d+)"
SSH_CONNECTION = _STAMP + r"Connection from ([0-9a-fA-F:.]+) port (\d+)"
_MARK = "\x01"
WEB_LINE = r'^(\S+) \S+ \S+ \[([^\]]+)\] "([A-Z]+) (\S+)[^"]*" (\d{3})'
SYSLOG_HEAD = r"^\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2}"

EVENT_COLUMNS = ("log_type", "event_type", "event_time", "source_ip", "username", "port", "raw_line", "tz_offset_s", "source_file", "hostname")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value and source_file of text files."""
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source_file"))


def _file(lines: DataFrame) -> Column:
    return F.col("source_file") if "source_file" in lines.columns else F.lit(None).cast("string")


def parse_ssh(lines: DataFrame, year: int | None = None) -> DataFrame:
    """Events of auth log lines (value); the first of three patterns that matches counts, other lines are left out.

    Lines carry no year: it is a parameter, by default this one, in UTC. A line whose time can't be (such as February 30) is left
    out. Streams work too.
    """
    year = year or datetime.now(UTC).year
    line = F.col("value")

    def parts(kind: str, pattern: str, user: str, ip: str, port: str) -> Column:
        """Kind, month, day, time, user, address and port of a line, by one replacement; null if it doesn't match."""
        fields = _MARK.join((kind, "$1", "$2", "$3", user, ip, port))
        return F.when(F.rlike(line, F.lit(pattern)), F.split(F.regexp_replace(line, F.lit(pattern + "(?s:.*)$"), F.lit(fields)), _MARK, -1))

    found = F.coalesce(parts("failed_login", SSH_FAILED, "$4", "$5", "$6"), parts("successful_login", SSH_ACCEPTED, "$4", "$5", "$6"), parts("connection", SSH_CONNECTION, "", "$4", "$5"))
    p = lambda k: F.get("__p", k)
    stamp = F.concat_ws(" ", F.lit(str(year)), F.substring(p(1), 1, 3), p(2), p(3))
    # exploding a single value keeps the optimiser from repeating the match for each field
    return lines.select("*", F.explode(F.array(found)).alias("__p")).where(F.size("__p") == 7).select(
        F.lit("ssh").alias("log_type"), p(0).alias("event_type"), F.try_to_timestamp(stamp, F.lit("yyyy MMM d HH:mm:ss")).alias("event_time"), p(5).alias("source_ip"), F.nullif(p(4), F.lit("")).alias("username"),
        p(6).try_cast("int").alias("port"), line.alias("raw_line"), F.lit(0).alias("tz_offset_s"), _file(lines).alias("source_file"), F.lit(None).cast("string").alias("hostname"),
    ).where("event_time is not null")


def parse_web(lines: DataFrame) -> DataFrame:
    """Events of common or combined access log lines (value): http_404 or http_request. The line's own offset is kept beside the
    time; a time without offset is UTC."""
    line, stamp = F.col("value"), F.regexp_extract("value", WEB_LINE, 2)
    tail = F.regexp_extract(stamp, r"([+-]\d{2})(\d{2})$", 0)
    minutes = F.substring(tail, 2, 2).cast("int") * 60 + F.substring(tail, 4, 2).cast("int")
    offset = F.when(F.length(tail) > 0, F.when(F.startswith(tail, F.lit("-")), -minutes).otherwise(minutes) * 60).otherwise(0)
    time = F.coalesce(F.try_to_timestamp(stamp, F.lit("dd/MMM/yyyy:HH:mm:ss Z")), F.try_to_timestamp(stamp, F.lit("dd/MMM/yyyy:HH:mm:ss")), F.try_to_timestamp(stamp))
    text = F.lit(None).cast("string")
    return lines.where(F.rlike(line, F.lit(WEB_LINE))).select(
        F.lit("apache_nginx").alias("log_type"), F.when(F.regexp_extract(line, WEB_LINE, 5) == "404", "http_404").otherwise("http_request").alias("event_type"), time.alias("event_time"),
        F.regexp_extract(line, WEB_LINE, 1).alias("source_ip"), text.alias("username"), F.lit(None).cast("int").alias("port"), line.alias("raw_line"), offset.cast("int").alias("tz_offset_s"), _file(lines).alias("source_file"), text.alias("hostname"),
    ).where("event_time is not null")


def windows_columns(header: list[str]) -> dict[str, str | None]:
    """The column for each part of a Windows event, by its accepted names in any case."""
    known = {h.lower().strip(): h for h in header}
    return {part: next((known[n] for n in names if n in known), None) for part, names in S.WINDOWS_COLUMNS.items()}


def parse_windows(rows: DataFrame) -> DataFrame:
    """Events of a Windows event table, all columns text. Rows without a readable time or with an event id that is no number are left
    out; a blank id counts as 0; ports are digits or null; a time without offset is UTC."""
    cols = windows_columns(rows.columns)
    text = lambda part: F.trim(F.col(f"`{cols[part]}`")) if cols[part] else F.lit(None).cast("string")
    blank = lambda c: F.when(F.length(c) > 0, c)
    raw = text("time")
    forms = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "dd/MMM/yyyy:HH:mm:ss Z")
    time = F.coalesce(F.try_to_timestamp(raw), *(F.try_to_timestamp(raw, F.lit(f)) for f in forms))
    sign = F.regexp_extract(raw, r"T?\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*([+-])(\d{2}):?(\d{2})$", 1)
    hours, minutes = (F.regexp_extract(raw, r"([+-])(\d{2}):?(\d{2})$", k).try_cast("int") for k in (2, 3))
    offset = F.when(sign == "-", -(hours * 60 + minutes) * 60).when(sign == "+", (hours * 60 + minutes) * 60).otherwise(0)
    eid = F.when(F.coalesce(F.length(text("eid")), F.lit(0)) == 0, F.lit(0)).otherwise(text("eid").try_cast("int"))
    kind = F.when(eid == 4625, "failed_login").when(eid == 4624, "successful_login").otherwise(F.concat(F.lit("event_"), eid.cast("string")))
    own = [c for c in rows.columns if c != "source_file"]
    return rows.select(
        F.lit("windows").alias("log_type"), kind.alias("event_type"), time.alias("event_time"), blank(text("ip")).alias("source_ip"), blank(text("user")).alias("username"),
        F.when(F.rlike(text("port"), F.lit(r"^\d+$")), text("port").try_cast("int")).alias("port"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in own))).alias("raw_line"), offset.cast("int").alias("tz_offset_s"),
        _file(rows).alias("source_file"), F.lit(None).cast("string").alias("hostname"),
    ).where("event_time is not null and event_type is not null")


def file_heads(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source_file and head (the first line) of each file that has one."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("at")).where("at = 0")
    return lines.withColumn("k", F.monotonically_increasing_id()).groupBy("source_file").agg(F.min_by("value", "k").alias("head"))


def read_windows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events of Windows event tables in CSV; quoted fields, such as messages, may hold commas, line breaks and doubled quotes. Each
    file's own header names its columns: files are read together by header. The driver sees the distinct headers."""
    records = csv_records(spark, paths)
    heads = records.where("head").select("source_file", F.col("record").alias("header"))
    parts = []
    for r in heads.select("header").distinct().orderBy("header").collect():
        files = heads.where(F.col("header") == r.header).select("source_file")
        rows = csv_rows(records.where("not head").join(files, "source_file", "left_semi"), next(csv.reader([r.header], strict=False)))
        parts.append(parse_windows(rows))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], S.EVENT)


def detect_formats(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source_file and format (windows, web, ssh) of each file, from its name and its first line."""
    kind = F.when(F.endswith(F.lower("source_file"), F.lit(".csv")), "windows").when(F.rlike("head", F.lit(WEB_LINE)), "web").when(F.rlike("head", F.lit(SYSLOG_HEAD)), "ssh").otherwise("windows")
    return file_heads(spark, paths).select("source_file", kind.alias("format"))


def line_counts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source_file and lines of each file."""
    return read_lines(spark, paths).groupBy("source_file").agg(F.count("*").alias("lines"))


def load_logs(spark: SparkSession, paths: str | list[str], fmt: str = "auto", year: int | None = None) -> DataFrame:
    """Events of log files of one format, or of mixed files if fmt is `auto`."""
    readers = {"ssh": lambda p: parse_ssh(read_lines(spark, p), year), "web": lambda p: parse_web(read_lines(spark, p)), "windows": lambda p: read_windows(spark, p)}
    if fmt != "auto":
        if fmt not in readers:
            raise ValueError(f"unknown log format {fmt!r}; known: auto, {', '.join(readers)}")
        return readers[fmt](paths)
    by_format: dict[str, list[str]] = {}
    for r in detect_formats(spark, paths).collect():  # a row for each file
        by_format.setdefault(r.format, []).append(r.source_file)
    if not by_format:
        return spark.createDataFrame([], S.EVENT)
    return reduce(DataFrame.unionByName, (readers[k](files) for k, files in sorted(by_format.items())))


def envelope(lines: DataFrame, ts: Column | None = None) -> DataFrame:
    """Lines as messages of a raw log topic: value is `{line, source, ts}` in JSON."""
    return lines.select(F.to_json(F.struct(F.col("value").alias("line"), F.col("source_file").alias("source"), (ts if ts is not None else F.current_timestamp()).alias("ts"))).alias("value"))


def open_envelope(messages: DataFrame) -> DataFrame:
    """value, source_file and ts of raw log messages; what is no such message is left out. Works on streams."""
    got = F.from_json(F.col("value").cast("string"), "line string, source string, ts timestamp").alias("m")
    return messages.select(got).where("m.line is not null").select(F.col("m.line").alias("value"), F.col("m.source").alias("source_file"), F.col("m.ts").alias("ts"))


def read_topic(spark: SparkSession, servers: str, topic: str = "raw-logs", stream: bool = True) -> DataFrame:
    """Lines (value, source_file, ts) of a raw log topic; needs the Kafka connector on the session's class path."""
    reader = spark.readStream if stream else spark.read
    return open_envelope(reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load())
