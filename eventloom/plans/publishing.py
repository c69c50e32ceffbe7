"""Listings, calendar text, JSON and packing of messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import windows
from eventloom.plans.adapters import SPANS, TODAY, spans, table
from eventloom.plans.registry import query
from eventloom.schema import CATEGORIES
from eventloom.sinks import ics, listing

_ON = f"s <= DATE '{TODAY}' AND coalesce(e, s) >= DATE '{TODAY}'"
_SPAN = "strftime(s, '%d.%m') || coalesce('–' || strftime(e, '%d.%m'), '') || ', ' || h"
_LINE = f"""'• ' || CASE WHEN x THEN '💎 ' ELSE '' END || '<a href="' || u || '">' || replace(t, '&', '&amp;') || '</a> — ' || {_SPAN} || CASE WHEN f THEN ', free' ELSE '' END"""
_ORDER = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"


def _today(spark, sf_dir):
    none = F.lit(None).cast("string")
    texts = none.cast("string")
    rows = spans(spark, sf_dir).where(windows.covers_day(TODAY)).withColumn("v", texts)
    empty = F.struct(*(F.lit("").alias(x) for x in ("en", "it", "ru")))
    return rows.withColumn("tl", empty).withColumn("d", empty)


@query(
    f"""WITH {SPANS} SELECT CAST(list_position({_ORDER}, c1) AS INTEGER) AS ord, c1 AS category, count(*) AS n, string_agg({_LINE}, chr(10) ORDER BY s, t, id) AS body
        FROM spans WHERE {_ON} GROUP BY ALL ORDER BY ord"""
)
def q_render_grouped(spark, sf_dir):
    return listing.grouped(_today(spark, sf_dir))


_TIMED = """strftime(s + CAST((id % 24 + {0}) // 24 AS INTEGER), '%Y%m%d') || 'T' || lpad(CAST((id % 24 + {0}) % 24 AS VARCHAR), 2, '0') || '0000'"""


@query(
    f"""WITH {SPANS} SELECT id, CASE WHEN id % 5 = 0 THEN 'DTSTART;VALUE=DATE:' || strftime(s, '%Y%m%d') ELSE 'DTSTART;TZID=Europe/Rome:' || {_TIMED.format(0)} END AS dtstart,
          CASE WHEN id % 5 = 0 THEN 'DTEND;VALUE=DATE:' || strftime(coalesce(e, s) + 1, '%Y%m%d') ELSE 'DTEND;TZID=Europe/Rome:' || {_TIMED.format(2)} END AS dtend,
          replace(t, ',', '\\,') AS summary FROM spans"""
)
def q_ics_lines(spark, sf_dir):
    rows = spans(spark, sf_dir)
    lines = ics.timing(F.col("s"), F.col("e"), F.when(F.col("id") % 5 != 0, F.col("h")))
    return rows.select("id", F.get(lines, 0).alias("dtstart"), F.get(lines, 1).alias("dtend"), ics.escape(F.col("t")).alias("summary"))


@query(
    f"""WITH {SPANS} SELECT id, '{{"id":' || id || ',"t":"' || t || '","s":"' || CAST(s AS VARCHAR) || '"' || coalesce(',"e":"' || CAST(e AS VARCHAR) || '"', '') || '}}' AS json FROM spans WHERE {_ON}"""
)
def q_json_feed(spark, sf_dir):
    return listing.json_feed(_today(spark, sf_dir), "id", "t", "s", "e")


@query(
    """SELECT conv_id, turn, sum(length(line)) + 0 AS total, max(pieces) AS pieces FROM (
         SELECT conv_id, turn, line, 1 + greatest(0, CAST(ceil((length(line) - 74) / 73.0) AS BIGINT)) AS pieces
         FROM (SELECT conv_id, turn, replace(text, chr(10), '\\n') AS line FROM conversations)) GROUP BY ALL"""
)
def q_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", ics.fold(F.replace("text", F.lit("\n"), F.lit("\\n"))).alias("p"))
    size = F.length(F.array_join("p", "")) - F.size("p") + 1  # without the spaces that begin continued lines
    return rows.groupBy("conv_id", "turn").agg(F.sum(size).alias("total"), F.max(F.size("p").cast("long")).alias("pieces"))


@query()
def q_split_message(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: x["text"]), "\n")
    return turns.select("conv_id", F.posexplode(windows.split_lines(body, 400)).alias("at", "piece"))


@query()
def q_calendar(spark, sf_dir):
    return ics.calendar(_today(spark, sf_dir).withColumn("id", F.col("id").cast("string")), "19980704T000000Z")
