"""The driver's tables in the shapes that the operators need; each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.text import ENTITIES, decode_entities, significant_tokens
from eventloom.schema import CATEGORIES

TODAY = "1998-07-04"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _category(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CATEGORIES)), (number % len(CATEGORIES) + 1).cast("int"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an event index."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), day.alias("s"), F.when(key % 4 != 0, F.date_add(day, (key % 15).cast("int"))).alias("e"),
        F.array_distinct(F.array(_category(key), _category(F.floor(key / 3)))).alias("c"),
        (F.col("o_orderstatus") == "F").alias("f"), (key % 7 == 0).alias("x"), F.concat(F.lpad((key % 24).cast("string"), 2, "0"), F.lit(":00")).alias("h"),
        F.concat(F.col("o_orderpriority"), F.lit(" & Co, "), F.col("o_orderstatus")).alias("t"), F.concat(F.lit("https://events.example/"), key.cast("string")).alias("u"), F.col("o_custkey").alias("customer"),
    )


_LIST = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
SPANS = f"""spans AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS s,
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 15 AS INTEGER) END AS e,
    {_LIST}[o_orderkey % 11 + 1] AS c1, {_LIST}[(o_orderkey // 3) % 11 + 1] AS c2,
    o_orderstatus = 'F' AS f, o_orderkey % 7 = 0 AS x, lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':00' AS h,
    o_orderpriority || ' & Co, ' || o_orderstatus AS t, 'https://events.example/' || o_orderkey AS u, o_custkey AS customer
  FROM orders)"""


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings of one record for each user; each type feeds one field, so fields have gaps."""
    kind, value = F.col("event_type"), F.col("value")
    day = F.col("ts").cast("date")
    field = lambda name: F.when(kind == name, F.round(value, 2).cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"), day.alias("startDate"), F.when(F.col("event_id") % 3 == 0, F.date_add(day, 2)).alias("endDate"),
        field("click").alias("time"), field("view").alias("venue"), field("purchase").alias("address"), field("signup").alias("priceInfo"), field("error").alias("image"),
    )


SIGHT = """sight AS (
  SELECT user_id AS id, event_id AS seq, CAST(ts AS DATE) AS startDate, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) + 2 END AS endDate,
    event_type, event_id % 1000 AS v
  FROM events)"""


def page_title():
    return decode_entities(F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1))


def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as index entries: tokens of their whole titles, days from the id."""
    key = F.col("page_id")
    start = F.date_add(F.lit("1998-01-01").cast("date"), (key % 60).cast("int"))
    return table(spark, sf_dir, "pages").select(key.alias("id"), start.alias("s"), F.date_add(start, (key % 9).cast("int")).alias("e"), significant_tokens(page_title(), stopwords=("",)).alias("tokens"))


def read_entities(text: str) -> str:
    """Character references as characters, in SQL."""
    said = "regexp_extract(p, '^(x[0-9a-fA-F]+|[0-9]+);', 1)"
    code = f"CASE WHEN {said} LIKE 'x%' THEN CAST('0' || {said} AS INTEGER) ELSE TRY_CAST({said} AS INTEGER) END"
    out = f"array_to_string(list_transform(string_split({text}, '&#'), lambda p, i: CASE WHEN i = 1 THEN p WHEN {said} = '' THEN '&#' || p ELSE chr({code}) || substr(p, length({said}) + 2) END), '')"
    for name in [*(n for n in ENTITIES if n != "amp"), "amp"]:
        value = ENTITIES[name].replace("'", "''")
        out = f"replace({out}, '&{name};', '{value}')"
    return f"trim(regexp_replace({out}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


_NORM = "trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'))"


def norm(expression: str) -> str:
    return _NORM.format(expression)


PAGE_TITLE = read_entities("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")
PAGESPAN = f"""pagespan AS (
  SELECT page_id AS id, DATE '1998-01-01' + CAST(page_id % 60 AS INTEGER) AS s, DATE '1998-01-01' + CAST(page_id % 60 + page_id % 9 AS INTEGER) AS e,
    list_filter(list_distinct(string_split({norm(PAGE_TITLE)}, ' ')), lambda w: length(w) >= 5 AND NOT regexp_full_match(w, '[0-9]+')) AS tokens
  FROM pages)"""
