"""Dimensions, distances and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import geo
from eventloom.functions.geo_tables import rows as provinces
from eventloom.plans.adapters import table
from eventloom.plans.registry import query

#: Some cities, each with a point.
_CENTRES = {"genova": (44.4073, 8.9339), "milano": (45.4642, 9.19), "roma": (41.8933, 12.4829), "napoli": (40.8359, 14.2488), "torino": (45.0703, 7.6869), "trieste": (45.6496, 13.7773)}
_VALUES = "centre(name, c_lat, c_lng) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, (a, b) in _CENTRES.items()) + ")"
_POINT = "point AS (SELECT s_suppkey AS id, 37 + (s_suppkey * 37 % 1000) / 100.0::DOUBLE AS lat, 7 + (s_suppkey * 91 % 1100) / 100.0::DOUBLE AS lng, s_suppkey % 7 AS k FROM supplier)"
_KM = "6371 * 2 * asin(least(1, sqrt(sin(radians(lat - {a}) / 2) ^ 2 + cos(radians({a})) * cos(radians(lat)) * sin(radians(lng - {b}) / 2) ^ 2)))"
_NAMES = "[" + ", ".join(f"'{n}'" for n in _CENTRES) + "]"


def _points(spark, sf_dir):
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.alias("id"), (37 + (key * 37 % 1000) / F.lit(100.0)).alias("lat"), (7 + (key * 91 % 1100) / F.lit(100.0)).alias("lng"), (key % 7).alias("k"))


def _centres(spark):
    rows = [(n, a, b) for n, (a, b) in _CENTRES.items()]
    return spark.createDataFrame(rows, "name string, c_lat double, c_lng double")


@query("SELECT r_name AS region, count(*) AS suppliers, count(DISTINCT n_nationkey) AS nations FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def q_region_rollup(spark, sf_dir):
    dims = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(dims), F.col("s_nationkey") == F.col("n_nationkey"))  # at most 25 nations
    return rows.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("suppliers"), F.countDistinct("n_nationkey").alias("nations"))


_CAPITALS = "centre(name, c_lat, c_lng) AS (VALUES " + ", ".join(f"('{code}', {lat}::DOUBLE, {lng}::DOUBLE)" for code, _, _, lat, lng in provinces()) + ")"


@query(f"WITH {_CAPITALS}, {_POINT} SELECT id, arg_min(name, (lat - c_lat) ^ 2 + ((lng - c_lng) * 0.73) ^ 2) AS name FROM point, centre GROUP BY 1")
def q_nearest(spark, sf_dir):
    """Of all provinces' capitals."""
    centres = geo.geo_dim(spark).select(F.col("province").alias("name"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    return geo.nearest(_points(spark, sf_dir), centres, "id", "name")


@query(f"WITH {_POINT} SELECT id, round({_KM.format(a='44.4073', b='8.9339')}, 4) AS km FROM point")
def q_haversine(spark, sf_dir):
    lat, lng = _CENTRES["genova"]
    return _points(spark, sf_dir).select("id", F.round(geo.distance_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")), 4).alias("km"))


@query(
    f"WITH {_VALUES}, {_POINT} SELECT id, {_NAMES}[k + 1] AS city, coalesce({_KM.format(a='c_lat', b='c_lng')} > 90, FALSE) AS misplaced FROM point LEFT JOIN centre ON name = {_NAMES}[k + 1]"
)
def q_misplaced(spark, sf_dir):
    names = F.array(*map(F.lit, _CENTRES))
    rows = _points(spark, sf_dir).withColumn("city", F.get(names, F.col("k").cast("int")))
    joined = rows.join(F.broadcast(_centres(spark)), F.col("city") == F.col("name"), "left")
    return joined.select("id", "city", geo.misplaced(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")).alias("misplaced"))


@query("SELECT c_nationkey AS city, lower(trim(c_mktsegment)) AS address, min(c_custkey) AS first_id, count(*) AS n FROM customer GROUP BY ALL")
def q_jobs(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("city"), F.lower(F.trim("c_mktsegment")).alias("address"), "c_custkey")
    return rows.groupBy("city", "address").agg(F.min("c_custkey").alias("first_id"), F.count("*").alias("n"))


@query(
    """SELECT c_custkey AS id, CASE WHEN s_suppkey IS NULL THEN 'absent' WHEN s_acctbal < 5000 THEN 'miss' ELSE 'hit' END AS state
       FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 200"""
)
def q_cache_tri(spark, sf_dir):
    cache = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 200).alias("s_suppkey")).join(cache, "s_suppkey", "left")
    state = F.when(F.col("s_acctbal").isNull(), "absent").when(F.col("s_acctbal") < 5000, "miss").otherwise("hit")
    return rows.select("id", state.alias("state"))
