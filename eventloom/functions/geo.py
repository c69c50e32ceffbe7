"""Provinces, cities and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.geo_tables import rows
from eventloom.functions.text import slug

EARTH_KM = 6371.0
MOST_KM = 90.0
#: A degree of longitude in degrees of latitude at 43 degrees north.
LONGITUDE_SHARE = 0.73


def geo_dim(spark: SparkSession) -> DataFrame:
    """107 provinces with city, region and centre: a constant table."""
    table = spark.createDataFrame(rows(), "province string, city_name string, region_name string, lat double, lng double")
    return table.withColumns({"city_slug": slug(F.col("city_name")), "region_slug": slug(F.col("region_name"))})


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    d_lat, d_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.pow(F.sin(d_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lng), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def nearest(points: DataFrame, centres: DataFrame, key: str, name: str) -> DataFrame:
    """``key`` with the ``name`` of the nearest of ``centres(name, c_lat, c_lng)``, a constant small table."""
    array = centres.agg(F.sort_array(F.collect_list(F.struct(name, "c_lat", "c_lng")))).scalar()
    # the centres are one value, a subquery that is run once: no pairs are made
    scored = F.transform(
        "_centres",
        lambda c: F.struct((F.pow(F.col("lat") - c["c_lat"], 2) + F.pow((F.col("lng") - c["c_lng"]) * LONGITUDE_SHARE, 2)).alias("d2"), c[name].alias(name)),
    )
    return points.withColumn("_centres", array).select(key, F.array_min(scored)[name].alias(name))


def with_city(df: DataFrame, dim: DataFrame, province: str) -> DataFrame:
    """City and region of a province code; unknown codes leave both null."""
    keys = dim.select(F.col("province").alias("_p"), "city_slug", "region_slug")
    return df.join(F.broadcast(keys), F.upper(F.trim(F.col(province))) == F.col("_p"), "left").drop("_p")


def misplaced(lat: Column, lng: Column, centre_lat: Column, centre_lng: Column, most_km: float = MOST_KM) -> Column:
    """A point too far from the centre of the city it is filed under; without a centre nothing is."""
    return F.coalesce(distance_km(centre_lat, centre_lng, lat, lng) > most_km, F.lit(False))
