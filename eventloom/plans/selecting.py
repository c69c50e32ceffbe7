"""Windows, filters, picks and packing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from eventloom.corpus import Corpus
from eventloom.functions import dates
from eventloom.operators import users, windows
from eventloom.plans.adapters import SPANS, TODAY, spans, table
from eventloom.plans.registry import query
from eventloom.schema import venue_of
from eventloom.sinks.store import ring, with_expiry

DAY = dt.date.fromisoformat(TODAY)
_END = "coalesce(e, s)"
_ROW = "id, CAST(s AS VARCHAR) AS s, CAST(e AS VARCHAR) AS e, t"


def _shown(df, *more):
    return df.select("id", F.col("s").cast("string").alias("s"), F.col("e").cast("string").alias("e"), "t", *more)


@query(f"WITH {SPANS} SELECT {_ROW} FROM spans WHERE s <= DATE '1998-07-12' AND {_END} >= DATE '1998-07-04' ORDER BY s, t, id")
def q_window_overlap(spark, sf_dir):
    return _shown(Corpus(spans(spark, sf_dir), DAY).window(DAY, DAY + dt.timedelta(days=8)).events())


@query(f"WITH {SPANS} SELECT {_ROW} FROM spans WHERE s <= DATE '{TODAY}' AND {_END} >= DATE '{TODAY}'")
def q_covers_day(spark, sf_dir):
    return _shown(Corpus(spans(spark, sf_dir), DAY).day().index)


@query(f"WITH {SPANS} SELECT {_ROW} FROM spans WHERE {_END} >= DATE '{TODAY}'")
def q_prune(spark, sf_dir):
    return _shown(Corpus(spans(spark, sf_dir), DAY).pruned().index)


@query(
    f"WITH {SPANS} SELECT {_ROW}, h FROM spans WHERE s <= DATE '{TODAY}' AND {_END} >= DATE '{TODAY}' "
    "AND (h >= '18:00' OR c1 IN ('nightlife', 'music') OR c2 IN ('nightlife', 'music'))"
)
def q_tonight(spark, sf_dir):
    return _shown(Corpus(spans(spark, sf_dir), DAY).tonight().index, "h")


@query(f"WITH {SPANS} SELECT {_ROW} FROM spans WHERE s <= DATE '{TODAY}' + 30 AND {_END} >= DATE '{TODAY}' AND f")
def q_free(spark, sf_dir):
    return _shown(Corpus(spans(spark, sf_dir), DAY).free().index)


@query(f"WITH {SPANS} SELECT {_ROW} FROM spans WHERE s <= DATE '{TODAY}' + 30 AND {_END} >= DATE '{TODAY}' AND x")
def q_gems(spark, sf_dir):
    return _shown(Corpus(spans(spark, sf_dir), DAY).gems().index)


@query(f"WITH {SPANS} SELECT {_ROW} FROM spans WHERE s <= DATE '{TODAY}' + 14 AND {_END} >= DATE '{TODAY}' AND 'art' IN (c1, c2)")
def q_category(spark, sf_dir):
    return _shown(windows.of_category(spans(spark, sf_dir), "art", TODAY))


@query(f"WITH {SPANS} SELECT {_ROW} FROM spans WHERE (c1 IN ('music', 'art') OR c2 IN ('music', 'art')) AND f")
def q_feed_filter(spark, sf_dir):
    return _shown(Corpus(spans(spark, sf_dir), DAY).feed(["music", "art"], free_only=True).index)


@query(
    """SELECT s_suppkey AS id, trim(split_part(n_name || ', ' || s_name, ',', 1)) AS venue_from_address,
         CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE trim(split_part(n_name || ', ' || s_name, ',', 1)) END AS venue,
         CASE WHEN s_acctbal > 5000 THEN TRUE END AS rich
       FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def q_project(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    address, venue = F.concat_ws(", ", "n_name", "s_name"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name"))
    return rows.select(F.col("s_suppkey").alias("id"), venue_of(F.lit(None), address).alias("venue_from_address"), venue_of(venue, address).alias("venue"), F.when(F.col("s_acctbal") > 5000, True).alias("rich"))


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN p_brand WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN NULL ELSE split_part(p_name, ' ', 1) END AS venue
       FROM part"""
)
def q_venue(spark, sf_dir):
    key = F.col("p_partkey")
    venue = F.when(key % 5 == 0, F.col("p_brand"))
    address = F.when(key % 4 == 0, " , Italia").when(key % 4 == 1, "GENOVA, Italia").otherwise(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" , via Roma")))
    return table(spark, sf_dir, "part").select(key.alias("id"), venue_of(venue, address).alias("venue"))


@query(
    f"""WITH {SPANS} SELECT id, CAST(CASE dayofweek(s) WHEN 0 THEN s WHEN 6 THEN s ELSE s + CAST(6 - dayofweek(s) AS INTEGER) END AS VARCHAR) AS sat,
          CAST(CASE dayofweek(s) WHEN 0 THEN s WHEN 6 THEN s + 1 ELSE s + CAST(7 - dayofweek(s) AS INTEGER) END AS VARCHAR) AS sun FROM spans"""
)
def q_weekend(spark, sf_dir):
    s = F.col("s")
    return spans(spark, sf_dir).select("id", dates.weekend_from(s).cast("string").alias("sat"), dates.weekend_to(s).cast("string").alias("sun"))


@query(
    """SELECT event_id AS id, CAST(CAST(ts + INTERVAL 1 HOUR AS DATE) AS VARCHAR) AS day, CAST(extract('hour' FROM ts + INTERVAL 1 HOUR) AS INTEGER) AS hour FROM events"""
)
def q_rome(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")  # January: one hour ahead
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), dates.local_day(ts).cast("string").alias("day"), dates.local_hour(ts).alias("hour"))


@query(f"WITH {SPANS} SELECT id, strftime(s, '%d/%m/%Y') AS shown, CAST(s AS VARCHAR) AS back, strftime(s, '%d.%m') AS short FROM spans")
def q_date_fmt(spark, sf_dir):
    shown = F.date_format("s", "dd/MM/yyyy")
    return spans(spark, sf_dir).select("id", shown.alias("shown"), dates.numeric_range(shown)["start"].alias("back"), F.date_format("s", "dd.MM").alias("short"))


@query(f"WITH {SPANS} SELECT id, CAST(greatest(3600, epoch({_END}) + 86399 + 259200 - 899553600) AS BIGINT) + 899553600 AS expires_at FROM spans")
def q_ttl(spark, sf_dir):
    return with_expiry(spans(spark, sf_dir).withColumn("last_day", windows.last_day()), 899553600).select("id", "expires_at")


@query(
    f"""WITH {SPANS}, prefs AS (SELECT c_custkey AS user_id, c_custkey % 24 AS hour, CASE c_custkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'daily' ELSE 'weekly' END AS digest,
          ['music','theatre','art','food','sport','family','market','nightlife','culture','workshop','other'][c_custkey % 11 + 1] AS likes FROM customer),
        due AS (SELECT *, CASE digest WHEN 'daily' THEN DATE '1998-07-04' ELSE DATE '1998-07-04' END AS a, CASE digest WHEN 'daily' THEN DATE '1998-07-04' ELSE DATE '1998-07-05' END AS b
          FROM prefs WHERE digest <> 'off' AND hour = 9)
        SELECT user_id, id AS event_id FROM due JOIN spans ON s <= b AND {_END} >= a AND (likes = c1 OR likes = c2 OR user_id % 5 = 0)"""
)
def q_digest(spark, sf_dir):
    key = F.col("c_custkey")
    likes = F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.element_at(F.array(*map(F.lit, windows_categories())), (key % 11 + 1).cast("int"))))
    digest = F.when(key % 3 == 0, "off").when(key % 3 == 1, "daily").otherwise("weekly")
    friday = F.lit("1998-07-03").cast("date")
    prefs = table(spark, sf_dir, "customer").select(key.alias("user_id"), likes.alias("likes"), users.digest_window(digest, key % 24, friday, F.lit(9)).alias("due")).where("due is not null")
    # an event meets a digest by day: spans last 15 days at most, so days make a small equality join
    days = lambda a, b: F.explode(F.sequence(a, b))
    by_day = spans(spark, sf_dir).where(windows.in_window("1998-07-04", "1998-07-05")).select("id", "c", days(F.col("s"), windows.last_day()).alias("day"))
    asked = prefs.select("user_id", "likes", days(F.col("due.start"), F.col("due.end")).alias("day"))
    wanted = (F.size("likes") == 0) | F.arrays_overlap("c", "likes")
    return asked.join(by_day, "day").where(wanted).select("user_id", F.col("id").alias("event_id")).distinct()


def windows_categories():
    from eventloom.schema import CATEGORIES

    return CATEGORIES


@query(
    f"""WITH {SPANS}, saved AS (SELECT user_id, event_id % 500 AS event_id, min(event_id) AS pos, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL)
        SELECT user_id, pos, event_id, CAST(s AS VARCHAR) AS s FROM saved JOIN spans ON spans.id = saved.event_id WHERE n % 2 = 1"""
)
def q_lookup_order(spark, sf_dir):
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", (F.col("event_id") % 500).alias("event_id"), F.col("event_id").alias("pos"))
    kept = clicks.groupBy("user_id", "event_id").agg(F.min("pos").alias("pos"), F.count("*").alias("n")).where("n % 2 = 1")
    index = spans(spark, sf_dir).select(F.col("id").alias("event_id"), F.col("s").cast("string").alias("s"))
    return kept.join(index, "event_id").select("user_id", "pos", "event_id", "s")


@query("SELECT user_id, event_id % 50 AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL HAVING count(*) % 2 = 1")
def q_toggle(spark, sf_dir):
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", (F.col("event_id") % 50).alias("event_id"))
    return users.toggled(clicks, ["user_id", "event_id"])


@query(
    f"""WITH {SPANS}, saved AS (SELECT DISTINCT user_id, event_id % 5000 AS event_id FROM events WHERE event_type = 'view'),
          sent AS (SELECT DISTINCT user_id, event_id % 5000 AS event_id FROM events WHERE event_type = 'purchase')
        SELECT user_id, event_id, CAST(s AS VARCHAR) AS s FROM saved JOIN spans ON id = event_id
        WHERE s = DATE '{TODAY}' + 1 AND NOT EXISTS (SELECT 1 FROM sent WHERE sent.user_id = saved.user_id AND sent.event_id = saved.event_id)"""
)
def q_due_reminders(spark, sf_dir):
    marks = lambda kind: table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", (F.col("event_id") % 5000).alias("event_id")).distinct()
    index = spans(spark, sf_dir).select(F.col("id").alias("event_id"), "s")
    return users.due_reminders(marks("view"), index, marks("purchase"), TODAY).select("user_id", "event_id", F.col("s").cast("string").alias("s"))


@query(
    f"""WITH {SPANS}, w AS (SELECT *, CASE WHEN 'music' IN (c1, c2) THEN 3 ELSE 1 END AS weight FROM spans WHERE s <= DATE '{TODAY}' + 14 AND {_END} >= DATE '{TODAY}'),
          r AS (SELECT id, sum(weight) OVER (ORDER BY s, t, id) AS run, sum(weight) OVER () AS total FROM w)
        SELECT id FROM r WHERE run > 0.7 * total ORDER BY run LIMIT 1"""
)
def q_weighted_pick(spark, sf_dir):
    rows = windows.ahead(spans(spark, sf_dir), TODAY, 14)
    return windows.weighted_pick(rows, ["s", "t", "id"], F.when(windows.has_category("music"), 3).otherwise(1), 0.7).select("id")


@query(
    """SELECT conv_id, turn, run FROM (SELECT conv_id, turn, CAST(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS BIGINT) AS run FROM conversations)
       WHERE run <= 1500"""
)
def q_pack_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    run = F.sum(F.length("text") + 1).over(windows.Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(windows.Window.unboundedPreceding, 0))
    packed = windows.pack_prefix(rows.withColumn("run", run), ["conv_id"], ["turn", "role", "text"], F.length("text"), 1500)
    return packed.select("conv_id", "turn", "run")


@query(f"WITH {SPANS} SELECT customer, id, CAST((row_number() OVER (PARTITION BY customer ORDER BY id) - 1) // 3 AS BIGINT) AS chunk FROM spans")
def q_chunk(spark, sf_dir):
    return windows.chunked(spans(spark, sf_dir), ["customer"], ["id"], 3).select("customer", "id", "chunk")


@query(f"WITH {SPANS} SELECT id, CASE WHEN f THEN 0 ELSE 1 END AS priority FROM spans ORDER BY priority, id LIMIT 24")
def q_pending(spark, sf_dir):
    return spans(spark, sf_dir).select("id", F.when(F.col("f"), 0).otherwise(1).alias("priority")).orderBy("priority", "id").limit(24)


@query(f"WITH {SPANS} SELECT id, CAST(s AS VARCHAR) AS s FROM spans WHERE s <= DATE '{TODAY}' + 30 AND {_END} >= DATE '{TODAY}' ORDER BY s, id LIMIT 80")
def q_topn(spark, sf_dir):
    return windows.ahead(spans(spark, sf_dir), TODAY, 30).select("id", F.col("s").cast("string").alias("s")).orderBy("s", "id").limit(80)


@query(f"WITH {SPANS} SELECT customer, id FROM spans QUALIFY row_number() OVER (PARTITION BY customer ORDER BY s, id) <= 2")
def q_lookup_budget(spark, sf_dir):
    return windows.first_of(spans(spark, sf_dir), ["customer"], ["s", "id"], 2).select("customer", "id")


@query("SELECT event_id AS at, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def q_ring(spark, sf_dir):
    return ring(table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), "event_type"))


@query("SELECT user_id, max(event_id) AS at, arg_max(round(value, 2), event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY 1")
def q_last_success(spark, sf_dir):
    good = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return good.groupBy("user_id").agg(F.max("event_id").alias("at"), F.max_by(F.round("value", 2), "event_id").alias("value"))


@query("SELECT r_name AS region, CAST(CAST(DATE '1998-07-04' + CAST(30 * k AS INTEGER) AS DATE) AS VARCHAR) AS since FROM region, range(4) AS g(k)")
def q_grid(spark, sf_dir):
    starts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.date_add(F.lit(TODAY).cast("date"), k * 30))
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("region"), F.explode(starts.cast("array<string>")).alias("since"))


@query("SELECT event_id AS id FROM events WHERE epoch(ts) >= epoch(TIMESTAMP '2024-01-30 00:00:00') - 10 * 86400")
def q_post_age(spark, sf_dir):
    from eventloom.sources.feeds import recent_posts

    posts = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("date"), F.col("event_type").alias("text"))
    return recent_posts(posts, 1706572800, 10).select("id")
