"""Identity, merging, duplicates, set operations and run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom import pipeline
from eventloom.functions.text import contained, jaccard, normalize_title, significant_tokens, slug
from eventloom.operators import dedupe, identity, merge
from eventloom.plans.adapters import PAGE_TITLE, PAGESPAN, SPANS, norm, page_spans, page_title, sightings, spans, table
from eventloom.plans.registry import query
from eventloom.schema import RECORDS, SIGHTINGS
from eventloom.sinks.store import state_root
from eventloom.streaming.upsert import KeyedTable

_PLACE = "regexp_replace(split_part(split_part(url, '://', 2), '?', 1), '#.*$', '')"


def _place():
    return F.regexp_replace(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)), "#.*$", "")


@query(f"SELECT doc_id AS id, substring(sha256({norm('text')} || '|' || CAST(DATE '2026-01-01' + CAST(doc_id % 300 AS INTEGER) AS VARCHAR)), 1, 12) AS event_id FROM documents")
def q_event_id(spark, sf_dir):
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), identity.event_id(F.col("text"), day).alias("event_id"))


@query(f"SELECT doc_id AS id, {norm('text')} AS title FROM documents")
def q_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), normalize_title(F.col("text")).alias("title"))


@query("SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(strip_accents(p_name || ' ' || p_brand)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def q_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


_STOP = "'festival','genova','teatro','mostra','estate'"


@query(
    f"""SELECT doc_id AS id, array_to_string(list_sort(list_filter(list_distinct(string_split({norm('text')}, ' ')),
          lambda w: length(w) >= 5 AND w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '[0-9]+'))), ' ') AS tokens FROM documents"""
)
def q_tokens(spark, sf_dir):
    tokens = significant_tokens(F.col("text"), stopwords=("festival", "genova", "teatro", "mostra", "estate"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(F.array_sort(tokens), " ").alias("tokens"))


_SHARING = "pagespan a JOIN pagespan b ON a.id < b.id AND a.s <= b.e AND b.s <= a.e AND list_has_any(a.tokens, b.tokens)"


@query(
    f"""WITH {PAGESPAN} SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))), 6) AS jaccard,
          len(list_intersect(a.tokens, b.tokens)) = least(len(a.tokens), len(b.tokens)) AS within FROM {_SHARING}"""
)
def q_jaccard(spark, sf_dir):
    pairs = dedupe.overlapping_pairs(page_spans(spark, sf_dir))
    x, y = F.col("a_tokens"), F.col("b_tokens")
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(jaccard(x, y), 6).alias("jaccard"), contained(x, y).alias("within"))


@query(
    f"""WITH {PAGESPAN}, p AS (SELECT a.id AS a, b.id AS b,
            4.0 * len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) + CASE WHEN a.s = b.s THEN 2 ELSE 0 END
            + CASE WHEN a.e = b.e THEN 1 ELSE 0 END + CASE WHEN len(list_intersect(a.tokens, b.tokens)) = least(len(a.tokens), len(b.tokens)) THEN 2 ELSE 0 END AS score
          FROM {_SHARING})
        SELECT a, b, round(score, 6) AS score FROM p WHERE score >= 2 ORDER BY round(p.score, 9) DESC, a, b LIMIT 60"""
)
def q_fuzzy_pairs(spark, sf_dir):
    pairs = dedupe.candidate_pairs(page_spans(spark, sf_dir))
    return pairs.orderBy(F.desc(F.round("score", 9)), "a", "b").limit(60).select("a", "b", F.round("score", 6).alias("score"))


@query(f"WITH u AS (SELECT page_id AS id, {_PLACE} AS place FROM pages), f AS (SELECT place, min(id) AS a FROM u GROUP BY 1 HAVING count(*) > 1) SELECT a, id AS b FROM u JOIN f USING (place) WHERE id > a")
def q_url_dups(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), _place().alias("url"))
    return dedupe.url_duplicates(urls)


@query(
    f"""WITH {SPANS} SELECT a.id AS a, b.id AS b FROM spans a JOIN spans b ON a.customer = b.customer AND a.id < b.id
          AND a.s <= coalesce(b.e, b.s) AND b.s <= coalesce(a.e, a.s)"""
)
def q_interval_join(spark, sf_dir):
    rows = spans(spark, sf_dir).select("id", "customer", "s", "e")
    left = rows.select("customer", *(F.col(c).alias(f"a_{c}") for c in ("id", "s", "e")))
    right = rows.select("customer", *(F.col(c).alias(f"b_{c}") for c in ("id", "s", "e")))
    return left.join(right, "customer").where((F.col("a_id") < F.col("b_id")) & dedupe.overlap("a_", "b_")).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


@query(
    """WITH known AS (SELECT l_partkey AS url, max(l_orderkey) AS alias FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1),
         seen AS (SELECT DISTINCT l_orderkey AS own, l_partkey AS url FROM lineitem WHERE l_orderkey % 2 = 1)
       SELECT own, url, coalesce(alias, own) AS id FROM seen LEFT JOIN known USING (url)"""
)
def q_alias(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").cast("string").alias("u"), F.col("l_orderkey").alias("pos"))
    none = F.array().cast("array<struct<source:string,url:string,image:string>>")
    aliases = identity.alias_map(lines.where("id % 2 = 0").withColumn("l", none))
    seen = lines.where("id % 2 = 1").select(F.col("id").alias("own"), F.col("u").alias("url"), "id").distinct()
    return identity.resolve(seen, aliases).select("own", F.col("url").cast("long").alias("url"), "id")


@query("SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def q_semi(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return identity.split_known(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), returned)[0]


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def q_anti(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return identity.split_known(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), returned)[1]


_FIELDS = {"time": "click", "venue": "view", "address": "purchase", "priceInfo": "signup", "image": "error"}


def _first(column: str, kind: str, where: str = "TRUE") -> str:
    return f"arg_min(event_id, event_id) FILTER (WHERE event_type = '{kind}' AND {where}) AS {column}"


def _fields(df):
    """Fields as the number of the sighting that fills them, so that values compare exactly."""
    return df.select("id", "seq", "startDate", "endDate", *(F.when(F.col(c).isNotNull(), F.col("seq")).alias(c) for c in _FIELDS))


@query(
    "SELECT user_id AS id, CAST(CAST(arg_min(ts, event_id) AS DATE) AS VARCHAR) AS startDate, CAST(arg_min(CAST(ts AS DATE) + 2, event_id) FILTER (WHERE event_id % 3 = 0) AS VARCHAR) AS endDate, "
    + ", ".join(_first(c, k) for c, k in _FIELDS.items())
    + " FROM events GROUP BY 1"
)
def q_within_run(spark, sf_dir):
    out = merge.within_run(_fields(sightings(spark, sf_dir)), "id", ["startDate", "endDate", *_FIELDS])
    return out.withColumns({c: F.col(c).cast("string") for c in ("startDate", "endDate")})


_HALVES = "WITH " + ", ".join(
    f"{name} AS (SELECT user_id AS id, min(CAST(ts AS DATE)) AS s, max(CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) + 2 ELSE CAST(ts AS DATE) END) AS z, "
    + ", ".join(_first(c, k) for c, k in _FIELDS.items())
    + f" FROM events WHERE event_id % 10 {test} GROUP BY 1)"
    for name, test in (("old", "= 0"), ("new", "= 1"))
)


def _half(spark, sf_dir, test: str):
    rows = _fields(sightings(spark, sf_dir)).where(f"seq % 10 {test}")
    folded = merge.collapse_runs(rows, "id", "startDate", "endDate", order="seq")
    return folded.join(merge.within_run(rows, "id", list(_FIELDS)), "id")


@query(
    _HALVES
    + """, m AS (SELECT o.id, least(o.s, n.s) AS s, greatest(o.z, n.z) AS z, """
    + ", ".join(f"coalesce(o.{c}, n.{c}) AS {c}" for c in _FIELDS)
    + ", (n.s < o.s OR n.z > o.z OR "
    + " OR ".join(f"(o.{c} IS NULL AND n.{c} IS NOT NULL)" for c in _FIELDS)
    + """) AS changed FROM old o JOIN new n USING (id))
       SELECT id, CAST(s AS VARCHAR) AS startDate, CASE WHEN z <> s THEN CAST(z AS VARCHAR) END AS endDate, """
    + ", ".join(_FIELDS)
    + ", changed FROM m"
)
def q_upsert(spark, sf_dir):
    stored, incoming = _half(spark, sf_dir, "= 0"), _half(spark, sf_dir, "= 1")
    out = merge.upsert(stored.join(incoming.select("id"), "id", "left_semi"), incoming, filled=tuple(_FIELDS))
    return out.withColumns({c: F.col(c).cast("string") for c in ("startDate", "endDate")})


@query(
    """SELECT o_orderkey AS id, coalesce(p_type, 'pending') AS kind, p_type IS NOT NULL AS enriched
       FROM orders LEFT JOIN part ON p_partkey = o_orderkey AND p_size > 25"""
)
def q_enrich_apply(spark, sf_dir):
    answers = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"), "p_type")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(answers, "id", "left")
    return rows.select("id", F.coalesce("p_type", F.lit("pending")).alias("kind"), F.col("p_type").isNotNull().alias("enriched"))


@query(
    f"""WITH {SPANS} SELECT a.id, a.s <= b.s AS older_first, CASE WHEN a.s <= b.s THEN coalesce(CAST(a.e AS VARCHAR), CAST(b.e AS VARCHAR)) ELSE coalesce(CAST(b.e AS VARCHAR), CAST(a.e AS VARCHAR)) END AS e,
          array_to_string(list_filter(CASE WHEN a.s <= b.s THEN [a.c1, a.c2, b.c1, b.c2] ELSE [b.c1, b.c2, a.c1, a.c2] END,
            lambda c, i: list_position(CASE WHEN a.s <= b.s THEN [a.c1, a.c2, b.c1, b.c2] ELSE [b.c1, b.c2, a.c1, a.c2] END, c) = i)[1:3], ' ') AS c, a.f OR b.f AS f, a.x OR b.x AS x
        FROM spans a JOIN spans b ON b.id = a.id + 1 WHERE a.id % 2 = 0"""
)
def q_merge_pair(spark, sf_dir):
    rows = spans(spark, sf_dir).select("id", "s", F.col("e").cast("string").alias("e"), "c", "f", "x")
    a = rows.where("id % 2 = 0").withColumn("pair", F.col("id"))
    b = rows.where("id % 2 = 1").withColumn("pair", F.col("id") - 1)
    left, right = a.select("pair", *(F.col(c).alias(f"l_{c}") for c in rows.columns)), b.select("pair", *(F.col(c).alias(f"r_{c}") for c in rows.columns))
    both = left.join(right, "pair")
    older = F.col("l_s") <= F.col("r_s")
    named = both.select("pair", older.alias("older_first"), *(F.when(older, F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")).alias(f"p_{c}") for c in rows.columns), *(F.when(older, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}")).alias(f"q_{c}") for c in rows.columns))
    merged = merge.merge_pairs("p_", "q_", ("e",))
    return named.select(F.col("pair").alias("id"), "older_first", merged["e"].alias("e"), F.array_join(merged["c"], " ").alias("c"), merged["f"].alias("f"), merged["x"].alias("x"))


@query("SELECT l_partkey AS id, count(DISTINCT l_suppkey) - CAST(bool_or(l_suppkey = l_partkey % 100) AS INTEGER) AS n_links, CAST(sum(DISTINCT CASE WHEN l_suppkey <> l_partkey % 100 THEN l_suppkey ELSE 0 END) AS BIGINT) AS check_sum FROM lineitem GROUP BY 1")
def q_links(spark, sf_dir):
    own = (F.col("l_partkey") % 100).cast("string")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.struct("l_orderkey", "l_linenumber").alias("seq"), F.col("l_returnflag").alias("source"), F.col("l_suppkey").cast("string").alias("url"), F.lit(None).cast("string").alias("image"), own.alias("own"))
    links = merge.unite_links(rows.where("url <> own"), "id")
    total = F.aggregate("links", F.lit(0).cast("long"), lambda a, x: a + x["url"].cast("long"))
    every = rows.select("id").distinct().join(links, "id", "left")
    return every.select("id", F.coalesce(F.size("links"), F.lit(0)).cast("long").alias("n_links"), F.coalesce(total, F.lit(0)).alias("check_sum"))


@query(
    """SELECT l_orderkey AS id, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS s, CASE WHEN max(l_shipdate) <> min(l_shipdate) THEN CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) END AS e
       FROM lineitem GROUP BY 1"""
)
def q_collapse_runs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").cast("date").alias("s"), F.lit(None).cast("date").alias("e"))
    return merge.collapse_runs(lines, "id", "s", "e").select("id", F.col("s").cast("string").alias("s"), F.col("e").cast("string").alias("e"))


@query(
    """SELECT 'https://x/' || l_partkey || '/' AS url, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS s, count(*) AS n
       FROM lineitem GROUP BY l_partkey"""
)
def q_collapse_suffix(spark, sf_dir):
    url = F.concat(F.lit("https://x/"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit("/"))
    rows = table(spark, sf_dir, "lineitem").select(merge.url_stem(url).alias("url"), F.col("l_shipdate").cast("date").alias("s"))
    return rows.groupBy("url").agg(F.min("s").cast("string").alias("s"), F.count("*").alias("n"))


_SESSIONS = "SELECT l_orderkey AS id, CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM lineitem GROUP BY 1"


@query(
    f"""WITH z AS ({_SESSIONS}), o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS s FROM orders)
        SELECT id, CASE WHEN id % 2 = 0 AND a IS NOT NULL THEN CAST(a AS VARCHAR) ELSE CAST(s AS VARCHAR) END AS startDate,
          CASE WHEN id % 2 = 0 AND a IS NOT NULL THEN CASE WHEN a <> b THEN CAST(b AS VARCHAR) END ELSE CAST(s + 300 AS VARCHAR) END AS endDate
        FROM o LEFT JOIN z USING (id)"""
)
def q_container_span(spark, sf_dir):
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.struct(F.col("l_shipdate").cast("date").alias("date"))).alias("a"), F.max(F.struct(F.col("l_shipdate").cast("date").alias("date"))).alias("b"))
    days = days.select("id", F.array("a", "b").alias("sessions"))  # the span needs no others
    key, s = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").select(key.alias("id"), s.alias("startDate"), F.date_add(s, 300).alias("endDate"), F.when(key % 2 == 0, "container").alias("kind"))
    out = merge.with_derived_span(rows.join(days, "id", "left"))
    return out.select("id", F.col("startDate").cast("string").alias("startDate"), F.col("endDate").cast("string").alias("endDate"))


@query("SELECT l_orderkey AS id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, min(l_partkey) AS first_part FROM lineitem GROUP BY ALL")
def q_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").cast("date").cast("string").alias("day"), F.col("l_partkey").alias("first_part"))
    return merge.unique_sessions(rows, ["id", "day"], ["first_part"])


@query(
    """WITH r AS (SELECT user_id AS id, event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS part FROM events)
       SELECT id, arg_max(event_id, part * 1000000000 + event_id) AS seq FROM r GROUP BY 1"""
)
def q_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type")
    parts = [rows.where("event_type = 'view'"), rows.where("event_type = 'click'"), rows.where("event_type not in ('view', 'click')")]
    return merge.last_wins([p.drop("event_type") for p in parts], "id", "seq")


@query("SELECT event_id AS id, CASE WHEN event_type = 'view' THEN round(value, 2) END AS value FROM events WHERE event_type IN ('view', 'click')")
def q_union(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    views = rows.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.round("value", 2).alias("value"))
    return views.unionByName(rows.where("event_type = 'click'").select(F.col("event_id").alias("id")), allowMissingColumns=True)


@query("WITH g AS (SELECT doc_id AS id, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS nth FROM documents) SELECT id FROM g WHERE nth > 1")
def q_shared_art(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.sha2("text", 256).alias("image"))
    return dedupe.shared_artwork(docs, "id", "source", "image", ["id"])


@query(
    """SELECT event_type AS source, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS fetched, count(*) FILTER (WHERE event_id % 3 = 0) AS fresh,
         count(*) FILTER (WHERE event_id % 3 = 1) AS merged, bool_or(event_id % 97 = 0) AS failed FROM events GROUP BY ALL"""
)
def q_run_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    key = F.col("event_id")
    return rows.groupBy(F.col("event_type").alias("source"), F.col("ts").cast("date").cast("string").alias("day")).agg(
        F.count("*").alias("fetched"), F.count_if(key % 3 == 0).alias("fresh"), F.count_if(key % 3 == 1).alias("merged"), F.bool_or(key % 97 == 0).alias("failed")
    )


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS total FROM events GROUP BY 1")
def q_nested_sum(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))
    nested = rows.groupBy("day").agg(F.collect_list(F.struct("event_type", "n")).alias("sources"))
    total = F.aggregate("sources", F.lit(0).cast("long"), lambda a, x: a + F.when(x["event_type"] != "error", x["n"]).otherwise(0))
    return nested.select("day", total.alias("total"))


@query(
    "SELECT user_id AS id, "
    + ", ".join(f"arg_min(event_id, event_id % 3 * 1000000000 + event_id) FILTER (WHERE event_type = '{k}') AS {c}" for c, k in _FIELDS.items())
    + " FROM events GROUP BY 1"
)
def q_stream_upsert(spark, sf_dir):
    """Three micro-batches, one after another, as the stream folds them."""
    rows = _fields(sightings(spark, sf_dir))
    kept = KeyedTable(spark, state_root(spark, "stream-table"), "id", list(_FIELDS), buckets=4)
    for number in range(3):
        kept.fold(rows.where(F.col("seq") % 3 == number), number)
    return kept.read().select("id", *_FIELDS)


_DAY = "DATE '2026-01-01' + CAST(page_id % 40 AS INTEGER)"


@query(
    f"""WITH p AS (SELECT page_id, {PAGE_TITLE} AS title, {_DAY} AS day, substring(sha256({norm(PAGE_TITLE)} || '|' || CAST({_DAY} AS VARCHAR)), 1, 12) AS id FROM pages)
        SELECT id, arg_min(title, page_id) AS title, CAST(min(day) AS VARCHAR) AS day, CAST(count(*) - 1 AS INTEGER) AS n_links FROM p WHERE day >= DATE '2026-01-10' GROUP BY id"""
)
def q_collect(spark, sf_dir):
    """A first run over the pages as sightings; no pairs are judged, so it ends before they would be merged."""
    key = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(key.alias("seq"), page_title().alias("title"), F.date_add(F.lit("2026-01-01").cast("date"), (key % 40).cast("int")).alias("startDate"), F.concat(F.lit("https://p/"), key.cast("string")).alias("url"), F.lit("pages").alias("source"))
    seen = {f.name: f.dataType for f in spark.createDataFrame([], SIGHTINGS).schema}
    rows = rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in seen.items()))
    run = pipeline.collect(rows, spark.createDataFrame([], RECORDS), "2026-01-10", 1767225600, judge=lambda pairs: pairs.limit(0))
    return run.records.select("id", "title", F.col("startDate").cast("string").alias("day"), F.size(F.coalesce("altLinks", F.array())).alias("n_links"))
