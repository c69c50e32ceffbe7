"""Text facts, JSON and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import dates, text
from eventloom.functions.geo import geo_dim
from eventloom.plans.adapters import PAGE_TITLE, page_title, read_entities, table
from eventloom.plans.registry import query
from eventloom.sources import listings
from eventloom.sources.feeds import forecast, widest
from eventloom.sources.html import page_facts


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


_K = "CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS BIGINT)"


@query(f"SELECT event_id AS id, {_K} AS k, {_K} * 2 + 1 AS odd FROM events WHERE {_K} > 10")
def q_json_props(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), k.alias("k"), (k * 2 + 1).alias("odd")).where("k > 10")


@query(
    """SELECT vec_id AS id, i AS day, CAST(floor(embedding[i] * 10 + 0.5) AS INTEGER) AS most FROM embeddings, range(1, 5) AS g(i)"""
)
def q_zip_arrays(spark, sf_dir):
    first = F.slice("embedding", 1, 4)
    series = forecast(F.array(*map(F.lit, range(1, 5))), F.transform(first, lambda x: x.cast("double") * 10), F.transform(first, lambda x: x.cast("double")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.inline(series)).select("id", F.col("date").cast("long").alias("day"), F.col("tMaxC").alias("most"))


@query("SELECT l_orderkey AS id, 'u' || max(CAST(l_quantity AS INTEGER) * 1000 + l_linenumber) AS url FROM lineitem GROUP BY 1")
def q_argmax_nested(spark, sf_dir):
    width = F.col("l_quantity").cast("int") * 1000 + F.col("l_linenumber")
    image = F.struct(width.alias("width"), F.concat(F.lit("u"), width.cast("string")).alias("url"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(image).alias("images"))
    return rows.select("id", widest(F.col("images")).alias("url"))


@query(f"SELECT event_id AS id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE {_K} END AS k FROM events")
def q_tolerant_json(spark, sf_dir):
    key = F.col("event_id")
    said = F.when(key % 5 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(key % 5 == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done")))
    said = said.when(key % 5 == 4, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select(key.alias("id"), F.try_variant_get(text.tolerant_json(said), "$.k", "long").alias("k"))


@query("SELECT doc_id AS id, doc_id % 4 <> 3 AS free FROM documents")
def q_free_regex(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, ["Ingresso LIBERO", "Evento gratuito", "Вход БЕСПЛАТНО", "12 euro"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), text.free_from_price(said).alias("free"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'ru' ELSE 'en' END AS lang FROM documents")
def q_lang(spark, sf_dir):
    said = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" концерт"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), text.detect_language(said).alias("lang"))


@query("SELECT o_orderkey AS id, ['art','music','theatre','family','food',NULL,'culture'][o_orderkey % 7 + 1] AS hint FROM orders")
def q_hint(spark, sf_dir):
    labels = ["Mostre d'arte", "CONCERTI e teatro", "Spettacoli", "Bambini", "sagra e sport? no: Gastronomia", "nulla", "Visite"]
    said = F.element_at(F.array(*map(F.lit, labels)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    said = F.regexp_replace(said, " e sport\\? no", "")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.category_hint(said).alias("hint"))


@query(
    """SELECT o_orderkey AS id, lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS time,
         '€ ' || (o_orderkey % 50) AS price FROM orders"""
)
def q_fact_regex(spark, sf_dir):
    key = F.col("o_orderkey")
    said = F.concat(F.lit("Sabato ore "), (key % 24).cast("string"), F.lit("."), F.lpad((key % 60).cast("string"), 2, "0"), F.lit(", biglietto € "), (key % 50).cast("string"), F.lit(" intero"))
    return table(spark, sf_dir, "orders").select(key.alias("id"), text.time_fact(said).alias("time"), text.price_fact(said).alias("price"))


@query(
    """SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start,
         CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 3 > 0 THEN CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) AS VARCHAR) END AS finish FROM orders"""
)
def q_date_range(spark, sf_dir):
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    later = F.date_add(day, (key % 5).cast("int"))
    shown = lambda d: F.date_format(d, "dd/MM/yyyy")
    said = F.when(key % 3 == 0, shown(day)).when(key % 3 == 1, F.concat(F.lit("Dal "), shown(day), F.lit(" al "), shown(later))).otherwise(F.concat(shown(day), F.lit(" - "), shown(later)))
    span = dates.numeric_range(said)
    return table(spark, sf_dir, "orders").select(key.alias("id"), span["start"].alias("start"), span["end"].alias("finish"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 1 OR doc_id % 5 < 3 OR doc_id % 11 = 0")
def q_reenrich(spark, sf_dir):
    key = F.col("doc_id")
    said = F.when(key % 11 == 0, F.concat("text", F.lit("日本"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).where((key % 2 == 1) | (key % 5 < 3) | text.has_cjk(said)).select(key.alias("id"))


@query("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source ELSE '' END AS shown FROM documents")
def q_i18n_pick(spark, sf_dir):
    key = F.col("doc_id")
    texts = F.struct(F.when(key % 3 == 1, F.col("source")).alias("en"), F.when(key % 3 == 0, F.col("lang")).otherwise("").alias("it"), F.lit(None).cast("string").alias("ru"))
    return _docs(spark, sf_dir).select(key.alias("id"), text.localized(texts, "it").alias("shown"))


_HEADLINE = read_entities("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g')")


@query(
    f"""SELECT page_id AS id, {_HEADLINE} AS headline,
         regexp_extract(html, '<a[^>]+href="([^"]*)"', 1) AS first_href, CAST(len(regexp_extract_all(html, '<a[^>]+href=')) AS INTEGER) AS n_links FROM pages"""
)
def q_html_extract(spark, sf_dir):
    facts = page_facts(F.col("html"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), *(c.alias(n) for n, c in facts.items()))


@query(f"SELECT page_id AS id, {PAGE_TITLE} AS title FROM pages")
def q_entities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), page_title().alias("title"))


@query(
    """SELECT o_orderkey AS id, 'Sagra ' || o_orderkey || ' & Co' AS title, 'https://n.example/' || o_orderkey AS url, ['genova', 'bergamo', 'laquila'][o_orderkey % 4 + 1] AS city, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
         CASE WHEN o_orderkey % 5 > 0 THEN CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) AS VARCHAR) END AS finish FROM orders WHERE o_orderkey % 4 < 3"""
)
def q_national(spark, sf_dir):
    """Cards of a national search, one a page; those of an unknown province are dropped."""
    key, start = F.col("o_orderkey").cast("string"), F.col("o_orderdate").cast("date")
    shown = lambda d: F.date_format(d, "dd/MM/yyyy")
    place = F.element_at(F.array(*map(F.lit, ["Recco (GE)", "Lovere (BG)", "Scoppito (AQ)", "Altrove (ZZ)"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    html = F.concat(
        F.lit('<div class="risultatoEvento"><a href="/'), key, F.lit('">x</a><h3 class="titolo">Sagra '), key, F.lit(' &amp; Co</h3><div><b>Dal</b> '), shown(start),
        F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit(" <b>Al</b> "), shown(F.date_add(start, (F.col("o_orderkey") % 5).cast("int"))))).otherwise(""), F.lit('</div><span class="corsivo">'), place, F.lit("</span></div>"),
    )
    rows = listings.national_search(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), html.alias("html")), "n", "https://n.example", geo_dim(spark))
    city = F.replace("city", F.lit("-"), F.lit(""))
    return rows.select("id", "title", "url", city.alias("city"), F.col("startDate").cast("string").alias("day"), F.col("endDate").cast("string").alias("finish"))


@query(
    """SELECT o_orderkey AS id, 'Mostra ' || o_orderkey AS title, 'Sala ' || o_orderkey % 7 AS venue, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
         lpad(CAST(9 + o_orderkey % 12 AS VARCHAR), 2, '0') || ':30' AS time, 'art' AS hint FROM orders"""
)
def q_palace(spark, sf_dir):
    """Cards whose days are words: ``Sala 3 7 lug 1996, ore 9.30``."""
    key, start = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    month = F.get(F.array(*map(F.lit, dates.MONTHS)), F.month(start) - 1)
    said = F.concat(F.lit("Sala "), (key % 7).cast("string"), F.lit(" "), F.dayofmonth(start).cast("string"), F.lit(" "), month, F.lit("aio. "), F.year(start).cast("string"), F.lit(", ore "), (9 + key % 12).cast("string"), F.lit(".30"))
    html = F.concat(F.lit('<article class="exhibition-item"><h2 class="exhibition-title"><a href="/'), key.cast("string"), F.lit('">Mostra '), key.cast("string"), F.lit('</a></h2><p class="exhibition-type">Arte</p><p class="exhibition-info">'), said, F.lit("</p></article>"))
    rows = listings.palace_cards(table(spark, sf_dir, "orders").select(key.alias("id"), html.alias("html")), "p", "https://p.example", "genova")
    return rows.select("id", "title", "venue", F.col("startDate").cast("string").alias("day"), "time", F.col("categoryHint").alias("hint"))
