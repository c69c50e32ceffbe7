"""Each kind of source on a literal page."""

import datetime as dt
import json

from eventloom.functions.geo import geo_dim
from eventloom.sources import listings

BASE = "https://site.example"


def pages(spark, *html, **more):
    names = list(more)
    return spark.createDataFrame([(h, *more.values()) for h in html], ", ".join(f"{n} string" for n in ("html", *names)))


def rows(df):
    return sorted(({k: v for k, v in r.asDict(True).items() if v is not None and k not in ("at", "source")} for r in df.collect()), key=lambda r: r["title"])


def day(d, month=7, year=2026):
    return dt.date(year, month, d)


def test_dated_headings(spark):
    html = """<div class="x grid-item big"><a href="/ev/1"><img src="i.jpg"></a><h4>01/07/2026 - 31/08/2026 Caff&egrave; <b>Rock</b></h4><div class="category_event">CONCERTI</div></div>
      <div class="grid-item"><a href="http://o.example/2"></a><h4>03/07/2026 Solo</h4></div><div class="grid-item"><a href="/ev/3"></a><h4>Senza data</h4></div><div class="grid-items"><a href="/no"></a><h4>03/07/2026 No</h4></div>"""
    assert rows(listings.dated_headings(pages(spark, html), "a", BASE, "genova")) == [
        {"title": "Caffè Rock", "startDate": day(1), "endDate": day(31, 8), "url": f"{BASE}/ev/1", "city": "genova", "categoryHint": "music", "image": f"{BASE}/i.jpg"},
        {"title": "Solo", "startDate": day(3), "url": "http://o.example/2", "city": "genova"},
    ]


def test_city_agenda(spark):
    html = """<div class="Evento"><a href="http://tickets.example/1">T</a><a href="/milano/9">x</a><img data-src="/lazy.jpg" src="/now.jpg"><span class="Titolo">Jazz &amp; Co</span><span class="Date">Dal 09/07/2026 al 12/07/2026</span></div>
      <div class="Evento"><a href="/milano/10">x</a><span class="Titolo"></span><span class="Date">09/07/2026</span></div>"""
    assert rows(listings.city_agenda(pages(spark, html, city="milano"), "b", BASE)) == [
        {"title": "Jazz & Co", "startDate": day(9), "endDate": day(12), "url": f"{BASE}/milano/9", "city": "milano", "image": f"{BASE}/lazy.jpg"}
    ]


def test_national_search(spark):
    card = '<div class="risultatoEvento"><a href="/{0}"><img src="//cdn.example/{0}.jpg"></a><h3 class="titolo">Sagra {0}</h3><div><b>Dal</b> 10/07/2026 <b>Al</b> {1}</div><span class="corsivo">{2}</span></div>'
    html = card.format(1, "12/07/2026", "Lovere (BG)") + card.format(2, "01/01/2026", "Recco (GE)") + card.format(3, "12/07/2026", "Nowhere (ZZ)") + card.format(4, "12/07/2026", "Senza provincia")
    assert rows(listings.national_search(pages(spark, html), "n", BASE, geo_dim(spark))) == [
        {"title": "Sagra 1", "startDate": day(10), "endDate": day(12), "url": f"{BASE}/1", "city": "bergamo", "venue": "Lovere", "image": "https://cdn.example/1.jpg"},
        {"title": "Sagra 2", "startDate": day(10), "url": f"{BASE}/2", "city": "genova", "venue": "Recco", "image": "https://cdn.example/2.jpg"},
    ]


def test_theatre_cards(spark):
    html = '<div class="Evento"><a href="/show/1"><img src="/p.jpg"></a><span class="Title">Amleto</span><span class="Date">05/07/2026</span><span class="Abstract">Una tragedia &ndash; lunga</span></div>'
    assert rows(listings.theatre_cards(pages(spark, html), "t", BASE, "genova")) == [
        {"title": "Amleto", "startDate": day(5), "url": f"{BASE}/show/1", "city": "genova", "categoryHint": "theatre", "rawDescription": "Una tragedia – lunga", "image": f"{BASE}/p.jpg"}
    ]


def test_palace_cards(spark):
    card = '<article class="exhibition-item"><img src="/p.jpg"><h2 class="exhibition-title"><a href="https://p.example/{0}">Titolo {0}</a></h2><p class="exhibition-type">{1}</p><p class="exhibition-info">{2}</p></article>'
    html = card.format(1, "Mostra", "Palazzo Ducale, Munizioniere 06 lug 2026 — 08 lug 2026, ore 9.30") + card.format(2, "Incontro", "Villa Croce 7 luglio 2026") + card.format(3, "Altro", "01 set 2026") + card.format(4, "x", "presto")
    got = rows(listings.palace_cards(pages(spark, html), "p", BASE, "genova"))
    assert got[0] == {"title": "Titolo 1", "startDate": day(6), "endDate": day(8), "time": "09:30", "venue": "Palazzo Ducale, Munizioniere", "url": "https://p.example/1", "city": "genova", "lat": 44.40758, "lng": 8.93436, "categoryHint": "art", "image": f"{BASE}/p.jpg"}
    assert [(r.get("venue"), r["startDate"], r.get("lat"), r.get("categoryHint")) for r in got[1:]] == [("Villa Croce", day(7), None, "culture"), (None, day(1, 9), 44.40758, None)]


def test_season_slides(spark):
    slide = '<a class="swiper-slide-inner" href="https://o.example/{0}"><div class="elementor-slide-heading">{1}</div><div class="elementor-slide-description">{2}</div></a>'
    html = "".join(
        slide.format(*x)
        for x in [
            ("spettacolo/paganini_1/", "Paganini_1", "Dal 16 al 25 ottobre 2026"), ("spettacolo/paganini_2/", "Paganini_2", "3 novembre 2026"), ("spettacolo/paganini_1/", "Paganini_1", "Dal 16 al 25 ottobre 2026"),
            ("spettacolo/tosca/", "Tosca", "Dall'11 al 13 dicembre 2026"), ("notizie/altro/", "Altro", "1 ottobre 2026"), ("spettacolo/vuoto/", "Vuoto", "presto"),
        ]
    )
    got = rows(listings.season_slides(pages(spark, html), "o", "https://o.example", "genova", "Teatro"))
    assert [(r["title"], r["startDate"], r["endDate"], r["url"], [x["url"] for x in r.get("altLinks", [])]) for r in got] == [
        ("Paganini", day(16, 10), day(3, 11), "https://o.example/spettacolo/paganini_1/", ["https://o.example/spettacolo/paganini_2/"]),
        ("Tosca", day(11, 12), day(13, 12), "https://o.example/spettacolo/tosca/", []),
    ]


def test_rest_posts(spark):
    terms = json.dumps([{"id": 7, "name": "Piazza &egrave;"}, {"name": "x"}])
    html = '<p>Marted&igrave; 21 luglio 2026 &ndash; ore 21.30</p><img class="a" src="https://i.example/1.jpg">'
    posts = json.dumps([
        {"title": {"rendered": "Luna &amp; Sole"}, "link": "https://r.example/1", "content": {"rendered": html}, "location-eventi": [7]},
        {"title": {"rendered": "Comunicato"}, "link": "https://r.example/2", "content": {"rendered": "<p>senza data</p>"}, "location-eventi": []},
    ])
    body = lambda x: spark.createDataFrame([(x,)], "body string")
    assert rows(listings.rest_posts(body(posts), body(terms), "r", "genova")) == [
        {"title": "Luna & Sole", "startDate": day(21), "time": "21:30", "venue": "Piazza è", "rawDescription": "Martedì 21 luglio 2026 – ore 21.30", "url": "https://r.example/1", "city": "genova", "image": "https://i.example/1.jpg"}
    ]
    assert rows(listings.rest_posts(body("not json"), body(terms), "r", "genova")) == []


def test_ticket_events(spark):
    def event(n, venue, **more):
        return {"name": f"Show {n}", "url": f"https://k.example/{n}", "dates": {"start": {"localDate": "2026-07-0" + str(n), "localTime": "21:00:00"}, **({"end": {"localDate": "2026-07-02"}} if n == 1 else {})}, "_embedded": {"venues": [venue]}, **more}

    arena = {"name": "Arena", "city": {"name": "Rho"}, "address": {"line1": "via X"}, "location": {"latitude": "45.5", "longitude": "9.1"}}
    nowhere = {"name": "Hall", "city": {"name": "Torino"}, "location": {"latitude": "0", "longitude": "0"}}
    more = {"classifications": [{"segment": {"name": "Music"}}], "images": [{"url": "s", "width": 10}, {"url": "w", "width": 900}, {"width": 9999}], "priceRanges": [{"min": 10.0, "max": 25.5, "currency": "EUR"}]}
    body = json.dumps({"_embedded": {"events": [event(1, arena, **more), event(2, nowhere), event(3, {"name": "Lost", "city": {"name": "Paese"}})]}})
    got = rows(listings.ticket_events(spark.createDataFrame([(body,)], "body string"), "k", geo_dim(spark)))
    assert got == [
        {"title": "Show 1", "startDate": day(1), "endDate": day(2), "time": "21:00", "venue": "Arena", "address": "Arena, via X, Rho", "priceInfo": "10–25.5 EUR", "url": "https://k.example/1", "city": "milano", "lat": 45.5, "lng": 9.1, "categoryHint": "music", "image": "w"},
        {"title": "Show 2", "startDate": day(2), "time": "21:00", "venue": "Hall", "address": "Hall, Torino", "url": "https://k.example/2", "city": "torino"},
    ]


def test_channel_posts(spark):
    post = '<div class="tgme_widget_message js" data-post="chan/{0}"><div class="tgme_widget_message_text">{1}</div><a class="tgme_widget_message_date"><time datetime="{2}"></time></a></div>'
    html = post.format(5, "Ciao<br/>tutti", "2026-07-01T10:00:00+00:00") + post.format(6, " ", "2026-07-01T10:00:00+00:00") + post.format(7, "vecchio", "2020-07-01T10:00:00+00:00") + post.format("x", "?", "2026-07-01T10:00:00+00:00")
    got = listings.channel_posts(pages(spark, html, channel="chan"), 1782900000).collect()
    assert [tuple(r) for r in got] == [("chan", 5, 1782900000, "Ciao tutti")]
