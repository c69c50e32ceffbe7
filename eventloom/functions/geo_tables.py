"""Italian provinces: capital, region and the capital's centre."""

from __future__ import annotations

# Province code, capital, region, latitude and longitude of the capital's centre.
PROVINCES = [
    ("AG", "Agrigento", "Sicilia", 37.3123, 13.5747),
    ("AL", "Alessandria", "Piemonte", 44.835, 8.745),
    ("AN", "Ancona", "Marche", 43.4801, 13.2187),
    ("AO", "Aosta", "Valle d'Aosta", 45.7373, 7.3204),
    ("AP", "Ascoli Piceno", "Marche", 42.8834, 13.5396),
    ("AQ", "L'Aquila", "Abruzzo", 42.1369, 13.6103),
    ("AR", "Arezzo", "Toscana", 43.5171, 11.7639),
    ("AT", "Asti", "Piemonte", 44.826, 8.2027),
    ("AV", "Avellino", "Campania", 40.9965, 15.1406),
    ("BA", "Bari", "Puglia", 41.1258, 16.862),
    ("BG", "Bergamo", "Lombardia", 45.7567, 9.7542),
    ("BI", "Biella", "Piemonte", 45.567, 8.0869),
    ("BL", "Belluno", "Veneto", 46.2805, 12.0789),
    ("BN", "Benevento", "Campania", 41.2476, 14.7057),
    ("BO", "Bologna", "Emilia-Romagna", 44.4938, 11.3426),
    ("BR", "Brindisi", "Puglia", 40.6359, 17.6885),
    ("BS", "Brescia", "Lombardia", 45.7796, 10.4259),
    ("BT", "Barletta", "Puglia", 41.3215, 16.2869),
    ("BZ", "Bolzano", "Trentino-Alto Adige", 46.6559, 11.2302),
    ("CA", "Cagliari", "Sardegna", 39.2172, 9.1133),
    ("CB", "Campobasso", "Molise", 41.7173, 14.8262),
    ("CE", "Caserta", "Campania", 41.2035, 14.1169),
    ("CH", "Chieti", "Abruzzo", 42.1027, 14.4159),
    ("CL", "Caltanissetta", "Sicilia", 37.4903, 14.0633),
    ("CN", "Cuneo", "Piemonte", 44.4581, 7.5581),
    ("CO", "Como", "Lombardia", 45.9395, 9.1494),
    ("CR", "Cremona", "Lombardia", 45.2209, 10.037),
    ("CS", "Cosenza", "Calabria", 39.5967, 16.3331),
    ("CT", "Catania", "Sicilia", 37.5024, 15.0874),
    ("CZ", "Catanzaro", "Calabria", 38.83, 16.4316),
    ("EN", "Enna", "Sicilia", 37.5668, 14.2807),
    ("FC", "Forlì", "Emilia-Romagna", 44.2227, 12.0413),
    ("FE", "Ferrara", "Emilia-Romagna", 44.7668, 11.8279),
    ("FG", "Foggia", "Puglia", 41.5028, 15.4529),
    ("FI", "Firenze", "Toscana", 43.7698, 11.2556),
    ("FM", "Fermo", "Marche", 43.0922, 13.6388),
    ("FR", "Frosinone", "Lazio", 41.6285, 13.5758),
    ("GE", "Genova", "Liguria", 44.4073, 8.9339),
    ("GO", "Gorizia", "Friuli-Venezia Giulia", 45.9441, 13.6252),
    ("GR", "Grosseto", "Toscana", 42.7751, 11.2878),
    ("IM", "Imperia", "Liguria", 43.9584, 7.8667),
    ("IS", "Isernia", "Molise", 41.6495, 14.2081),
    ("KR", "Crotone", "Calabria", 39.1874, 16.8783),
    ("LC", "Lecco", "Lombardia", 45.9005, 9.412),
    ("LE", "Lecce", "Puglia", 40.1522, 18.2261),
    ("LI", "Livorno", "Toscana", 42.7902, 10.3402),
    ("LO", "Lodi", "Lombardia", 45.2613, 9.4917),
    ("LT", "Latina", "Lazio", 41.4595, 13.0126),
    ("LU", "Lucca", "Toscana", 44.0178, 10.4544),
    ("MB", "Monza", "Lombardia", 45.6395, 9.2788),
    ("MC", "Macerata", "Marche", 43.153, 13.1509),
    ("ME", "Messina", "Sicilia", 38.1938, 15.5542),
    ("MI", "Milano", "Lombardia", 45.4642, 9.1896),
    ("MN", "Mantova", "Lombardia", 45.1693, 10.6708),
    ("MO", "Modena", "Emilia-Romagna", 44.5385, 10.936),
    ("MS", "Massa", "Toscana", 44.0359, 10.1396),
    ("MT", "Matera", "Basilicata", 40.4476, 16.4736),
    ("NA", "Napoli", "Campania", 40.8359, 14.2488),
    ("NO", "Novara", "Piemonte", 45.5842, 8.546),
    ("NU", "Nuoro", "Sardegna", 40.2641, 9.1272),
    ("OR", "Oristano", "Sardegna", 40.0266, 8.6796),
    ("PA", "Palermo", "Sicilia", 38.1112, 13.3524),
    ("PC", "Piacenza", "Emilia-Romagna", 44.8476, 9.6665),
    ("PD", "Padova", "Veneto", 45.3914, 11.8058),
    ("PE", "Pescara", "Abruzzo", 42.3103, 13.9576),
    ("PG", "Perugia", "Umbria", 43.107, 12.403),
    ("PI", "Pisa", "Toscana", 43.4715, 10.6798),
    ("PN", "Pordenone", "Friuli-Venezia Giulia", 45.9563, 12.6597),
    ("PO", "Prato", "Toscana", 43.9357, 11.0941),
    ("PR", "Parma", "Emilia-Romagna", 44.6952, 10.098),
    ("PT", "Pistoia", "Toscana", 43.9741, 10.8687),
    ("PU", "Pesaro", "Marche", 43.9098, 12.9131),
    ("PV", "Pavia", "Lombardia", 45.0369, 9.1378),
    ("PZ", "Potenza", "Basilicata", 40.5173, 15.8216),
    ("RA", "Ravenna", "Emilia-Romagna", 44.3641, 12.059),
    ("RC", "Reggio Calabria", "Calabria", 38.1035, 15.6398),
    ("RE", "Reggio Emilia", "Emilia-Romagna", 44.6087, 10.5941),
    ("RG", "Ragusa", "Sicilia", 36.9257, 14.7308),
    ("RI", "Rieti", "Lazio", 42.4147, 12.8859),
    ("RM", "Roma", "Lazio", 41.8933, 12.4829),
    ("RN", "Rimini", "Emilia-Romagna", 43.9465, 12.6307),
    ("RO", "Rovigo", "Veneto", 44.9776, 12.2801),
    ("SA", "Salerno", "Campania", 40.4194, 15.3106),
    ("SI", "Siena", "Toscana", 43.1672, 11.4676),
    ("SO", "Sondrio", "Lombardia", 46.3234, 10.2584),
    ("SP", "La Spezia", "Liguria", 44.2384, 9.6912),
    ("SR", "Siracusa", "Sicilia", 37.0316, 15.2124),
    ("SS", "Sassari", "Sardegna", 40.7235, 8.5613),
    ("SU", "Carbonia", "Sardegna", 39.1653, 8.5278),
    ("SV", "Savona", "Liguria", 44.2334, 8.2526),
    ("TA", "Taranto", "Puglia", 40.5488, 17.0806),
    ("TE", "Teramo", "Abruzzo", 42.6581, 13.6979),
    ("TN", "Trento", "Trentino-Alto Adige", 46.103, 11.1297),
    ("TO", "Torino", "Piemonte", 45.0678, 7.6825),
    ("TP", "Trapani", "Sicilia", 37.9004, 12.7116),
    ("TR", "Terni", "Umbria", 42.6539, 12.4397),
    ("TS", "Trieste", "Friuli-Venezia Giulia", 45.6496, 13.7773),
    ("TV", "Treviso", "Veneto", 45.8067, 12.2063),
    ("UD", "Udine", "Friuli-Venezia Giulia", 46.0635, 13.2358),
    ("VA", "Varese", "Lombardia", 45.8399, 8.7542),
    ("VB", "Verbania", "Piemonte", 45.9344, 8.558),
    ("VC", "Vercelli", "Piemonte", 45.5554, 8.3463),
    ("VE", "Venezia", "Veneto", 45.4046, 12.3105),
    ("VI", "Vicenza", "Veneto", 45.6349, 11.4064),
    ("VR", "Verona", "Veneto", 45.4425, 10.9857),
    ("VT", "Viterbo", "Lazio", 42.493, 11.9488),
    ("VV", "Vibo Valentia", "Calabria", 38.6267, 16.0987),
]


def rows() -> list[tuple[str, str, str, float, float]]:
    """(code, capital, region, latitude, longitude)."""
    return PROVINCES
