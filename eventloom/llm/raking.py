"""Operator 4, mixing sources to target weights by iterative proportional fitting.  Native: DataFrame functions only.

Documents fall into cells by source, language and topic.  The cells' token weights are raked: scaled to
the target share of each source, then of each language, then of each topic, again and again until all
three marginals hold within ``tolerance``.  A document is then sampled with probability
``weight / tokens`` of its cell, over the largest such ratio, so expected tokens have the target
marginals exactly.  The draw is a hash of the id: the same input gives the same sample on every run.

Targets are shares; those not given are the observed token shares to the power of an exponent, which
flattens them; they give way where no weights of the cells there are could have them, whereas given
targets that can't be met raise an error (``rake``).  Only the table of cells, one row for each combination, is iterated over; every few sweeps
are one written table.  It is broadcast where it has ``most_broadcast`` rows or fewer, else joined by key.

Edge cases: null source, language or topic is the value ``unknown``; null or empty texts have no tokens
and the probability of their cell (1 where no text of it has tokens); rows with equal ids are drawn
alike, those without an id by their text; a given target that no document has is left out and the rest scaled to sum to 1; observed values
without a given target get 0; an empty table gives no rows; columns of ours that the table has already
(``topic``, ``tokens``, ``probability``, ``sampled``) are replaced, other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import WORD_SEP, materialize

DIMENSIONS = ("source", "lang", "topic")
EXPONENTS = {"source": 0.85, "lang": 0.9, "topic": 0.95}
ADDED = ("topic", "tokens", "probability", "sampled")


def topic_of(text: Column) -> Column:
    """A coarse topic by what a text has; for tables without one."""
    has = text.contains
    return (
        F.when(has(" | "), "table")
        .when(has("icense") | has("opyright"), "legal")
        .when(has("@"), "contact")
        .when(has("password") | has("token ="), "config")
        .otherwise("prose")
    )


def _targets(cells: DataFrame, name: str, given: dict[str, float] | None) -> DataFrame:
    """``name, share, seen``: target and observed share of each observed value."""
    seen = cells.groupBy(name).agg(F.sum("tokens").alias("t")).where("t > 0")
    observed = F.col("t") / F.sum("t").over(Window.partitionBy())
    if given is None:
        raw = F.pow(observed, EXPONENTS.get(name, 1.0))
    else:
        raw = F.lit(0.0)
        for value, share in given.items():
            raw = F.when(F.col(name) == value, float(share)).otherwise(raw)
    return seen.select(name, raw.alias("raw"), observed.alias("seen")).select(name, (F.col("raw") / F.sum("raw").over(Window.partitionBy())).alias("share"), "seen")


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, tolerance: float = 1e-6, sweeps: int = 5, most_rounds: int = 40) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` with ``weight``, whose sums have the target shares.

    Not all targets can be met by the cells there are.  Derived ones that aren't met within ``most_rounds``
    rounds go back by half, and by half again, towards the observed shares, which can be met; the last step
    is these themselves.  Where given ones stand in the way of that, this raises ``ValueError``.
    """
    targets = targets or {}
    start = cells.withColumn("weight", F.col("tokens").cast("double"))
    for name in DIMENSIONS:
        start = start.join(_targets(cells, name, targets.get(name)).withColumnsRenamed({"share": f"_{name}", "seen": f"_seen_{name}"}), name, "left")
    extra = [f"{mark}{name}" for name in DIMENSIONS for mark in ("_", "_seen_")]
    start = materialize(start.fillna(0.0, extra), "raking")
    total = start.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return start.drop(*extra)

    def own(name: str) -> Column:
        return F.sum("weight").over(Window.partitionBy(name))

    gap = float("inf")
    for share in (1.0, 0.5, 0.25, 0.0):
        table, gap = start, float("inf")
        for name in DIMENSIONS:
            if name not in targets:
                table = table.withColumn(f"_{name}", share * F.col(f"_{name}") + (1 - share) * F.col(f"_seen_{name}"))
        for turn in range(most_rounds):
            for _ in range(sweeps):
                for name in DIMENSIONS:
                    table = table.withColumn("weight", F.when(own(name) > 0, F.col("weight") * F.col(f"_{name}") * float(total) / own(name)).otherwise(0.0))
            table = materialize(table, "raking")
            before, gap = gap, table.select(F.greatest(*(F.abs(own(name) / float(total) - F.col(f"_{name}")) for name in DIMENSIONS)).alias("gap")).agg(F.max("gap")).first()[0]
            if gap <= tolerance:
                return table.drop(*extra)
            if turn > 2 and gap > 0.999 * before:
                break  # no cells that could carry the rest
        if len(targets) == len(DIMENSIONS):
            break
    raise ValueError(f"the given target shares can't be met by the cells there are: a share is off by {gap:.3g}")


def mix(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    topic: Column | None = None,
    seed: int = 17,
    most_broadcast: int = 50_000,
    **options,
) -> DataFrame:
    """``docs(doc_id, text, source, lang, ...)`` with topic, tokens, probability and ``sampled``."""
    others = [c for c in docs.columns if c not in ADDED]
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.size(F.array_remove(F.split(text, WORD_SEP), "")).cast("long")
    placed = docs.select(*others, (topic if topic is not None else topic_of(text)).alias("topic"), tokens.alias("tokens"))
    keys = [F.coalesce(F.col(name), F.lit("unknown")).alias(f"_{name}") for name in DIMENSIONS]
    cells = placed.select(*keys, "tokens").groupBy(*(f"_{n}" for n in DIMENSIONS)).agg(F.sum("tokens").alias("tokens"))
    cells = materialize(cells.select(*(F.col(f"_{n}").alias(n) for n in DIMENSIONS), "tokens"), "raking-cells")
    raked = rake(cells, targets, **options)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    largest = raked.agg(F.max(ratio)).first()[0]
    rates = raked.select(*(F.col(n).alias(f"_{n}") for n in DIMENSIONS), F.coalesce(ratio / float(largest or 1.0), F.lit(1.0)).alias("probability"))
    if rates.limit(most_broadcast + 1).count() <= most_broadcast:
        rates = F.broadcast(rates)
    joined = placed.select("*", *keys).join(rates, [f"_{n}" for n in DIMENSIONS], "left")
    of = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(seed))).otherwise(F.xxhash64(text, F.lit(seed), F.lit("text")))
    draw = F.shiftrightunsigned(of, 11) / F.lit(float(1 << 53))
    return joined.select(*others, "topic", "tokens", "probability", (draw < F.col("probability")).alias("sampled"))
