"""Operator 9, URL filters: allow and block rules, then a ratio of character language models.

Two variable-order Markov models over the bytes of the URL (host and path, lower case, digits as one
symbol) are counted over all pages: one of accepted URLs, one of rejected ones.  A URL is a rejected
example if its host has a term of ``rejected_terms``, the seed list, else an accepted one.  Counts are
exact: a table of all contexts of ``order`` bytes with their next byte, which grows with the corpus and
stays distributed, as do those of the shorter contexts, summed from it; probabilities back off from
each order to the next shorter with Dirichlet smoothing (weight ``strength``).  Tasks are given the n-grams
that are at least one in ``FREQUENT`` of all, ``FREQUENT`` of them at most; the others of a URL are joined
with the table, and none of them is frequent enough to make that join lopsided.  The score is the difference of the two log-likelihoods
per byte.  The cutoff is calibrated on the URLs whose crc32 modulo 5 is 0, which train no model: the
largest one that rejects at most ``false_rejections`` of the accepted.  URLs with a score under it
are blocked.

Rules are (action, host and path prefix).  A rule fits its host and all subdomains if the path starts
with the rule's; the longest that fits decides, before the models.

Edge cases: a null url, or one without ``://``, has an empty host and path, which no rule fits, and
score 0, which is allowed; repeated rows are judged alike, each on its own; with no accepted or no
rejected examples nothing is blocked by the models; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import materialize

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Fixed seed list: words of hosts that sell or cheat.
REJECTED_TERMS = ("casino", "cheap", "pills", "spam", "viagra", "poker", "betting", "xxx", "loan", "replica")
#: N-grams of one in so many or more are scored without a join.
FREQUENT = 10_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; null if none does."""
    name = action = F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        name, action = F.when(fits, rule).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def text_of(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all urls, each after a start mark and before an end mark, and where each begins."""
    raw = [b"\x02" + u.encode("utf-8", "replace") + b"\x03" for u in urls]
    sizes = np.asarray([len(r) for r in raw])
    return np.frombuffer(b"".join(raw), "uint8").astype("int64"), np.cumsum(sizes) - sizes


def gram_keys(urls: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ``order`` bytes before it, or as many as there are, and the number of them for each url.

    A key is a one bit followed by the bytes, so that keys of different lengths differ.
    """
    text, starts = text_of(urls)
    sizes = np.diff(np.append(starts, len(text)))
    place = np.arange(len(text)) - np.repeat(starts, sizes)
    keys = text.copy()
    for k in range(1, order + 1):
        keys[k:] |= np.where(place[k:] >= k, text[:-k] << (8 * k), 0)
    return keys | np.int64(1) << (8 * (np.minimum(place, order) + 1)), sizes


def _counter(order: int):
    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sizes = gram_keys(batch.column(0).to_pylist(), order)
            rejected, held = (np.repeat(np.asarray(batch.column(i).to_pylist(), bool), sizes) for i in (1, 2))
            found, which, n = np.unique(keys, return_inverse=True, return_counts=True)
            sums = (np.bincount(which, kind & ~held, len(found)).astype("int64") for kind in (~rejected, rejected))
            yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, sums), pa.array(n)], ["key", "accepted", "rejected", "n"])

    return count


def exact_model(counts: DataFrame, order: int, strength: float) -> DataFrame:
    """``key, n, ratio``: the logarithm of how much likelier each n-gram's last byte is in accepted urls."""
    kinds = ("accepted", "rejected")
    shorter = None
    for k in range(order + 1):
        least = 1 << (8 * (k + 1))
        key = F.when(F.col("key") < F.lit(least << 8), F.col("key")).otherwise(F.col("key").bitwiseAND(F.lit(least - 1)).bitwiseOR(F.lit(least)))
        own = counts.groupBy(key.alias("key")).agg(*(F.sum(c).alias(c) for c in (*kinds, "n")))
        # a context has 256 next bytes at most
        context = Window.partitionBy(F.shiftright("key", 8))
        own = own.withColumns({f"all_{c}": F.sum(c).over(context) for c in kinds})
        if shorter is None:
            own = own.withColumns({f"p_{c}": F.lit(1 / 256) for c in kinds})
        else:
            # the same n-gram without its first byte, if it has all
            tail = F.when(F.col("key") < F.lit(least), F.col("key")).otherwise(F.col("key").bitwiseAND(F.lit((least >> 8) - 1)).bitwiseOR(F.lit(least >> 8)))
            own = own.withColumn("tail", tail).join(shorter, "tail")
        own = own.withColumns({f"p_{c}": (F.col(c) + strength * F.col(f"p_{c}")) / (F.col(f"all_{c}") + strength) for c in kinds})
        shorter = own.select(F.col("key").alias("tail"), *(f"p_{c}" for c in kinds))
    return own.select("key", "n", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def _scorer(order: int, keys: np.ndarray, ratios: np.ndarray):
    """Sums of the frequent n-grams' ratios, and the keys of the others."""

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found, sizes = gram_keys(batch.column(0).to_pylist(), order)
            at = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
            known = keys[at] == found if len(keys) else np.zeros(len(found), bool)
            row = np.repeat(np.arange(len(sizes)), sizes)
            sums = np.bincount(row[known], ratios[at[known]], len(sizes)) if known.any() else np.zeros(len(sizes))
            ends = np.cumsum(np.bincount(row[~known], minlength=len(sizes)))
            rest = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype("int32")), pa.array(found[~known]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums), pa.array(sizes), rest], [*batch.schema.names, "known", "grams", "rest"])

    return score


def judge_urls(
    pages: DataFrame,
    rules=RULES,
    rejected_terms=REJECTED_TERMS,
    order: int = 4,
    strength: float = 3.0,
    false_rejections: float = 0.005,
) -> DataFrame:
    """``page_id, host, path, rule, score, verdict`` for each row of ``pages(page_id, url)``."""
    host, path = url_parts(F.col("url"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    # digits are one symbol: page numbers say nothing
    text = F.regexp_replace(F.concat(F.col("host"), F.lower("path")), "[0-9]", "0")
    seeds = F.col("host").rlike("|".join(rejected_terms))
    held = F.crc32(F.concat("host", "path")) % 5 == 0
    rows = base.select(text.alias("text"), seeds.alias("seed"), "page_id", "host", "path", held.alias("held"))

    texts = rows.where("text <> ''")
    counts = texts.select("text", "seed", "held").mapInArrow(_counter(order), "key long, accepted long, rejected long, n long")
    counts = materialize(counts.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("accepted", "rejected", "n"))), "url-counts")
    total = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("accepted", "rejected", "n"))).first()
    if not (total.accepted and total.rejected):
        scored, cutoff = rows.withColumn("score", F.lit(0.0)), float("-inf")
    else:
        model = materialize(exact_model(counts, order, strength), "url-model")
        # FREQUENT rows at most
        frequent = model.where(F.col("n") * FREQUENT >= total.n).orderBy("key").toPandas()
        scorer = _scorer(order, frequent.key.to_numpy("int64"), frequent.ratio.to_numpy("float64"))
        partly = texts.mapInArrow(scorer, "text string, seed boolean, page_id long, host string, path string, held boolean, known double, grams long, rest array<long>")
        partly = materialize(partly, "url-scores")
        rest = partly.where(F.size("rest") > 0).groupBy("text").agg(F.first("rest").alias("rest")).select("text", F.explode("rest").alias("key"))
        rest = rest.join(model, "key").groupBy("text").agg(F.sum("ratio").alias("more"))
        scores = (F.col("known") + F.coalesce("more", F.lit(0.0))) / F.col("grams")
        names = rows.columns
        whole = partly.where(F.size("rest") == 0).withColumn("more", F.lit(0.0)).select(*names, scores.alias("score"))
        joined = partly.where(F.size("rest") > 0).join(rest, "text", "left").select(*names, scores.alias("score"))
        scored = materialize(whole.unionByName(joined).unionByName(rows.where("text = ''").withColumn("score", F.lit(0.0))), "url-scored")
        quantile = scored.where("held and not seed and text <> ''").agg(F.percentile_approx("score", F.lit(false_rejections), F.lit(100_000)).alias("q")).first().q
        cutoff = min(0.0, quantile) if quantile is not None else float("-inf")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") < cutoff, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), "score", F.coalesce(action, own).alias("verdict"))
