"""Operator 6, secret scan: candidates, then a random forest that removes false positives.  Native: JVM only.

Candidates are all longest runs of letters, digits and ``+/_.-`` (and ``=`` behind them) whatever stands around
them, several in a word if need be: those of ``min_chars`` or more characters with a digit, known shapes, and, where
a credential's name and ``=`` or ``:`` or an address's user stand before them, those of any length.  Each has features of its
length, character classes and their transitions (all, between letters and digits, between cases), vowels, distinct characters, dictionary coverage, path signs, and
of the words before it.  Spark ML's random forest is trained on labelled findings and scores them all.

Findings are labelled by ``labels``: rows (value, label).  Where none are given, fixed formats stand in
for a reviewer: what has the shape of a known provider's key or is assigned to a credential's name is a
secret; plain numbers, addresses, paths and dates aren't; the rest has no label and trains nothing.
Training takes at most ``max_rows`` labelled candidates, by smallest hash; scoring takes all.

Edge cases: null and empty texts have no candidates; repeated rows each report theirs; a null doc_id is
reported as null; without labels of both kinds every candidate keeps score 0.5 and is reported; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import WORD_SEP, bounded_sample, materialize

#: Shapes of providers' keys, and names that credentials are assigned to.
KNOWN_KEYS = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\..*)$"
CREDENTIAL_NAMES = "passwd|password|pwd|secret|token|api_key|apikey|access_key|auth|credential"
#: What may stand between a name's ``=`` or ``:`` and its value, and a name that a value follows.
_OPENING = r"[\"'`(\[{<\s]*"
_NAMED = rf"(?i)({CREDENTIAL_NAMES})[\"'`\])]*\s*[=:]+>?{_OPENING}$"
_KEY_STARTS = "AKIA|ASIA|gh[pousr]_|sk_live_|xox[abprs]-|AIza|eyJ"
#: What stands before a run, and the run; ``=`` is of it only where nothing of another follows.
#: The last run is an empty one, behind what the word ends in, so that no place is looked at twice.
_RUNS = r"([^A-Za-z0-9+/_.-]*+)([A-Za-z0-9+/_.-]+(?:=+(?![A-Za-z0-9+/_.=-]))?|$)"
#: Characters of the words before one in which a credential's name is looked for.
LOOK_BACK = 200
#: Common words and word parts of the corpus languages.
DICTIONARY = (
    "tion ment heit keit lich schaft ungen ung ing ed ly er es the and that with from this have are was were not you for "
    "der die das und ist nicht mit von ein eine les des une est pas que los las con por para del page item user name data file index html http www com net org"
).split()
FEATURES = ("chars", "digit_share", "upper_share", "lower_share", "other_share", "transition_share", "letter_digit_share", "case_share", "vowel_share", "distinct_share", "hex_only", "dictionary_share", "slashes", "dots", "credential_near", "assigned", "quoted")


def candidates(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``doc_id, word_at, in_quotes, has_at, value, before, of_user`` of each candidate.

    ``before`` is what its word has before it, behind the two words before, of which it has the last ``LOOK_BACK`` characters.
    """
    words = F.array_remove(F.split(F.col("text"), WORD_SEP), "")
    long = rf"[A-Za-z0-9+/_.-]{{{min_chars}}}"
    maybe = docs.where(F.col("text").rlike(rf"{long}|(?i:{CREDENTIAL_NAMES})|://[^/\s]*@")).select("doc_id", words.alias("w"))

    def zipped(**arrays):
        """Structs of the arrays' elements: each array is made once, not for each element."""
        return F.arrays_zip(*(array.alias(name) for name, array in arrays.items()))

    none = F.array(F.lit(""))
    maybe = maybe.select("doc_id", zipped(w=F.col("w"), last=F.concat(none, "w"), second=F.concat(none, none, "w")).alias("z"))

    def candidate(z, i):
        w, earlier = z["w"], F.concat_ws(" ", z["second"], z["last"])
        named = z["last"].rlike(rf"[=:]{_OPENING}$") & earlier.rlike(_NAMED)
        return F.when(
            w.isNotNull() & ((w.rlike(long) & w.rlike("[0-9]")) | w.rlike(rf"(?s)^[^=:]*+[=:].*[A-Za-z0-9]|{_KEY_STARTS}") | named),
            F.struct(i.alias("word_at"), w.alias("word"), F.concat(earlier, F.lit(" ")).alias("before")),
        )

    rows = maybe.select("doc_id", F.explode(F.filter(F.transform("z", candidate), lambda x: x.isNotNull())).alias("f")).select("doc_id", "f.*")
    gaps, runs = (F.regexp_extract_all("word", F.lit(_RUNS), F.lit(k)) for k in (1, 2))
    each = zipped(run=runs, gap=gaps, last=F.concat(none, runs), after=F.slice(F.concat(gaps, none), 2, 1 << 30))
    # a word may be long and have many runs: none of them carries it, or more than LOOK_BACK characters before it
    facts = (F.right("before", F.lit(LOOK_BACK)).alias("before"), F.col("word").rlike("[\"']").alias("in_quotes"), F.col("word").contains("@").alias("has_at"))
    rows = rows.select("doc_id", "word_at", *facts, each.alias("each"))
    rows = rows.select("doc_id", "word_at", "before", "in_quotes", "has_at", F.explode("each").alias("e")).where("e.run <> ''")
    rows = rows.select(
        "doc_id", "word_at", "in_quotes", "has_at", F.rtrim("e.run", F.lit(".")).alias("value"), F.concat("before", "e.last", "e.gap").alias("before"),
        # user:value@host
        (F.col("e.last").startswith("//") & (F.col("e.gap") == ":") & F.coalesce(F.col("e.after").startswith("@"), F.lit(False))).alias("of_user"),
    )
    general = (F.length("value") >= min_chars) & F.col("value").rlike("[0-9]")
    return rows.where((F.col("value") != "") & (general | F.col("value").rlike(KNOWN_KEYS) | F.col("before").rlike(_NAMED) | F.col("of_user")))


def _share(kept: str) -> Column:
    return F.length(F.regexp_replace("value", f"[^{kept}]", "")) / F.length("value")


def with_features(found: DataFrame) -> DataFrame:
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "[^0aA]", "-")
    runs = F.regexp_replace(classes, r"(.)\1+", "$1")
    covered = F.regexp_replace(F.lower("value"), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")
    return found.withColumns(
        {
            "chars": F.length("value").cast("double"),
            "digit_share": _share("0-9"),
            "upper_share": _share("A-Z"),
            "lower_share": _share("a-z"),
            "other_share": 1 - _share("0-9A-Za-z"),
            "transition_share": (F.length(runs) - 1) / F.length("value"),
            "letter_digit_share": F.regexp_count("value", F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")) / F.length("value"),
            "case_share": F.regexp_count("value", F.lit("[a-z](?=[A-Z])|[A-Z](?=[a-z])")) / F.length("value"),
            "vowel_share": _share("AEIOUYaeiouy"),
            "distinct_share": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"),
            "hex_only": F.col("value").rlike("^[0-9a-f]+$").cast("double"),
            "dictionary_share": 1 - F.length(covered) / F.length("value"),
            "slashes": (F.length("value") - F.length(F.translate("value", "/", ""))).cast("double"),
            "dots": (F.length("value") - F.length(F.translate("value", ".", ""))).cast("double"),
            "credential_near": F.lower("before").rlike(CREDENTIAL_NAMES).cast("double"),
            "assigned": F.col("before").rlike(rf"[=:]{_OPENING}$").cast("double"),
            "quoted": F.col("in_quotes").cast("double"),
        }
    )


def reviewed() -> Column:
    """Label by the fixed formats; null where they say nothing."""
    value, before = F.col("value"), F.lower("before")
    assigned = before.rlike(_NAMED) | F.col("of_user")
    harmless = value.rlike(r"^[0-9+().-]+$") | F.col("has_at") | value.rlike(r"^(https?:|www\.|/)") | value.rlike(r"\.(com|net|org|html?)\b") | value.rlike("^[A-Za-z]+[.,]*[0-9]{1,3}$")
    return F.when(value.rlike(KNOWN_KEYS), 1.0).when(assigned & value.rlike("[A-Za-z]"), 1.0).when(harmless, 0.0)


def scan_secrets(
    docs: DataFrame, labels: DataFrame | None = None, min_chars: int = 10, cutoff: float = 0.5, max_rows: int = 20_000, trees: int = 30, depth: int = 6, seed: int = 5
) -> DataFrame:
    """``doc_id, word_at, n_chars, value_sha256, score, is_secret`` of each candidate in ``docs(doc_id, text)``."""
    found = materialize(with_features(candidates(docs, min_chars)), "secret-candidates")
    if labels is None:
        known = found.withColumn("label", reviewed())
    else:
        known = found.join(labels.select("value", F.col("label").cast("double")).dropDuplicates(["value"]), "value", "left")
    sample = bounded_sample(known.where("label is not null"), max_rows, F.col("doc_id"), F.col("word_at"), F.col("value"))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    sample = materialize(sample.select("label", *FEATURES), "secret-sample")
    kinds = [r.label for r in sample.select("label").distinct().collect()]
    if sorted(kinds) == [0.0, 1.0]:
        forest = RandomForestClassifier(labelCol="label", featuresCol="_features", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_hit", numTrees=trees, maxDepth=depth, seed=seed)
        # a copy leaves the training summary behind: it holds the session, which can't go to tasks once it has observed a table
        model = forest.fit(assembler.transform(sample)).copy()
        scored = model.transform(assembler.transform(found)).withColumn("score", vector_to_array("_p")[1])
    else:
        scored = found.withColumn("score", F.lit(0.5))
    return scored.select("doc_id", "word_at", F.length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= cutoff).alias("is_secret"))
