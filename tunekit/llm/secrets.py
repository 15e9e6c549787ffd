"""Secret scans whose findings a random forest sorts, in DataFrame functions and Spark ML only.

A candidate is a word of a text that, without quotes, a ``name=`` before it and end punctuation, has
``SHORTEST`` or more characters of the alphabets keys are written in, among them a digit. For each the
forest sees

- its length and how many of its characters differ;
- character transitions: how often it goes from one class (lower, upper, digit, other) to another, and
  the shares of the classes and of hexadecimal digits;
- dictionary coverage: the share of its characters in letter runs that are words of a dictionary, a
  DataFrame of one column ``word`` with a bounded number of rows (broadcast);
- path: whether the document's path names tests, examples or documentation, and its depth;
- neighbours: words that announce a secret or an ordinary number, in the candidate's own name or among
  the two words on each side.

The forest is trained on labelled findings (candidates with ``label`` 1 or 0), at most ``LABELLED`` of
them in order of a hash, to tell secrets from false positives. Where no labels are given,
``labelled_by_format`` takes the candidates whose form alone proves what they are: keys of known
providers and quoted or assigned values after a secret's name against addresses, card numbers, hosts
and dates. These formats are no features, so the forest scores all others by the features above.

A null text has no candidates. Null paths count as empty. Rows with a null or repeated ``doc_id`` are
scanned each for itself. Other columns are ignored. With labels of one kind only there is nothing to
learn: the probability is null and every candidate stays a finding. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.llm.spark_tools import stage

SHORTEST = 12
LABELLED = 20_000
TREES, DEPTH, SEED = 40, 8, 42

# Words that announce a secret, and words that announce something ordinary.
SECRET_WORDS = "password passwd pwd passphrase token secret key apikey api_key auth bearer credential private access signature".split()
ORDINARY_WORDS = "mail email host server address phone card iban version release isbn doi commit checksum example sample test dummy uuid id".split()
TEST_PATHS = "test tests spec example examples sample samples doc docs demo fixture fixtures mock".split()

# Forms that prove what a candidate is.
SECRET_FORMS = [
    r"^(AKIA|ASIA)[0-9A-Z]{16}$",
    r"^gh[pousr]_[0-9A-Za-z]{36,}$",
    r"^xox[abprs]-[0-9A-Za-z-]{10,}$",
    r"^(sk|rk|pk)_(live|test)_[0-9A-Za-z]{16,}$",
    r"^AIza[0-9A-Za-z_-]{35}$",
    r"^eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]*$",
]
ORDINARY_FORMS = [
    r"^[^@\s]+@[^@\s]+$",
    r"^[0-9]{12,19}$",
    r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"^[+0-9().-]+$",
    r"^(www\.|[a-z0-9-]+(\.[a-z0-9-]+)+$)",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
]

_WORD = r"""^(?:[^\s=:"']*[=:])?["'(\[<]*([A-Za-z0-9][A-Za-z0-9+/_.@~=-]*?)[)\]>"'.,;:!?=]*$"""
FEATURES = [
    "length", "distinct_share", "transition_share", "digit_share", "upper_share", "lower_share", "hex_share",
    "dictionary_share", "test_path", "path_depth", "secret_name", "ordinary_name", "secret_neighbours", "ordinary_neighbours",
]


def _any(words: list[str]) -> str:
    return r"(?i)\b(" + "|".join(words) + r")s?\b"


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """doc_id, word (its number in the text), value, name (what it was assigned to), before, after and path of every candidate."""
    where = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")) if path else F.lit("")
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), where.alias("path"), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"\s+", -1).alias("words")
    )
    spots = F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("word"), w.alias("raw"))),
        lambda x: (F.length(x["raw"]) >= SHORTEST) & x["raw"].rlike("[0-9]"),
    )
    taken = F.transform(
        spots,
        lambda x: F.struct(
            x["word"].alias("word"),
            x["raw"].alias("raw"),
            F.array_join(F.slice(F.col("words"), F.greatest(x["word"] - 1, F.lit(1)), F.least(x["word"], F.lit(2))), " ").alias("before"),
            F.array_join(F.slice(F.col("words"), x["word"] + 2, 2), " ").alias("after"),
        ),
    )
    found = words.select("doc_id", "path", F.explode(taken).alias("c")).select("doc_id", "path", "c.*")
    found = found.withColumn("value", F.regexp_extract("raw", _WORD, 1))
    name = F.regexp_extract("raw", r"""^([^\s=:"']*)[=:]""", 1)
    return found.where((F.length("value") >= SHORTEST) & F.col("value").rlike("[0-9]")).select("doc_id", "word", "value", name.alias("name"), "before", "after", "path")


def _share(pattern: str) -> Column:
    return (F.length("value") - F.length(F.regexp_replace("value", pattern, ""))) / F.length("value")


def with_features(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Candidates with the columns in FEATURES."""
    found = found.withColumn("__at", F.xxhash64("doc_id", "word", "value"))
    runs = found.select("__at", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    known = F.broadcast(dictionary.select(F.lower("word").alias("word")).distinct())  # a dictionary's size doesn't depend on the data
    covered = runs.join(known, "word").groupBy("__at").agg(F.sum(F.length("word")).alias("covered"))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "_")
    squeezed = F.regexp_replace(classes, r"(.)\1+", "$1")
    size = F.length("value")
    near = F.concat_ws(" ", "before", "after")
    hits = lambda text, words: F.size(F.regexp_extract_all(text, F.lit(_any(words)), F.lit(0))).cast("double")
    return (
        found.join(covered, "__at", "left")
        .withColumns(
            {
                "length": size.cast("double"),
                "distinct_share": F.size(F.array_distinct(F.split("value", ""))) / size,
                "transition_share": (F.length(squeezed) - 1) / size,
                "digit_share": _share("[0-9]"),
                "upper_share": _share("[A-Z]"),
                "lower_share": _share("[a-z]"),
                "hex_share": _share("[0-9a-fA-F]"),
                "dictionary_share": F.coalesce(F.col("covered"), F.lit(0)) / size,
                "test_path": F.col("path").rlike(_any(TEST_PATHS)).cast("double"),
                "path_depth": (F.size(F.split("path", "/")) - 1).cast("double"),
                "secret_name": hits(F.col("name"), SECRET_WORDS),
                "ordinary_name": hits(F.col("name"), ORDINARY_WORDS),
                "secret_neighbours": hits(near, SECRET_WORDS),
                "ordinary_neighbours": hits(near, ORDINARY_WORDS),
            }
        )
        .drop("__at", "covered")
    )


def labelled_by_format(found: DataFrame) -> DataFrame:
    """The candidates whose form proves them, with label 1 or 0."""
    value = F.col("value")
    is_form = lambda forms: value.rlike("|".join(f"(?:{f})" for f in forms))
    assigned = value.rlike("^[0-9a-zA-Z+/_-]{16,}$") & value.rlike("[a-zA-Z]") & (F.col("name").rlike(_any(SECRET_WORDS)) | F.col("before").rlike(_any(SECRET_WORDS) + r"\s*[=:]$"))
    label = F.when(is_form(SECRET_FORMS) | assigned, 1.0).when(is_form(ORDINARY_FORMS), 0.0)
    return found.withColumn("label", label).where("label IS NOT NULL")


def train(labelled: DataFrame, limit: int = LABELLED) -> PipelineModel | None:
    """A forest from candidates with FEATURES and label; None without labels of both kinds.

    At most ``limit`` findings are used, the first by a hash of their value and place.
    """
    rows = labelled.select("label", *FEATURES, F.xxhash64("value", "doc_id", "word").alias("key")).orderBy("key", "label", "length").limit(limit)
    rows = stage(rows.coalesce(1), "secret-labels")
    if rows.select("label").distinct().count() < 2:
        return None
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label")
    model: RandomForestClassificationModel = forest.fit(assembler.transform(rows))
    return PipelineModel([assembler, model])


def sorted_findings(found: DataFrame, model: PipelineModel | None, threshold: float = 0.5) -> DataFrame:
    """Candidates with FEATURES, their probability of being a secret and whether that reaches the threshold."""
    if model is None:
        return found.withColumns({"probability": F.lit(None).cast("double"), "is_secret": F.lit(True)})
    scored = model.transform(found).withColumn("probability", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "prediction").withColumn("is_secret", F.col("probability") >= threshold)


def scan(docs: DataFrame, dictionary: DataFrame, path: str | None = "source", labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate of (doc_id, text, path) with its features, probability and verdict."""
    found = stage(with_features(candidates(docs, path), dictionary), "secret-candidates")
    return sorted_findings(found, train(labelled if labelled is not None else labelled_by_format(found)))
