"""Secret scan with DataFrame functions only.

Words that look like keys become candidates; a random forest, trained from labelled
findings, tells secrets from numbers, addresses and other harmless strings by length,
character transitions, coverage by words of the corpus, the path, and neighbouring words.
Where nobody has labelled any, a rule on names and marks in front labels some findings;
the forest then does not see those two, so that it cannot learn the rule back.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

BLANK = r"[\x20\x09-\x0D]+"
#: Characters of the shortest candidate, where the caller says nothing else.
LEAST = 12
# Names that stand before secrets, and marks between name and value.
NAMES = ["api", "apikey", "auth", "bearer", "credential", "key", "passwd", "password", "private", "pwd", "secret", "token"]
MARKS = ["=", ":", ":=", "=>", "==", "is"]
ANY_NAME = "(?:" + "|".join(NAMES) + ")"
#: A name, perhaps in quotes, and a mark at the end of what stands in front of a run in its word.
FRONT = r"""([A-Za-z0-9_.\-]+)["'`]*(=>|:=|==|=|:)["'`(\[{]*$"""
# Parts of paths that hold examples rather than live secrets.
HARMLESS_PATHS = ["demo", "doc", "example", "fixture", "mock", "sample", "test"]

FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "distinct", "letter_digit", "digit_letter", "case_changes", "mark_changes",
    "longest_letters", "longest_digits", "hexadecimal", "covered", "address", "named", "marked", "quoted", "after_length", "after_letters", "path_harmless", "path_depth",
]
#: What the rule of ``rule_labels`` looks at.
RULE_FEATURES = ["named", "marked"]


def _bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^A-Za-z0-9]", ""))


def core(least: int) -> str:
    """Each such run of a word, of ``least`` characters or more, is a candidate."""
    return rf"[A-Za-z0-9][A-Za-z0-9+/=_.@:\-]{{{least - 1},}}"


#: The pattern at that length.
CORE = core(LEAST)


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None, least: int = LEAST) -> DataFrame:
    """Candidates with their place (number of the word) and part (number of the run in it), neighbours and path."""
    run = core(least)
    words = F.split(F.coalesce(F.col(text_col), F.lit("")), BLANK)
    before = lambda n: F.concat(F.array(*[F.lit("")] * n), words)
    zipped = F.arrays_zip(
        words.alias("word"),
        before(1).alias("before"),
        before(2).alias("before2"),
        F.slice(words, F.lit(2), F.size(words)).alias("after"),
        F.sequence(F.lit(0), F.size(words)).alias("place"),
    )
    likely = F.filter(zipped, lambda x: (F.length(x["word"]) >= least) & x["word"].rlike(run))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.explode(likely).alias("x"))
    # The runs of a word, and what stands in front of each and behind the last.
    rows = rows.select("doc_id", "path", "x.*", F.regexp_extract_all("x.word", F.lit(run), F.lit(0)).alias("runs"), F.split("x.word", run, -1).alias("gaps"))
    ahead = lambda n: F.concat(F.array(*[F.lit("")] * n), F.col("runs"))
    parts = F.arrays_zip(F.col("runs").alias("value"), F.col("gaps").alias("gap"), F.slice("gaps", F.lit(2), F.size("gaps")).alias("behind"), ahead(1).alias("run"), ahead(2).alias("run2"))
    rows = rows.select("doc_id", "path", "place", "before", "before2", "after", F.posexplode(parts).alias("part", "y")).where("y.value is not null")
    front = F.concat("y.run", "y.gap")
    name, mark = F.regexp_extract(front, FRONT, 1), F.regexp_extract(front, FRONT, 2)
    # The neighbours inside the word come first: a name and its mark, or else the runs in front.
    inner, first = name != "", F.col("part") == 0
    before = F.when(inner, mark).when(first, F.col("before")).otherwise(F.col("y.run"))
    before2 = F.when(inner, name).when(first, F.col("before2")).when(F.col("part") == 1, F.col("before")).otherwise(F.col("y.run2"))
    return rows.select("doc_id", "path", "place", "part", front.alias("front"), F.concat("y.gap", "y.behind").alias("around"), before.alias("before"), before2.alias("before2"), "after", "y.value")


def dictionary(docs: DataFrame, text_col: str, share: float) -> DataFrame:
    """Letter runs of at least three letters that occur in ``share`` of all documents, and in two at least."""
    runs = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[a-z]{3,}"), F.lit(0)))).alias("run"))
    least = max(2, math.ceil(share * docs.count()))
    return runs.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("run")


def described(found: DataFrame, known: DataFrame) -> DataFrame:
    """The candidates with the forest's features; those of the value alone are worked out once for each value."""
    values = found.select("value").distinct()
    runs = values.select("value", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit(r"[a-z]{3,}"), F.lit(0)))).alias("run"))
    cover = runs.join(staged(known, "dictionary"), "run").groupBy("value").agg(F.sum(F.length("run")).alias("known"))
    v, n = F.col("value"), F.length("value").cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    longest = lambda pattern: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), lambda x: F.length(x))), F.lit(0)) / n
    of_value = {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "others": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "letter_digit": share("(?<=[A-Za-z])(?=[0-9])"),
        "digit_letter": share("(?<=[0-9])(?=[A-Za-z])"),
        "case_changes": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "mark_changes": share("(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])"),
        "longest_letters": longest("[A-Za-z]+"),
        "longest_digits": longest("[0-9]+"),
        "hexadecimal": v.rlike("^([0-9a-f]{12,}|[0-9A-F]{12,})$").cast("double"),
        "covered": F.coalesce("known", F.lit(0)) / n,
        "address": v.rlike(r"@|://|^[0-9.:]+$").cast("double"),
    }
    # Written, so that Spark can split the join for a value that very many documents hold.
    valued = staged(values.join(cover, "value", "left").select("value", *[c.cast("double").alias(f) for f, c in of_value.items()]), "values")
    named = F.array_contains(F.array(*map(F.lit, NAMES)), _bare(F.col("before"))) | F.array_contains(F.array(*map(F.lit, NAMES)), _bare(F.col("before2")))
    inside = F.lower("value").rlike(ANY_NAME + "[:=]") | F.lower("front").rlike(ANY_NAME + r"""["'`]*(=>|:=|==|=|:)["'`(\[{]*$""")
    path, after = F.lower("path"), F.coalesce("after", F.lit(""))
    of_place = {
        "named": named | inside,
        "marked": F.col("before").isin(MARKS) | F.col("before").rlike("[:=]$") | inside,
        "quoted": F.col("around").rlike("[\"'`]"),
        "after_length": F.length(after),
        "after_letters": F.regexp_count(after, F.lit("[A-Za-z]")) / F.greatest(F.length(after), F.lit(1)),
        "path_harmless": reduce(lambda a, b: a | b, [path.contains(x) for x in HARMLESS_PATHS]),
        "path_depth": F.regexp_count(path, F.lit("/")),
    }
    both = found.join(valued, "value")
    return both.select(*found.columns, *of_value, *[c.cast("double").alias(f) for f, c in of_place.items()])


def rule_labels(found: DataFrame) -> DataFrame:
    """Findings labelled by rule, for use where nobody has labelled any: 1 for mixed strings that a name and a mark precede, 0 for numbers, network and mail addresses and plain words, none for the rest."""
    v = F.col("value")
    own = F.regexp_replace(v, r"^[A-Za-z0-9_.\-]*(?i:" + ANY_NAME + ")[:=]+", "")  # the value without a name in the same run
    named = F.array_contains(F.array(*map(F.lit, NAMES)), _bare(F.col("before2"))) & F.col("before").isin(MARKS)
    mixed = own.rlike("[A-Za-z]") & (own.rlike("[0-9]") | own.rlike("^.+[A-Z]"))
    yes = (named | (own != v)) & (F.length(own) >= 12) & mixed & ~v.contains("@")
    plain = v.rlike(r"^[A-Z]?[a-z]+([\-./_][A-Z]?[a-z]+)*[\-.:]*$")
    no = v.rlike(r"^[0-9.:\-]+$") | v.rlike(r"^[^@]+@[^@]+\.[a-z]+$") | v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}") | plain
    label = F.when(yes, 1.0).when(no & ~named, 0.0)
    return found.select("value", "before", "before2", label.alias("label")).where("label is not null")


def scan(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
    least: int = LEAST,
    sample: int = 20000,
    dictionary_share: float = 0.001,
    threshold: float = 0.5,
    seed: int = 13,
) -> DataFrame:
    """Candidates of all documents with the forest's verdict.

    Returns ``doc_id``, ``place`` (the number of the word, from 0), ``part`` (the number of the
    run in the word, from 0), ``value``, ``probability`` and ``is_secret``. ``labelled`` has ``value``, ``before``, ``before2`` (the two words in
    front, null where unknown) and ``label`` 1.0 or 0.0; without it labels come from
    ``rule_labels``, and the forest does without ``RULE_FEATURES``. The forest is trained on
    about ``sample`` labelled findings, by hash, counted apart for each label, and on as many
    without a digit, in an order and in partitions that their features decide, so reruns
    agree on any cluster. A finding that stands in several places is trained on once, with the
    smallest of its features in their order. The dictionary counts documents, all of them: a run of letters is a
    word if ``dictionary_share`` of them hold it. Runs of fewer than ``least`` characters are no candidates.

    * A null or empty text has no candidates; texts of any length are scanned as a whole. A
      null id stays null; repeated rows are scanned one by one. A null path is an empty path.
      Other columns are left out, so their names cannot clash.
    * An empty table gives no rows. A probability equal to ``threshold`` is a secret.
    * Where labels of one kind only are known, that kind is the verdict; without any
      labels, no candidate is a secret.
    """
    found = staged(candidates(docs, id_col, text_col, path_col, least), "candidates")
    full = staged(described(found, dictionary(docs, text_col, dictionary_share)), "described")
    said = (rule_labels(found) if labelled is None else labelled.select("value", "before", "before2", F.col("label").cast("double"))).distinct()
    said = said.groupBy("value", "before", "before2").agg(F.max("label").alias("label"))
    digit = F.col("value").rlike("[0-9]")
    cells = {(r["label"], r["digit"]): r["n"] for r in said.groupBy("label", digit.alias("digit")).agg(F.count("*").alias("n")).collect()}
    kinds = {k: sum(n for (x, _), n in cells.items() if x == k) for k, _ in cells}
    out = ["doc_id", "place", "part", "value"]
    if len(kinds) < 2:
        sure = F.lit(float(next(iter(kinds), 0.0)))
        return full.select(*out, sure.alias("probability"), (sure >= threshold).alias("is_secret"))
    where = F.xxhash64(F.lit(seed), "value", "before", "before2") / F.lit(2.0**64) + 0.5
    few = reduce(lambda a, b: a | b, [(F.col("label") == k) & (digit == d) & (where < min(1.0, sample / 2 / n)) for (k, d), n in cells.items()])
    # The chosen findings first, a bounded number, so that few candidates are grouped.
    chosen = staged(said.where(few), "chosen")
    same = (F.col("o.value") == F.col("s.value")) & F.col("o.before").eqNullSafe(F.coalesce("s.before", "o.before")) & F.col("o.before2").eqNullSafe(F.coalesce("s.before2", "o.before2"))
    known = full.alias("o").join(chosen.alias("s"), same).select("o.value", "o.before", "o.before2", "s.label", F.struct(*[F.col(f"o.{f}") for f in FEATURES]).alias("f"))
    training = staged(known.groupBy("value", "before", "before2", "label").agg(F.min("f").alias("f")).select("label", "f.*"), "training")
    if training.select("label").distinct().count() < 2:
        sure = F.lit(float(max(kinds, key=kinds.get)))
        return full.select(*out, sure.alias("probability"), (sure >= threshold).alias("is_secret"))
    used = [f for f in FEATURES if labelled is not None or f not in RULE_FEATURES]
    # The forest draws by partition and place.
    ordered = training.repartition(8, *FEATURES).sortWithinPartitions("label", *FEATURES)
    assemble = VectorAssembler(inputCols=used, outputCol="features")
    forest = RandomForestClassifier(numTrees=30, maxDepth=6, seed=seed, featureSubsetStrategy="sqrt").fit(assemble.transform(ordered))
    rated = forest.transform(assemble.transform(full)).withColumn("probability", vector_to_array("probability")[1])
    return rated.select(*out, "probability", (F.col("probability") >= threshold).alias("is_secret"))


def masked(value: Column) -> Column:
    """A hash to carry in reports in place of a secret."""
    return F.sha2(value.cast("binary"), 256)


__all__ = ["FEATURES", "RULE_FEATURES", "candidates", "described", "dictionary", "masked", "rule_labels", "scan"]
