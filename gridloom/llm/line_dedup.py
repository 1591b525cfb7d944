"""Line dedup with DataFrame functions only.

Lines are exploded and normalised, a 128-bit hash stands for each key, distinct
documents are counted per hash, lines of frequent keys go, and the others are put
together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, id_key, staged


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
) -> DataFrame:
    """Drop the lines whose key occurs in at least ``min_docs`` documents.

    The document with the largest id that holds a key keeps its lines with that key.
    Keys shorter than ``min_chars`` code points are never dropped. Returns the input's
    columns with the reduced text, and ``n_lines`` (before) and ``n_dropped``.

    * A null or empty text is one empty line; a null text stays null.
    * Rows that share an id are one document when documents are counted; each row keeps
      its own text. Rows with a null id are together one document below every other id.
    * If all lines go, the text is empty. An empty table gives an empty table. Texts of any
      length are split as a whole; a line that is repeated in a text has all its places.
    * Input columns called ``n_lines`` or ``n_dropped`` are replaced; names that begin
      with ``__line_`` are reserved.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.withColumns({"__line_doc": id_key(F.col(id_col)), "__line_text": F.xxhash64(text)})
    lines = F.split(text, "\n", -1)
    keyed = (
        own.select("__line_doc", "__line_text", F.posexplode(F.transform(lines, line_key)).alias("__line_pos", "__line_key"))
        .where(F.char_length("__line_key") >= min_chars)
        .select(
            "__line_doc",
            "__line_text",
            "__line_pos",
            F.xxhash64("__line_key").alias("__line_h1"),
            F.xxhash64(F.lit(1), F.col("__line_key")).alias("__line_h2"),
        )
    )
    keyed = staged(keyed, "line_keys")
    frequent = (
        keyed.groupBy("__line_h1", "__line_h2")
        .agg(F.countDistinct("__line_doc").alias("__line_n"), F.max("__line_doc").alias("__line_keeper"))
        .where(F.col("__line_n") >= min_docs)
    )
    # Written, so that both sides of the join are plain shuffles: Spark then splits the partition of a very common line.
    frequent = staged(frequent, "line_frequent")
    dropped = (
        keyed.join(frequent, ["__line_h1", "__line_h2"])
        .where(F.col("__line_doc") != F.col("__line_keeper"))
        .groupBy("__line_doc", "__line_text")
        .agg(F.collect_list("__line_pos").alias("__line_gone"))
    )
    # The lines become a column below the join, so that the lambda above it reads an array and splits nothing again.
    whole = own.withColumn("__line_all", lines).join(dropped, ["__line_doc", "__line_text"], "left")
    kept = F.array_except(
        F.sequence(F.lit(0), F.size("__line_all") - 1), F.coalesce("__line_gone", F.array().cast("array<int>"))
    )
    whole = whole.withColumn("__line_kept", kept)
    joined = F.array_join(F.transform("__line_kept", lambda p: F.element_at("__line_all", p + 1)), "\n")
    out = {c: F.col(f"`{c}`") for c in docs.columns}
    out[text_col] = F.when(F.col(text_col).isNotNull(), joined)
    out["n_lines"] = F.size("__line_all").cast("long")
    out["n_dropped"] = (F.size("__line_all") - F.size("__line_kept")).cast("long")
    return whole.select(*[c.alias(n) for n, c in out.items()])
