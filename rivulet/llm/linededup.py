"""Line deduplication across documents, in DataFrame operations only.

Lines are exploded with their positions, keyed by a 128-bit hash of the normalised line, counted over
distinct documents, and documents are reassembled from the runs of positions between dropped lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import hash_pair, lower_ascii, strip_ws


def line_key(line: Column) -> Column:
    """Normalised form that decides whether two lines are the same."""
    return lower_ascii(strip_ws(line))


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("__id"), t.alias("__t")).withColumn("__th", F.xxhash64("__t"))


def _lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    rows = _rows(docs, text, doc_id)
    lines = rows.select("__id", "__th", F.posexplode(F.split("__t", "\n", -1)).alias("__pos", "__line"))
    key = line_key(F.col("__line"))
    h1, h2 = hash_pair(key)
    return lines.select("__id", "__th", "__pos", F.char_length(key).alias("__n"), h1.alias("__h1"), h2.alias("__h2"))


def frequent_keys(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Keys of at least `min_chars` code points that stand in at least `min_docs` documents.

    A document is a distinct pair of id and text: an exactly repeated row counts once. Equal lines of one
    document meet in the map task, a key's documents are then counted by partial sums, so no key gathers in a task.
    """
    lines = _lines(docs, text, doc_id).where(F.col("__n") >= min_chars)
    once = lines.groupBy("__h1", "__h2", "__id", "__th").agg(F.lit(1).alias("__one"))
    return once.groupBy("__h1", "__h2").agg(F.count("*").alias("__docs")).where(F.col("__docs") >= min_docs)


def drop_frequent_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1, salts: int = 16
) -> DataFrame:
    """`docs` with the lines of frequent keys taken out of `text`, and columns n_lines and n_dropped.

    Null and empty texts are one empty line (and stay null or empty). Blank lines have an empty key and stay
    under the default `min_chars`. All rows stay, also those that lose every line (text ''). Repeated rows and
    rows with a null id are treated like others. Lines of a key are spread over `salts` sub-keys before the join.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    frequent = frequent_keys(docs, text, doc_id, min_docs, min_chars)
    salted = frequent.select("__h1", "__h2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__s"))
    lines = _lines(docs, text, doc_id).where(F.col("__n") >= min_chars)
    lines = lines.withColumn("__s", F.pmod(F.hash("__id", "__th", "__pos"), F.lit(salts)))
    # Spark takes `salted` to be as large as `frequent` and might broadcast what is `salts` times that.
    hit = lines.join(salted.hint("merge"), ["__h1", "__h2", "__s"]).groupBy("__id", "__th").agg(F.sort_array(F.collect_set("__pos")).alias("__drop"))
    base = docs.withColumns({"__t": F.coalesce(F.col(text), F.lit("")), "__id": F.col(doc_id)}).withColumn("__th", F.xxhash64("__t"))
    hit = hit.select(F.col("__id").alias("__hid"), F.col("__th").alias("__hth"), "__drop")
    out = base.join(hit, base["__id"].eqNullSafe(hit["__hid"]) & (base["__th"] == hit["__hth"]), "left")
    out = out.withColumn("__lines", F.split("__t", "\n", -1))
    n, d = F.size("__lines"), F.col("__drop")
    # Kept lines are the runs before, between and after the dropped positions.
    runs = F.transform(
        F.sequence(F.lit(0), F.size(d)),
        lambda i: F.slice(
            F.col("__lines"),
            F.when(i == 0, 1).otherwise(F.get(d, i - 1) + 2),
            F.coalesce(F.get(d, i), n) - F.when(i == 0, 0).otherwise(F.get(d, i - 1) + 1),
        ),
    )
    kept = F.when(d.isNull(), F.col(text)).otherwise(F.array_join(F.flatten(runs), "\n"))
    out = out.withColumns({"__kept": kept, "n_lines": n.cast("long"), "n_dropped": F.when(d.isNull(), 0).otherwise(F.size(d)).cast("long")})
    return out.select(*[F.col("__kept").alias(c) if c == text else F.col(c) for c in keep], "n_lines", "n_dropped")
