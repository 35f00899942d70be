"""Line de-duplication: lines that many documents share stay in one document alone.

Lines are exploded, normalised to a key and hashed; distinct documents are counted per hash; a
line whose key reaches the threshold goes everywhere but in the document with the largest id;
what is left of a document is put together by position. Only hashes and positions are shuffled
to find the lines; a text meets its dropped positions once, and not at all if it has no line
long enough.

Hashes have 128 bits. The lines of the most frequent keys (at most ``HOT`` of them, so their
table may be sent to all tasks) never meet in a join task; of the other keys none can hold more
than a share of 1/``HOT`` of all lines.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from marketlens.llm.written import written

#: Characters stripped at both ends of a line.
BLANK = "\t\n\x0b\x0c\r "
#: Keys whose table is broadcast.
HOT = 1000


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A to Z as small letters."""
    bare = F.btrim(line, F.lit(BLANK))
    # ``lower`` changes other letters too, so it is for texts of ASCII characters alone.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    )


def _hashes(*values: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *values) for seed in (1, 2)]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and a hash of both: rows equal in both have the same result."""
    plain = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    r1, r2 = _hashes(F.col("_doc").isNull(), F.col("_doc"), F.col("_text"))
    return plain.withColumns({"_r1": r1, "_r2": r2})


def long_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """(_doc, _r1, _r2, _pos, _k1, _k2): lines whose key has ``min_chars`` code points or more."""
    rows = _row(docs, id_col, text_col).select("_doc", "_r1", "_r2", F.posexplode(_lines(F.col("_text"))).alias("_pos", "_line"))
    # A key is never longer than its line, so most short lines need no key.
    keyed = rows.where(F.char_length("_line") >= min_chars).withColumn("_key", line_key(F.col("_line"))).where(F.char_length("_key") >= min_chars)
    k1, k2 = _hashes(F.col("_key"))
    return keyed.select("_doc", "_r1", "_r2", "_pos", k1.alias("_k1"), k2.alias("_k2"))


def shared_keys(lines: DataFrame, min_docs: int = 5) -> DataFrame:
    """(_k1, _k2, _n, _last): keys held by ``min_docs`` documents or more, and the largest id holding them.

    Pairs of key and document are made distinct before the key is counted, so a key in very many
    documents is spread over all tasks.
    """
    held = lines.select("_k1", "_k2", "_doc").distinct()
    counts = held.groupBy("_k1", "_k2").agg(F.count("_doc").alias("_n"), F.max("_doc").alias("_last"))
    return counts.where(F.col("_n") >= min_docs)


def dropped_lines(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """(_r1, _r2, _pos): the lines that go."""
    gone = ~F.col("_doc").eqNullSafe(F.col("_last"))
    hot = shared.orderBy(F.col("_n").desc(), "_k1", "_k2").limit(HOT).select("_k1", "_k2", "_last", F.lit(True).alias("_hot"))
    seen = lines.join(F.broadcast(hot), ["_k1", "_k2"], "left")
    frequent = seen.where(F.col("_hot")).where(gone)
    others = seen.where(F.col("_hot").isNull()).drop("_last", "_hot").join(shared, ["_k1", "_k2"]).where(gone)
    return frequent.select("_r1", "_r2", "_pos").unionByName(others.select("_r1", "_r2", "_pos"))


def _kept(lines: Column, dropped: Column) -> Column:
    """Lines at other positions than the sorted ``dropped``: the stretches between them."""
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
    stretch = lambda i: F.slice(lines, edges[i] + 2, edges[i + 1] - edges[i] - 1)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(dropped)), stretch))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, out: str = "kept_text",
) -> DataFrame:
    """One row per row: id, ``n_lines`` (before), ``n_dropped`` and the text that is left.

    A text is split at line ends; null and empty texts are one empty line. Lines whose key has
    ``min_chars`` code points and stands in ``min_docs`` documents or more go, except in the
    document with the largest id that holds it; there all of them stay. A text that loses all
    lines is empty. Documents are told apart by id: rows with one id are one document, whatever
    their texts, and repeated rows stay. Rows without an id count towards no threshold and lose
    the lines that others share. Very long texts are handled in time proportional to their
    length. An empty table gives no rows; other columns are not read.
    """
    lines = written(long_lines(docs, id_col, text_col, min_chars), "lines")
    shared = written(shared_keys(lines, min_docs), "shared-lines")
    positions = dropped_lines(lines, shared).groupBy("_r1", "_r2").agg(F.sort_array(F.collect_set("_pos")).alias("_dropped"))
    rows = _row(docs, id_col, text_col).join(positions, ["_r1", "_r2"], "left")
    dropped = F.coalesce("_dropped", F.array().cast("array<int>"))
    whole = F.struct(_lines(F.col("_text")).alias("lines"), dropped.alias("dropped"))
    # Bound once: a lambda would split the text for every stretch.
    cut = F.transform(F.array(whole), lambda w: F.struct(
        F.size(w["lines"]).cast("long").alias("n_lines"), F.size(w["dropped"]).cast("long").alias("n_dropped"),
        F.when(F.size(w["dropped"]) == 0, F.lit(None)).otherwise(F.array_join(_kept(w["lines"], w["dropped"]), "\n")).alias("kept"),
    ))[0]
    done = rows.select("_doc", "_text", cut.alias("_cut"))
    return done.select(
        F.col("_doc").alias(id_col), F.col("_cut.n_lines").alias("n_lines"), F.col("_cut.n_dropped").alias("n_dropped"),
        F.coalesce(F.col("_cut.kept"), F.col("_text")).alias(out),
    )
