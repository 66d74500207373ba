"""License scans by canonical digest.

A text is normalised - case, list marks, copyright lines, punctuation, equivalent spellings, white space - and its
SHA-256 is joined with the digests of known licences, so a whole text either is a licence or isn't. All of it is
column expressions and one equi-join. Known are the texts of ``license_texts``, each under its usual titles and
without one, and without the appendix that tells how to apply it.

Copyright lines are those that name a holder: "copyright", then a sign, a year or a placeholder, or a line with
"copyright" in front that has a year. A line of the licence itself that begins with "copyright" stays, wherever its
paragraphs are wrapped.

Null, empty and blank texts have an empty canonical form and match nothing. Texts are handled whole, whatever their
length. Repeated rows each get their row; if two known licences have one canonical form, the first name is taken. Other
columns pass through; those named license_id, canonical_chars or canonical_sha256 are replaced. An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import EQUIVALENT, known_texts
from .shared import column_name

#: Patterns of what goes, line by line, in the syntax that Java and RE2 share; "." is no line end.
HOLDER_LINE = r"^[^a-z0-9\n©]*(copyright[ \t:]*(\(c\)|©|&copy;|[0-9\[<{])|copyright [^\n]*\b(19|20)[0-9][0-9]\b|\(c\)[ \t]*[0-9\[<{]|©)[^\n]*$"
RIGHTS_LINE = r"^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
LIST_MARK = r"^[ \t]*([0-9]{1,2}|[a-z])[.)][ \t]+"
NO_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a licence text."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    for line in (HOLDER_LINE, RIGHTS_LINE, LIST_MARK):
        t = F.regexp_replace(t, "(?dm)" + line, "")
    # Every word between two spaces of its own, so that plain replacements see whole words.
    t = F.concat(F.lit(" "), F.regexp_replace(t, NO_WORD, "  "), F.lit(" "))
    for other, usual in EQUIVALENT:
        t = F.replace(t, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {usual.replace(' ', '  ')} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """docs with canonical_chars, canonical_sha256 and license_id (null where the text is no known licence).

    ``known`` has license_id and text. The default's digests, some dozens, are broadcast; for a given table the join
    is left to Spark, which broadcasts it only while its size allows.
    """
    spark = docs.sparkSession
    docs = docs.drop("license_id", "canonical_chars", "canonical_sha256")
    form, there = column_name(docs, "canonical_form"), column_name(docs, "known_sha256")
    rows = known if known is not None else spark.createDataFrame(known_texts(), "license_id string, text string")
    table = rows.select("license_id", canonical(F.col("text")).alias(form)).filter(F.length(form) > 0)
    table = table.groupBy(F.sha2(form, 256).alias(there)).agg(F.min("license_id").alias("license_id"))
    found = docs.withColumn(form, canonical(F.col(text)))
    found = found.withColumn("canonical_chars", F.length(form).cast("long")).withColumn("canonical_sha256", F.sha2(form, 256)).drop(form)
    return found.join(table if known is not None else F.broadcast(table), found["canonical_sha256"] == table[there], "left").drop(there)


def specimens(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Variants of all known texts as rows (id, text) with ids below 0: in capitals, with another spelling, holder and line ends."""
    rows = [(-i, t) for i, (_, t) in enumerate(known_texts(), 1)]
    changed = F.concat(F.lit("Copyright (c) 2021 Some Holder. All rights reserved.\r\n"), F.replace(F.upper(F.col(text)), F.lit("LICENSE"), F.lit("LICENCE")))
    return docs.sparkSession.createDataFrame(rows, f"`{id_}` long, `{text}` string").withColumn(text, changed)
