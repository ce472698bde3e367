"""Line dedup by winnowing, in DataFrame functions alone.

Each line with a word is hashed.  Of every ``run`` lines in a row the smallest hash
(the last of equals) is a fingerprint, so two equal runs of that many lines always
share one.  Fingerprints are joined on their hash; each occurrence of a repeated one
is extended both ways to every window of ``run`` lines that holds it.  Windows with
equal lines meet in an aggregate that keeps the earliest; the later ones are deleted,
and windows that overlap add up to the whole repeated run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpoint, packed, table, unpacked

#: Lines of the shortest run that is found: the width of the winnowing window.
RUN = 3
SPACE = " \t\n\x0b\x0c\r"


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, doc, hash): the order of documents is doc_id (null first), then the text's hash."""
    text = F.col("text").cast("string")
    return packed(docs, doc=F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), hash=F.xxhash64(text))


def _text():
    return F.col("row").getField("text").cast("string")


def _raw(column):
    return F.split(column, "\n", -1)


def winnow(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(h, doc, hash, at, around): the fingerprints of each text.

    ``around`` has the lines (two hashes and the number among all lines) from
    ``run - 1`` before the fingerprint to ``run - 1`` after it; ``at`` is the
    fingerprint's place in it, from 1.
    """
    lines = F.transform(_raw(_text()), lambda x, i: F.struct(F.btrim(x, F.lit(SPACE)).alias("t"), i.alias("i")))
    lines = F.filter(lines, lambda x: x["t"] != "")
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x["t"]).alias("a"), F.xxhash64(x["t"], F.lit(run)).alias("b"), x["i"].alias("i")))
    rows = _keyed(docs).select("doc", "hash", hashed.alias("lines")).where(F.size("lines") >= run)
    # each column is used twice in the next, which keeps the optimizer from computing it anew for each line
    rows = rows.withColumn("ranked", F.transform("lines", lambda x, i: F.struct(x["a"].alias("h"), (-i).alias("i"))))
    starts = F.sequence(F.lit(1), F.size("ranked") - run + 1)
    rows = rows.withColumn("least", F.transform(starts, lambda i: F.array_min(F.slice("ranked", i, run))))
    # places of the minima never fall, so a minimum is new where it differs from the one before
    picked = F.filter("least", lambda x, i: (i == 0) | (x != F.get("least", i - 1)))

    def mark(p):
        at = -p["i"]  # from 0
        first = F.greatest(at - (run - 1), F.lit(0))
        return F.struct(p["h"].alias("h"), (at - first + 1).alias("at"), F.slice("lines", first + 1, at - first + run).alias("around"))

    marks = rows.select("doc", "hash", F.explode(F.transform(picked, mark)).alias("p"))
    return marks.select("p.h", "doc", "hash", "p.at", "p.around")


def repeated_lines(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(doc, hash, gone): for each text with repeats, the numbers of the lines to delete, from 0."""
    marks = checkpoint(winnow(docs, run))
    again = checkpoint(marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    live = marks.join(again, "h")
    # extension: every window of ``run`` lines that holds the fingerprint
    starts = F.sequence(F.greatest(F.col("at") - (run - 1), F.lit(1)), F.least(F.col("at"), F.size("around") - run + 1))
    live = live.where(F.least(F.col("at"), F.size("around") - run + 1) >= F.greatest(F.col("at") - (run - 1), F.lit(1)))
    windows = live.select("doc", "hash", F.explode(F.transform(starts, lambda s: F.slice("around", s, run))).alias("w"))
    windows = windows.select("doc", "hash", F.col("w")[0]["i"].alias("line"), F.xxhash64(F.transform("w", lambda x: x["a"])).alias("wa"), F.xxhash64(F.transform("w", lambda x: x["b"])).alias("wb"), F.transform("w", lambda x: x["i"]).alias("lines"))
    windows = checkpoint(windows)
    place = F.struct("doc", "hash", "line")
    first = checkpoint(windows.groupBy("wa", "wb").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("wa", "wb", "first"))
    later = windows.join(first, ["wa", "wb"]).where(place > F.col("first"))
    return later.select("doc", "hash", F.explode("lines").alias("line")).groupBy("doc", "hash").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(row, text, lines, gone): ``docs`` as structs, their texts without later repeats of runs of ``run`` or more lines.

    Lines end at a newline; they are compared without white space at their ends,
    and lines of white space alone are neither counted in runs nor deleted.  A run is
    later if it begins behind an equal one in the order of doc_id (null first), the
    text's hash and the line; rows with equal doc_id and text count as one document.
    Every deleted line stands earlier in some document that keeps it.  Null texts
    stay null; a text may become empty, its row stays.  ``lines`` and ``gone`` count
    the lines and the deleted ones.
    """
    gone = checkpoint(repeated_lines(docs, run))
    rows = _keyed(docs).join(gone, ["doc", "hash"], "left")
    # the parts are a column of their own: inside the lambda they would be split again for each line
    rows = rows.select("row", "gone", _raw(_text()).alias("parts"))
    kept = F.sort_array(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone")))
    text = F.when(F.col("gone").isNull(), _text()).otherwise(F.array_join(F.transform(kept, lambda i: F.get("parts", i)), "\n"))
    return rows.select("row", text.alias("text"), F.when(_text().isNotNull(), F.size("parts")).otherwise(0).alias("lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("gone"))


def drop_lines(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``docs`` with the texts of ``dedup_lines``; ``n_chars``, if there, is brought up to date."""
    found = dedup_lines(docs, run)
    changed = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*unpacked(found, docs.columns, **changed))


def op7(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", F.col("lines").cast("long").alias("n_lines"), F.col("gone").cast("long").alias("n_removed"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


#: The same in SQL: windows of three lines, numbered by their place among equals.
ORACLE = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), worded AS (
  SELECT doc_id, i, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM raw
), three AS (
  SELECT doc_id, i, lead(i, 1) OVER w AS i2, lead(i, 2) OVER w AS i3, t || chr(10) || lead(t, 1) OVER w || chr(10) || lead(t, 2) OVER w AS key
  FROM worded WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ranked AS (
  SELECT doc_id, i, i2, i3, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS n FROM three WHERE key IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, unnest([i, i2, i3]) AS i FROM ranked WHERE n > 1
), kept AS (
  SELECT raw.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg(raw.line, chr(10) ORDER BY raw.i) FILTER (WHERE gone.i IS NULL), '') AS text
  FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id AND raw.i = gone.i GROUP BY raw.doc_id
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, md5(text) AS text_md5 FROM kept
"""
