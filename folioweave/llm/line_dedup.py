"""Line dedup by overlapping windows of lines; DataFrame functions only.

Windows are of three lines; one or two lines are a window too if they hold over ``WORDS`` words, so
that a long passage is found however few lines it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, xor_key

#: Words, runs of signs other than ASCII white space, that fewer lines than a window's must exceed.
WORDS = 50

ORACLE = """
WITH l AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), e3 AS (
  SELECT doc_id, i AS pos, ls[i + 1] AS a, ls[i + 2] AS b, ls[i + 3] AS c
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM l)
), c3 AS (
  SELECT *, CASE WHEN length(a) + coalesce(length(b), 0) > 100 THEN len(regexp_extract_all(a, '[^\\x09-\\x0D ]+')) ELSE 0 END AS na,
         CASE WHEN length(a) + coalesce(length(b), 0) > 100 THEN len(regexp_extract_all(b, '[^\\x09-\\x0D ]+')) ELSE 0 END AS nb
  FROM e3
), w AS (
  SELECT doc_id, pos, 3 AS size, a, b, c FROM c3 WHERE c IS NOT NULL AND trim(a || b || c, ' ') <> ''
  UNION ALL SELECT doc_id, pos, 2, a, b, '' FROM c3 WHERE b IS NOT NULL AND na + nb > 50
  UNION ALL SELECT doc_id, pos, 1, a, '', '' FROM c3 WHERE na > 50
), r AS (
  SELECT doc_id, pos, size, row_number() OVER (PARTITION BY size, a, b, c ORDER BY doc_id, pos) AS n FROM w
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS pos FROM r WHERE n > 1
), every AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM l
), kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS text, count(*) AS n
  FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos
  WHERE g.pos IS NULL GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(l.ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(l.ls), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def _windows(docs: DataFrame, most: int, words: int | None) -> DataFrame:
    """(id, th, pos, size, h1, h2): two 64-bit hashes, of different seeds, of each window of lines."""
    lines = docs.select("id", "th", F.split("text", "\n", -1).alias("ls"))
    names, sizes = [f"l{i}" for i in range(most)], range(1 if words is not None else most, most + 1)
    shifted = [F.slice("ls", i + 1, F.size("ls")).alias(x) for i, x in enumerate(names)]
    if words is not None:
        # Each line's words are counted once; the counts are shifted beside the lines.
        lines = lines.withColumn("ns", F.transform("ls", lambda x: F.regexp_count(x, F.lit("[^\\x09-\\x0D ]+"))))
        shifted += [F.slice("ns", i + 1, F.size("ns")).alias(f"n{i}") for i in range(most - 1)]
    each = lines.select("id", "th", F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w"))
    parts: list[Column] = [F.col(f"w.{x}") for x in names]
    found = []
    for size in sizes:
        own = parts[:size]
        good = own[-1].isNotNull() & (F.trim(F.concat(*own)) != "" if size == most else sum((F.col(f"w.n{i}") for i in range(size)), F.lit(0)) > words)
        found.append(F.when(good, F.struct(F.lit(size).alias("size"), F.xxhash64(F.lit(size), *own).alias("h1"), F.xxhash64(F.lit(-size), *own).alias("h2"))))
    if len(found) == 1:
        return each.select("id", "th", "pos", found[0].alias("w")).where("w IS NOT NULL").select("id", "th", "pos", "w.*")
    return each.select("id", "th", "pos", F.explode(F.array_compact(F.array(*found))).alias("w")).select("id", "th", "pos", "w.*")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, words: int | None = WORDS) -> DataFrame:
    """``docs`` with repeated runs of lines cut out of ``text_col``, plus n_lines and n_removed.

    Every ``window`` consecutive lines form a window, and fewer do if they hold over ``words`` words
    together (none do if ``words`` is None). Windows are equal if they have as many lines and these are equal, as they stand; their first occurrence in the order (id, text hash, position) stays, and all lines
    that any later occurrence covers go. Each removed line so remains at an earlier place. Kept
    lines are joined by a newline again; a document whose lines all go has an empty text.

    Windows of blank lines only are left alone. A null
    text stays null (n_lines 0). A null id sorts first and is an id like others. Rows with the
    same id and text count as one document: their windows repeat each other's only if they repeat
    elsewhere, and they get equal results. Other columns pass through; columns already called
    n_lines or n_removed are replaced. An empty table gives an empty result.
    """
    core = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), xor_key(F.col(text_col)).alias("th"))
    found = _windows(core.where(F.col("text").isNotNull()), window, words)
    place = F.struct("id", "th", "pos")
    # One row a repeated window, counted before the shuffle; checkpointed, so the join below is
    # between plain exchanges and a hot window can be split.
    repeated = cut(found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last"))
    later = found.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy(F.col("id").alias("__ld_id"), F.col("th").alias("__ld_th")).agg(F.collect_set(F.struct("pos", "size")).alias("__ld_at"))
    text = F.col(text_col)
    lines = F.split(text, "\n", -1)
    gone = F.array_distinct(F.flatten(F.transform("__ld_at", lambda p: F.sequence(p["pos"], p["pos"] + p["size"] - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    joined = docs.join(covered, F.col(id_col).eqNullSafe(F.col("__ld_id")) & (xor_key(text) == F.col("__ld_th")), "left")
    hit = F.col("__ld_at").isNotNull()
    return joined.select(
        *[c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(hit, F.size(gone)).otherwise(0).cast("long").alias("n_removed"),
        F.when(hit, F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")).otherwise(text).alias(text_col),
    )
