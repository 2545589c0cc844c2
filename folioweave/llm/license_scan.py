"""License scans by diagonal voting; DataFrame functions only.

Every two consecutive words of a text are hashed and joined to the places of the same two words in
the templates. A match votes for a diagonal, its place in the text less its place in the template;
an unbroken copy puts all votes of the template on one diagonal, an edited one on neighbouring
diagonals, which merge. A merged stretch is verified: the longest chain of its matches that rises in
both text and template must hold enough of the template, within a stretch not much longer than it.
The templates are the texts of ``license_texts``, so the table that is broadcast has a fixed size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import xor_key
from .license_texts import TEMPLATES

GRAM = 2
#: Fixed values of the result: phrases that count wherever their words stand consecutively.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Least share of a template's word pairs that a span must hold, and how far apart diagonals merge.
COVER, NEAR = 0.7, 2
#: Characters of a text that are split into words at a time.
PART = 1 << 17
_GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
_MARK = "\0doc"
_UPPER, _LOWER = (bytes(range(a, a + 26)).decode() for a in (65, 97))


def template_words(text: str) -> list[str]:
    """A template's words, as the texts are split."""
    return [w for w in re.split(f"[{_GAP}]+", text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def _grams(spark: SparkSession, base: dict[str, str], templates: tuple[tuple[str, str], ...], cover: float) -> DataFrame:
    rows = [(-1, 0, 0, 1, False, None, _MARK, None)]
    both = [(p, label, True) for p, label in base.items()] + [(p, label, False) for p, label in templates]
    for k, (phrase, label, is_base) in enumerate(both):
        w = template_words(phrase)
        # How far the diagonals of one copy may drift apart: words left out and added.
        drift = max(NEAR, int(len(w) * (1 - cover)))
        rows += [(k, i, len(w) - 1, drift, is_base, label, w[i], w[i + 1]) for i in range(len(w) - 1)]
    grams = spark.createDataFrame(rows, "template int, at int, size int, drift int, base boolean, label string, ta string, tb string")
    return F.broadcast(grams.withColumn("th", F.xxhash64("ta", "tb")))


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{_GAP}]+"), "")


def _word_pairs(docs: DataFrame, id_col: str, text_col: str, part: int) -> DataFrame:
    """(id, th0, n_words, pos, a, b): each word and the next; the last pair of a document is its mark and null.

    Long texts are split part by part, each part but the first beginning with a word and ending before one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    rows = docs.select(F.col(id_col).alias("id"), xor_key(F.col(text_col)).alias("th0"), low.alias("text"))
    text = F.col("text")
    rows = rows.withColumn("parts", F.when(F.length(text) <= part, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s).{{0,{part}}}[{_GAP}]++|[^{_GAP}]++[{_GAP}]*+"), F.lit(0))))
    # Words before each part; a text of one part needs no count.
    sizes = F.transform("parts", lambda p: F.size(_split(p)))
    before = F.aggregate(sizes, F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    many = F.size("parts") > 1
    heads = F.transform("parts", lambda p: F.regexp_extract(p, f"^[^{_GAP}]+", 0))
    each = F.arrays_zip(F.col("parts").alias("part"), F.slice(heads, 2, F.size("parts")).alias("next"), before.alias("before"))
    one = F.array(F.struct(text.alias("part"), F.lit(None).cast("string").alias("next"), F.lit(0).alias("before")))
    long = F.transform(F.slice(each, 1, F.size("parts")), lambda p: F.struct(p["part"].alias("part"), p["next"].alias("next"), p["before"].alias("before")))
    got = rows.select("id", "th0", F.explode(F.when(many, long).otherwise(one)).alias("p")).select("id", "th0", "p.*")
    # A part ends with the first word of the next; the last with the mark, which matches once in every document.
    words = got.select("id", "th0", "before", F.col("next").isNull().alias("last"), F.concat(_split(F.col("part")), F.array(F.coalesce("next", F.lit(_MARK)))).alias("ws"))
    pairs = words.select("id", "th0", "before", "last", F.size("ws").alias("n"), F.posexplode(F.arrays_zip("ws", F.slice("ws", 2, F.size("ws")).alias("next"))).alias("pos", "w"))
    pairs = pairs.where(F.col("last") | (F.col("pos") < F.col("n") - 1))
    return pairs.select("id", "th0", (F.col("before") + F.col("pos")).alias("pos"), F.col("w.ws").alias("a"), F.col("w.next").alias("b"))


def _chain(matches: Column) -> Column:
    """How many matches the longest chain that rises in both text and template holds.

    ``matches`` ascend by place in the text, and descend by place in the template among equals.
    ``done[k]`` is the least place in the template at which a chain of k + 1 matches ends.
    """
    def step(done: Column, m: Column) -> Column:
        k = F.size(F.filter(done, lambda t: t < m["at"]))
        return F.concat(F.slice(done, 1, k), F.array(m["at"]), F.slice(done, k + 2, F.greatest(F.size(done) - k - 1, F.lit(0))))

    return F.size(F.aggregate(matches, F.array().cast("array<int>"), step))


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    base: dict[str, str] | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES, cover: float = COVER, part: int = PART,
) -> DataFrame:
    """One row for each document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of characters other than ASCII non-alphanumerics, A-Z lower-cased. ``n_base``
    counts the places of ``base`` phrases, first_word and last_word their smallest and largest first
    word. ``spans`` are the verified places (first word, last word, label, share of word pairs) of
    phrases and of templates. Diagonals of a template up to ``NEAR`` apart form a run; a run is looked
    at in stretches of twice the drift that a copy may have, each half over the next, so any copy lies
    in one. A stretch counts where the longest chain of its matches that rises in text and template
    holds at least ``cover`` of the template's word pairs; that share is the span's. ``score`` is the
    largest share found, 1 for a phrase, 0 for none.

    A null or empty text has no words and no labels. Rows of the same id and text are scanned
    as one and give a row each; a null id is an id. Other columns are neither read nor returned. An empty
    table gives an empty result. Phrases and templates need two words or more.
    """
    base = BASE if base is None else base
    pairs = _word_pairs(docs, id_col, text_col, part)
    grams = _grams(docs.sparkSession, base, templates, cover)
    hits = pairs.withColumn("h", F.xxhash64("a", "b")).join(grams, (F.col("h") == F.col("th")) & (F.col("a") == F.col("ta")) & F.col("b").eqNullSafe(F.col("tb")))
    of = ["id", "th0", "template", "base", "label", "size", "drift"]
    doc = F.col("template") < 0
    # The mark's place is the number of words.
    votes = hits.groupBy(*of, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.count("*").alias("votes"))
    one = Window.partitionBy("id", "th0", "template").orderBy("diagonal")
    far = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(one) > NEAR)
    runs = votes.withColumn("new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(one))
    all_of = Window.partitionBy("id", "th0", "template", "run")
    runs = runs.withColumns({"low": F.min("diagonal").over(all_of), "wide": F.max("diagonal").over(all_of) - F.min("diagonal").over(all_of)})
    at = F.floor((F.col("diagonal") - F.col("low")) / F.col("drift")).cast("int")
    windows = F.when(F.col("wide") <= F.col("drift"), F.array(F.lit(0))).otherwise(F.filter(F.array(at, at - 1), lambda w: w >= 0))
    matches = F.transform("ats", lambda a: F.struct((F.col("diagonal") + a).alias("pos"), (-a).alias("back"), a.alias("at")))
    spans = runs.select(*of, "run", "votes", F.explode(windows).alias("w"), matches.alias("matches")).groupBy(*of, "run", "w").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("ms"), F.max("votes").alias("votes"))
    held = F.size(F.array_distinct(F.transform("ms", lambda m: m["at"])))
    enough = ~doc & (held >= F.when(F.col("base"), F.col("size")).otherwise(F.ceil(F.col("size") * F.lit(cover))))
    spans = spans.withColumns({"held": F.when(enough, F.when(F.col("base"), F.col("size")).otherwise(_chain(F.col("ms")))), "n_words": F.when(doc, F.element_at("ms", 1)["pos"])})
    spans = spans.withColumns({"first": F.element_at("ms", 1)["pos"], "last": F.element_at("ms", -1)["pos"] + GRAM - 1, "share": F.when(F.col("size") > 0, F.col("held") / F.col("size"))})
    good = F.coalesce(F.when(F.col("base"), F.col("held").isNotNull()).otherwise(F.col("share") >= cover), F.lit(False))
    good_base = F.coalesce(F.col("base") & good, F.lit(False))
    # Of a run's stretches the best is its span.
    best = F.row_number().over(all_of.orderBy(F.desc_nulls_last("share"), "first")) == 1
    spans = spans.withColumns({"good": good, "good_base": good_base, "best": best})
    listed = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    # The mark stands once in each row, so its votes tell how many rows of the same id and text there are.
    found = spans.groupBy(F.col("id").alias(id_col), "th0").agg(
        F.max(F.when(F.col("n_words").isNotNull(), F.col("votes"))).alias("rows"),
        F.max("n_words").cast("long").alias("n_words"), F.count_if("good_base").alias("n_base"), F.min(F.when(F.col("good_base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("good_base"), F.col("first"))).cast("long").alias("last_word"), listed(F.col("good_base")).alias("base_labels"), listed(F.col("good")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("good"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("good") & F.col("best"), F.struct("first", "last", "label", "share")))).alias("spans"),
    )
    return found.withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("th0", "rows")
