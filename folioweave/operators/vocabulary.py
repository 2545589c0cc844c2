"""Look-ups in code tables, and the joins of a registry dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# MARC codes of languages, countries and roles, and their names.
LANGUAGES = {
    "ara": "Arabic", "bel": "Belarusian", "bul": "Bulgarian", "chi": "Chinese", "cze": "Czech", "dan": "Danish", "dut": "Dutch", "eng": "English", "est": "Estonian", "fin": "Finnish",
    "fre": "French", "ger": "German", "grc": "Ancient Greek", "gre": "Greek", "heb": "Hebrew", "hun": "Hungarian", "ita": "Italian", "jpn": "Japanese", "kor": "Korean", "lat": "Latin",
    "lav": "Latvian", "lit": "Lithuanian", "nor": "Norwegian", "pol": "Polish", "por": "Portuguese", "rum": "Romanian", "rus": "Russian", "spa": "Spanish", "swe": "Swedish", "tat": "Tatar",
    "tur": "Turkish", "ukr": "Ukrainian",
}
COUNTRIES = {
    "au": "Austria", "be": "Belgium", "bu": "Bulgaria", "bw": "Belarus", "cc": "China", "dk": "Denmark", "enk": "England", "er": "Estonia", "fi": "Finland", "fr": "France", "gw": "Germany",
    "hu": "Hungary", "it": "Italy", "ja": "Japan", "kz": "Kazakhstan", "lv": "Latvia", "li": "Lithuania", "ne": "Netherlands", "no": "Norway", "pl": "Poland", "po": "Portugal", "rm": "Romania",
    "ru": "Russia", "sp": "Spain", "sw": "Sweden", "sz": "Switzerland", "tu": "Turkey", "un": "Ukraine", "xxc": "Canada", "xxk": "United Kingdom", "xxu": "United States",
}
RELATORS = {
    "aui": "Author of introduction", "aut": "Author", "cmp": "Composer", "com": "Compiler", "ctb": "Contributor", "cph": "Copyright holder", "crp": "Correspondent", "ctg": "Cartographer",
    "dst": "Distributor", "edt": "Editor", "ill": "Illustrator", "nrt": "Narrator", "pbl": "Publisher", "pht": "Photographer", "prf": "Performer", "prt": "Printer", "rev": "Reviewer",
    "sng": "Singer", "trl": "Translator",
}
#: Codes of a look-up that are written into the plan; more are joined.
INLINE = 500


def translated(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code, or the code itself; for tables of at most ``INLINE`` entries."""
    if len(labels) > INLINE:
        raise ValueError("join larger vocabularies as a table")
    if not labels:
        return code
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def joined_labels(rows: DataFrame, column: str, vocabulary: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with the label of ``column`` from a (code, label) table, or the code itself."""
    own = vocabulary.select(F.col("code").alias(column), F.col("label").alias("__label")).dropDuplicates([column])
    return rows.join(own, column, "left").withColumn(label, F.coalesce("__label", column)).drop("__label")


def registry_items(copies: DataFrame, parts: DataFrame, items: DataFrame, users: DataFrame, directories: DataFrame, ordered: bool = False) -> DataFrame:
    """Copies with their part, item and organisation (all required) and group (optional); by number if ``ordered``.

    Deleted copies and items are left out. Each side is a struct column under its role's name.
    """
    live = lambda df: df.where(~F.coalesce(F.col("deleted").cast("boolean"), F.lit(False)))
    packed = lambda df, name: df.select(F.col("id").alias(f"{name}_id"), F.struct("*").alias(name))
    own = live(copies).select(F.struct("*").alias("item"))
    found = own.join(packed(parts, "part"), F.col("item.part_id") == F.col("part_id")).drop("part_id")
    found = found.join(packed(live(items), "instance"), F.col("part.item_id") == F.col("instance_id")).drop("instance_id")
    found = found.join(packed(users, "organization"), F.col("item.user_id") == F.col("organization_id")).drop("organization_id")
    found = found.join(packed(directories, "group"), F.col("instance.doc_type") == F.col("group_id"), "left").drop("group_id")
    return found.orderBy(F.expr("try_cast(item.num AS INT)"), "item.id") if ordered else found
