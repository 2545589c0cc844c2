"""The data model: three tables with the kind as a column, and the kind taxonomies."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _LONG, _TIME = T.StringType(), T.LongType(), T.TimestampNTZType()


def _table(strings: str, **others: T.DataType) -> T.StructType:
    """Columns of a table; those that aren't named among ``others`` are strings."""
    return T.StructType([T.StructField(c, others.get(c, _STRING)) for c in strings.split()])


ANCHOR = _table("kind serial source key", serial=_LONG)
DETAIL = _table("kind serial source key provider time_source time_sys record record_hash media_type", serial=_LONG, time_source=_TIME, time_sys=_TIME)
RELATION = _table(
    "kind_from kind_to serial source_from key_from relation_kind source_to key_to provider time_sys time_source", serial=_LONG, time_sys=_TIME, time_source=_TIME
)
#: What import reads: entity and relation tuples side by side, in input order.
TUPLE = _table(
    "kind source key record media_type kind_from source_from key_from relation_kind kind_to source_to key_to provider time_source input_pos", time_source=_TIME, input_pos=_LONG
)
MARC_RECORD = _table(
    "leader controlfield datafield", controlfield=T.ArrayType(_table("tag value")),
    datafield=T.ArrayType(_table("tag ind1 ind2 subfield", subfield=T.ArrayType(_table("code value")))),
)

NODE = ["kind", "source", "key"]
EDGE = ["kind_from", "source_from", "key_from", "relation_kind", "kind_to", "source_to", "key_to"]
DETAIL_KEY = ["kind", "source", "key", "provider", "record_hash"]

# Fixed values of the catalogue's taxonomy.
LINK_KINDS = ["url", "urn", "uri", "link", "href", "identifier"]
GROUPING_KINDS = ["group", "collection", "set", "array", "list", "pack", "bundle", "series", "serial", "concept"]

PAGE_DEFAULT, PAGE_MOST = 100, 10_000
OPERATIONS_PAGE = 300
