"""Column conventions and declared schemas.

Every table carries ``project``.  A snapshot is one (project, question_id, date); an entity is
identified inside its section by ``lower(entity)``.
"""

from pyspark.sql import types as T

SNAPSHOT = ["project", "question_id", "date"]
SECTION = SNAPSHOT + ["section"]
ENTITY = SECTION + ["entity"]

ALL_QUESTIONS = "_all"

# Sections and the item type each one yields.
ENTITY_SECTIONS = ["products", "organizations", "persons", "keywords", "places", "events", "links"]
COMPUTED_SECTIONS = ["linkTypes", "linkDomains"]

# Output sentinels.
NOT_MENTIONED = -1
UNKNOWN_RANK = 999

# Trend codes.
TREND_UP, TREND_DOWN, TREND_STABLE = 10, -1, 1
TREND_NEW, TREND_GONE = 999, -99
TREND_FLUCTUATING, TREND_UNKNOWN = 0, -9999

URL_CITATION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("url_citation", T.StructType([
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
    ])),
])

LINKED_RESULT = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
])

MESSAGE = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("annotations", T.ArrayType(URL_CITATION)),
    T.StructField("citations", T.ArrayType(LINKED_RESULT)),
    T.StructField("search_results", T.ArrayType(LINKED_RESULT)),
    T.StructField("context", T.StructType([
        T.StructField("citations", T.ArrayType(LINKED_RESULT)),
    ])),
])

RESPONSE = T.StructType([
    T.StructField("choices", T.ArrayType(T.StructType([T.StructField("message", MESSAGE)]))),
    T.StructField("citations", T.ArrayType(T.StringType())),
    T.StructField("_corrupt_record", T.StringType()),
])
