"""SBOL (RDF/XML) files -> one row per file ``(id, sequence, target)``.

* sequence: the first ``sbol:elements`` value (element text or attribute) in document order,
  normalised; '' when absent (S4).
* numeric values: distinct leaf texts and attribute values that parse as a float, in document
  order (S5); target = the first one, null when none (S6).
* id: the file name without its last suffix.
The RDF graph itself is not built: the XML is read as columns with Spark's ``xpath`` functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnaframe.functions.sequence import normalize, to_numeric

# Fixed value: the SBOL 2 namespace.
SBOL2_NS = "http://sbols.org/v2#"

# Spark's xpath reads XML without namespace resolution, so the property is matched by its local
# name (any prefix, or the default namespace).
_ELEMENT = "//*[local-name()='elements']/text()"
_ATTRIBUTE = "//@*[local-name()='elements']"
# Leaf texts and property attributes are triple objects; node ids (about / ID / nodeID), references to
# nodes (resource), literal annotations (datatype / lang / parseType) and namespace declarations are not.
_NO_VALUES = "|about|ID|nodeID|resource|datatype|lang|parseType|"
_LITERALS = ("/descendant::*[not(*)]/text() | "
             f"/descendant::*/@*[not(contains('{_NO_VALUES}', concat('|', local-name(), '|')) or starts-with(name(), 'xmlns'))]")
# One pass over a text gives its literals and a null before the sequence: a selected element has no value of its own.
# The sequence follows the null if its element holds text alone. If some element named so holds text beside
# attributes or other elements, all that holds it is selected too, so that two nulls come first.
_TEXTS = "/descendant::*[local-name()='elements'][text()]"
_FOUND = f"{_LITERALS} | {_TEXTS}[not(@* or *)] | {_TEXTS}[@* or *]/ancestor-or-self::node()"



def read_sbol(spark: SparkSession, path: str) -> DataFrame:
    return parse_sbol(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value"))


def parse_sbol(raw: DataFrame) -> DataFrame:
    """One row per XML text ``(name, value)``."""
    x = raw.select("name", "value", F.xpath(F.col("value"), F.lit(_FOUND)).alias("found"))
    x = x.select("*", F.array_position(F.transform("found", lambda v: v.isNull()), F.lit(True)).cast("int").alias("at"))
    # a text is parsed again only if the place of its sequence is open
    elem = F.get(F.xpath(F.col("value"), F.lit(_ELEMENT)), 0)
    attr = F.get(F.xpath(F.col("value"), F.lit(_ATTRIBUTE)), 0)
    mixed = (F.size("found") > 1) & F.get("found", 0).isNull() & F.get("found", 1).isNull()
    first = F.when(mixed, F.coalesce(elem, attr)).when(F.col("at") > 0, F.get("found", F.col("at"))).otherwise(attr)
    numbers = F.filter(F.transform(F.array_distinct("found"), lambda t: to_numeric(t)), lambda v: v.isNotNull())
    stem = F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", 1)
    return x.select(
        stem.alias("id"),
        normalize(first).alias("sequence"),
        F.get(numbers, 0).alias("target"),
    )
