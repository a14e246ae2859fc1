"""Project documents that nobody has checked, read field by field from VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from cuemill.schema import PROJECT

#: Versions of the document that the schema stands for.
VERSIONS = (1,)


def _field(doc: Column, name: str, kind) -> tuple[Column, Column]:
    """A field's value as ``kind``, null where it can't be; and what is wrong with it, null if nothing is."""
    path = f"$.{name}"
    raw = F.try_variant_get(doc, path, "variant")
    found = F.regexp_extract(F.schema_of_variant(raw), "^[A-Z]+", 0)
    value = F.try_variant_get(doc, path, kind.simpleString())
    want = "OBJECT" if isinstance(kind, StructType) else "ARRAY" if isinstance(kind, ArrayType) else kind.simpleString().upper()
    # any value can be written as text, but a list or an object is no text
    nested = found.isin("ARRAY", "OBJECT")
    value = F.when(found == want, value) if want in ("ARRAY", "OBJECT") else F.when(~nested, value) if isinstance(kind, StringType) else value
    wrong = F.when(raw.isNotNull() & (found != "VOID") & value.isNull(), F.concat(F.lit(f"{name}: {want} expected, "), found, F.lit(" found")))
    return value, wrong


def read_documents(texts: DataFrame, text: str = "json", schema: StructType = PROJECT, versions: tuple[int, ...] = VERSIONS) -> DataFrame:
    """``texts`` with ``project`` (as ``schema``), ``errors`` and ``unknown`` instead of the column ``text``.

    A field of another type is read as its own where that can be done (a number
    in quotes, a number where a text is due), else it is null and ``errors``
    says what stood there; a field that is absent or null is no error.
    ``unknown`` lists the fields that the schema lacks, in order of their names.
    A version that is not known is an error, though what fits is read.  A text
    that is no JSON object has no project.
    """
    doc = F.try_parse_json(text)
    rows = texts.withColumn("_doc", doc).withColumn("_is", F.coalesce(F.startswith(F.schema_of_variant("_doc"), F.lit("OBJECT")), F.lit(False)))
    read = {f.name: _field(F.col("_doc"), f.name, f.dataType) for f in schema.fields}
    project = F.struct(*[value.alias(name) for name, (value, _) in read.items()])
    wrong = [w for _, w in read.values()]
    if "version" in read:
        version = read["version"][0]
        wrong.append(F.when(version.isNotNull() & ~version.isin(*versions), F.concat(F.lit("version "), version.cast("string"), F.lit(" is not known"))))
    errors = F.when(F.col("_is"), F.array_compact(F.array(*wrong))).otherwise(F.array(F.lit("no JSON object")))
    names = F.json_object_keys(F.col(text))
    unknown = F.when(F.col("_is"), F.array_sort(F.array_except(names, F.array(*[F.lit(f.name) for f in schema.fields])))).otherwise(F.array().cast("array<string>"))
    out = rows.withColumns({"project": F.when(F.col("_is"), project), "errors": errors, "unknown": unknown})
    return out.drop(text, "_doc", "_is")
