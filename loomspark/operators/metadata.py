"""Edges of a typed graph from metadata XML: one rule a kind of edge, read with XPath expressions."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where each kind of metadata file lies; its groups name the owner and the thing.
PATHS = {
    "object": r"(?:^|/)objects/([^/]+)/\1\.object-meta\.xml$",
    "field": r"(?:^|/)objects/([^/]+)/fields/([^/]+)\.field-meta\.xml$",
    "flow": r"(?:^|/)flows/([^/]+)\.flow-meta\.xml$",
    "rule": r"(?:^|/)objects/([^/]+)/validationRules/([^/]+)\.validationRule-meta\.xml$",
    "recordtype": r"(?:^|/)objects/([^/]+)/recordTypes/([^/]+)\.recordType-meta\.xml$",
    "permissionset": r"(?:^|/)permissionsets/([^/]+)\.permissionset-meta\.xml$",
    "layout": r"(?:^|/)layouts/([^/]+)\.layout-meta\.xml$",
}
RECORD_ELEMENTS = ("recordLookups", "recordUpdates", "recordCreates", "recordDeletes")


def _tag(*names: str) -> str:
    return "/".join(f"*[local-name()='{n}']" for n in names)


def _texts(path: str) -> Column:
    """The distinct texts at an XPath, in order of value."""
    return F.array_sort(F.array_distinct(F.filter(F.xpath("text", F.lit(f"{path}/text()")), lambda x: F.trim(x) != "")))


def _record_fields(root: ElementTree.Element) -> list[dict[str, str]]:
    """(object, field) of each record element: XPath expressions of a plan cannot relate the two."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    found = set()
    for element in root.iter():
        if local(element) in RECORD_ELEMENTS:
            owner = next((c.text for c in element if local(c) == "object" and c.text), None)
            found |= {(owner, c.text) for c in element.iter() if owner and local(c) == "field" and c.text}
    return [{"o": o, "f": f} for o, f in sorted(found)]


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files whose XML can be read (XPath fails on others), with ``pairs`` of their record elements."""
    for pdf in batches:
        pairs = []
        for text in pdf["text"]:
            try:
                pairs.append(_record_fields(ElementTree.fromstring(text)))
            except ElementTree.ParseError:
                pairs.append(None)
        out = pdf.assign(pairs=pairs)
        yield out[out["pairs"].notna()]


def metadata_files(files: DataFrame) -> DataFrame:
    """(path, text, type, owner, id, pairs) of metadata files (path, text): the entity that each one defines."""
    kind, first, second = F.lit(None).cast("string"), F.lit(""), F.lit("")
    for name, pattern in PATHS.items():
        hit = F.col("path").rlike(pattern)
        two = name in ("field", "rule", "recordtype")
        kind = F.when(hit, F.lit(name)).otherwise(kind)
        first = F.when(hit, F.regexp_extract("path", pattern, 1)).otherwise(first)
        if two:
            second = F.when(hit, F.regexp_extract("path", pattern, 2)).otherwise(second)
    known = files.select("path", "text", kind.alias("type"), first.alias("first"), second.alias("second")).where("type IS NOT NULL")
    sound = known.mapInPandas(_parsed, "path string, text string, type string, first string, second string, pairs array<struct<o: string, f: string>>")
    owner = F.when(F.col("type") == "layout", F.substring_index("first", "-", 1)).when(F.col("second") != "", F.col("first"))
    name = F.when(F.col("second") != "", F.concat_ws(".", "first", "second")).otherwise(F.col("first"))
    return sound.select("path", "text", "type", owner.alias("owner"), F.concat_ws(":", "type", name).alias("id"), "pairs")


def metadata_edges(files: DataFrame) -> DataFrame:
    """(src, dst, kind, detail): belongs_to, references, triggers_on, calls, shows and grants of the metadata among files.

    Links to fields hold only where a field of that name is defined here; calls name what they call, to be resolved by name.
    """
    meta = metadata_files(files)
    thing = lambda prefix, c: F.concat(F.lit(prefix), c)
    none = F.lit(None).cast("string")

    def each(kind: str, path: str, edge: str, prefix: str) -> DataFrame:
        rows = meta.where(F.col("type") == kind).select("id", F.explode(_texts(path)).alias("x"))
        return rows.select(F.col("id").alias("src"), thing(prefix, F.col("x")).alias("dst"), F.lit(edge).alias("kind"), none.alias("detail"))

    out = meta.where("owner IS NOT NULL").select(F.col("id").alias("src"), thing("object:", F.col("owner")).alias("dst"), F.lit("belongs_to").alias("kind"), none.alias("detail"))
    out = out.unionAll(each("field", "//" + _tag("referenceTo"), "references", "object:"))
    out = out.unionAll(each("flow", "//" + _tag("object"), "references", "object:"))
    out = out.unionAll(each("flow", "/" + _tag("Flow", "start", "object"), "triggers_on", "object:"))
    out = out.unionAll(each("flow", "//" + _tag("apexClass"), "calls", "name:")).unionAll(each("flow", "//" + _tag("flowName"), "calls", "name:"))

    # Permissions come in records of several tags: parallel arrays over the records' positions.
    sets = meta.where("type = 'permissionset'")
    names = ("allowRead", "allowCreate", "allowEdit", "allowDelete")
    granted = sets.select("id", F.explode(_texts("//" + _tag("objectPermissions", "object"))).alias("x"), *(F.xpath("text", F.lit(f"//*[local-name()='objectPermissions'][*[local-name()='{n}']='true']/*[local-name()='object']/text()")).alias(n) for n in names))
    rights = F.array_sort(F.array_compact(F.array(*(F.when(F.array_contains(n, F.col("x")), F.lit(n[5:].lower())) for n in names))))
    out = out.unionAll(granted.select("id", thing("object:", F.col("x")), F.lit("grants"), F.array_join(rights, ",")))
    fields = sets.select("id", F.explode(_texts("//" + _tag("fieldPermissions", "field"))).alias("x"), *(F.xpath("text", F.lit(f"//*[local-name()='fieldPermissions'][*[local-name()='{n}']='true']/*[local-name()='field']/text()")).alias(n) for n in ("readable", "editable")))
    access = F.array_join(F.array_compact(F.array(*(F.when(F.array_contains(n, F.col("x")), F.lit(n)) for n in ("readable", "editable")))), ",")
    out = out.unionAll(fields.select("id", thing("field:", F.col("x")), F.lit("grants"), access))
    out = out.unionAll(sets.select("id", F.explode(F.xpath("text", F.lit("//*[local-name()='classAccesses'][*[local-name()='enabled']='true']/*[local-name()='apexClass']/text()"))).alias("x")).select("id", thing("name:", F.col("x")), F.lit("grants"), none))

    # Fields named in formulas, layouts and record elements.
    formula = F.array_distinct(F.regexp_extract_all(F.xpath_string("text", F.lit("//" + _tag("errorConditionFormula"))), F.lit(r"\b([A-Za-z_]\w*__c)\b"), F.lit(1)))
    uses = meta.where("type = 'rule'").select("id", F.explode(formula).alias("f"), F.col("owner").alias("o"), F.lit("references").alias("kind"))
    uses = uses.unionAll(meta.where("type = 'layout'").select("id", F.explode(_texts("//" + _tag("field"))), "owner", F.lit("shows")))
    uses = uses.unionAll(meta.where("type = 'flow'").select("id", F.explode("pairs").alias("x")).select("id", "x.f", "x.o", F.lit("references")))
    defined = meta.where("type = 'field'").select(F.col("id").alias("field_id"))
    linked = uses.distinct().withColumn("field_id", F.concat(F.lit("field:"), "o", F.lit("."), "f")).join(defined, "field_id")
    return out.unionAll(linked.select(F.col("id"), "field_id", "kind", none)).where("src <> dst").distinct()
