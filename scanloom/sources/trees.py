"""Report trees of any depth with cells of any type: nodes as rows, read and written as XML and as nested JSON.

A node is (tree, id, parent, place, name, cells): ``tree`` names the tree, ``parent`` is null for its root, ``place`` orders the children of one parent, and ``cells``
is a variant, an object with a value of any type for each column. Trees of a set have different names; ids are unique in their tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

NODES = "tree string, id long, parent long, place int, name string, cells variant"
_XML = "_tree string, _id long, _parent long, _place int, _name string, cell array<struct<_name: string, _type: string, _VALUE: string>>"


def nodes(rows: DataFrame) -> DataFrame:
    """Nodes from (tree, id, parent, place, name, cells) with the cells as a JSON text, a struct or a map; what isn't JSON is an error, null cells are an empty object."""
    kind = rows.schema["cells"].dataType.simpleString()
    text = F.col("cells") if kind == "string" else F.to_json("cells")
    return rows.withColumn("cells", F.parse_json(F.coalesce(text, F.lit("{}")))).select("tree", "id", "parent", "place", "name", "cells")


def cell(name: str, kind: str = "string", cells: str = "cells") -> Column:
    """A cell as the given type; null where it is missing or of another type."""
    return F.try_variant_get(F.col(cells), f"$['{name}']", kind)


def sorted_places(rows: DataFrame, name: str, ascending: bool = True) -> DataFrame:
    """The nodes with places by a cell of any type: numbers by value, then other values by text, then nodes without it; equal ones keep their order."""
    from pyspark.sql import Window

    number, text = cell(name, "double"), cell(name)
    rank = F.when(number.isNotNull(), 0).when(text.isNotNull(), 1).otherwise(2)
    keys = (number, text) if ascending else (F.desc_nulls_last(number), F.desc_nulls_last(text))
    w = Window.partitionBy("tree", "parent").orderBy(rank, *keys, "place", "id")
    return rows.withColumn("place", (F.row_number().over(w) - 1).cast("int"))


def write_xml(rows: DataFrame, path: str) -> None:
    """One element a node, with an element for each cell and its type; many files, whatever the trees' sizes."""
    texts, values = (F.from_json(F.to_json("cells"), f"map<string, {t}>") for t in ("string", "variant"))
    kind = lambda k: F.coalesce(F.schema_of_variant(F.element_at(values, k)), F.lit("VOID"))  # noqa: E731  it tells a text from what looks like a number
    typed = F.transform(F.map_entries(texts), lambda e: F.struct(e["key"].alias("_name"), kind(e["key"]).alias("_type"), F.coalesce(e["value"], F.lit("")).alias("_VALUE")))
    flat = rows.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), F.col("parent").alias("_parent"), F.col("place").alias("_place"), F.col("name").alias("_name"), typed.alias("cell"))
    flat.write.format("xml").option("rowTag", "node").option("rootTag", "nodes").mode("overwrite").save(path)


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Nodes that ``write_xml`` wrote."""
    read = spark.read.format("xml").option("rowTag", "node").option("ignoreSurroundingSpaces", False).schema(_XML).load(path)

    def as_json(c: Column) -> Column:
        value = F.coalesce(c["_VALUE"], F.lit(""))
        quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
        name = F.regexp_extract(F.to_json(F.struct(c["_name"].alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
        return F.concat(name, F.lit(":"), F.when(c["_type"] == "STRING", quoted).when(c["_type"] == "VOID", "null").otherwise(value))

    cells = F.concat(F.lit("{"), F.array_join(F.transform(F.coalesce("cell", F.array().cast(read.schema["cell"].dataType)), as_json), ","), F.lit("}"))
    return read.select(F.col("_tree").alias("tree"), F.col("_id").alias("id"), F.col("_parent").alias("parent"), F.col("_place").alias("place"), F.col("_name").alias("name"), F.parse_json(cells).alias("cells"))


def nested_json(rows: DataFrame) -> DataFrame:
    """(tree, json): each tree as one nested document, {name, cells, children}. Built from the leaves up, one grouping a level."""
    depth = stored(rows.where("parent is null").select("tree", "id", F.lit(0).alias("depth")))
    levels = [depth]
    while not levels[-1].isEmpty():
        up = levels[-1].select("tree", F.col("id").alias("parent"), "depth")
        levels.append(stored(rows.select("tree", "id", "parent").join(up, ["tree", "parent"]).select("tree", "id", (F.col("depth") + 1).alias("depth"))))
    below = None
    for level in reversed(levels[:-1]):
        here = rows.join(level, ["tree", "id"])
        kids = F.lit("[]")
        if below is not None:
            here, kids = here.join(below, ["tree", "id"], "left"), F.coalesce("kids", F.lit("[]"))
        name = F.regexp_extract(F.to_json(F.struct(F.coalesce("name", F.lit("")).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
        text = F.concat(F.lit('{"name":'), name, F.lit(',"cells":'), F.to_json("cells"), F.lit(',"children":'), kids, F.lit("}"))
        done = here.select("tree", F.col("parent").alias("id"), "place", F.col("id").alias("own"), text.alias("json"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "own", "json"))), lambda k: k["json"])
        below = stored(done.groupBy("tree", "id").agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("kids")))
    if below is None:
        return rows.sparkSession.createDataFrame([], "tree string, json string")
    return below.where("id is null").select("tree", F.expr("substring(kids, 2, length(kids) - 2)").alias("json"))


def from_nested_json(documents: DataFrame) -> DataFrame:
    """Nodes of (tree, json) documents, {name, cells, children}; ids number the nodes of a tree level by level."""
    from pyspark.sql import Window

    now = documents.select("tree", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("place"), F.parse_json("json").alias("v"))
    parts, first = [], documents.select("tree", F.lit(0).cast("long").alias("used"))
    while True:
        # A level's ids follow those of the levels above.
        place = F.row_number().over(Window.partitionBy("tree").orderBy("parent", "place"))
        level = stored(now.join(first, "tree").withColumn("id", (place + F.col("used")).cast("long")).withColumn("v", F.to_json("v")))
        if level.isEmpty():
            break
        v = F.parse_json("v")
        parts.append(level.select("tree", "id", "parent", "place", F.variant_get(v, "$.name", "string").alias("name"), F.parse_json(F.coalesce(F.to_json(F.variant_get(v, "$.cells", "variant")), F.lit("{}"))).alias("cells")))
        first = stored(level.groupBy("tree").agg(F.max("id").alias("used")))
        kids = F.posexplode(F.coalesce(F.variant_get(v, "$.children", "array<variant>"), F.array().cast("array<variant>")))
        now = level.select("tree", F.col("id").alias("parent"), kids.alias("place", "v"))
    out = parts[0] if parts else documents.sparkSession.createDataFrame([], NODES)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flat_table(rows: DataFrame, columns: list[str], friendly: dict[str, str] | None = None) -> DataFrame:
    """(tree, number, level, name, columns): the nodes as a flat table in the order of the tree, numbered 1, 1.1, 1.2, 2 and so on, cells as text under friendly names."""
    root = rows.where("parent is null").select("tree", "id", F.array((F.col("place") + 1).cast("int")).alias("path"))
    parts, now = [], stored(root)
    while not now.isEmpty():
        parts.append(now)
        up = now.select("tree", F.col("id").alias("parent"), F.col("path").alias("_up"))
        now = stored(rows.select("tree", "id", "parent", "place").join(up, ["tree", "parent"]).select("tree", "id", F.concat("_up", F.array((F.col("place") + 1).cast("int"))).alias("path")))
    if not parts:
        return rows.select("tree", F.lit("").alias("number"), F.lit(1).alias("level"), "name", *(F.lit("").alias((friendly or {}).get(c, c)) for c in columns)).limit(0)
    paths = parts[0]
    for p in parts[1:]:
        paths = paths.unionByName(p)
    named = rows.join(paths, ["tree", "id"])
    return named.select("tree", F.array_join(F.transform("path", lambda i: i.cast("string")), ".").alias("number"), F.size("path").alias("level"), "name", *(cell(c).alias((friendly or {}).get(c, c)) for c in columns))
