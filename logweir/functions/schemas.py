"""JSON Schemas of example objects, and how outputs conform to them.

Examples nest to any depth, so they are taken apart level by level: one row a value, its
children in the next level, until none has any. Then the texts are put together from the
deepest level upwards. Every distinct example is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.text import strip
from logweir.session import cut

# Type words an example text may start with, and the length of a description.
TYPE_WORDS = "string|number|integer|boolean"
DESCRIPTION_CHARS = 500

OPEN_OBJECT = '{"type": "object", "properties": {'
#: Separators outside strings, each with what is before it.
SEPARATOR = r'\G((?:[^",:]++|"(?:[^"\\]++|\\.)*+")*+[,:])'


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def kind_of(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def printed(value: Column, text: Column) -> Column:
    """A given value with a blank after each separator; ``text`` is the content of a string, else its JSON."""
    return F.when(kind_of(value) == "STRING", quoted(text)).otherwise(F.coalesce(F.regexp_replace(text, SEPARATOR, "$1 "), F.lit("null")))


def scalar_schema(value: Column, text: Column) -> Column:
    """Schema of a value that is neither an object nor an array."""
    kind, content = kind_of(value), strip(F.coalesce(text, F.lit("")))
    word = F.lower(F.regexp_extract(content, rf"(?i)^({TYPE_WORDS})(?=$|[ \-:])", 1))
    about = F.substring(strip(F.regexp_replace(content, rf"(?iU)^({TYPE_WORDS})\s*[-:()]?\s*", "")), 1, DESCRIPTION_CHARS)
    described = F.concat(
        F.lit('{"type": "'), F.when(word == "", "string").otherwise(word), F.lit('"'),
        F.when(about == "", "").otherwise(F.concat(F.lit(', "description": '), quoted(about))), F.lit("}"),
    )
    return F.when(kind == "BOOLEAN", '{"type": "boolean"}').when(kind.isin("STRING", "VOID"), described).otherwise('{"type": "number"}')


def joined(*parts: Column) -> Column:
    return F.array_join(F.concat(*parts), ", ")


def taking_apart() -> list[dict[str, Column]]:
    """Columns that take a value apart, step by step, so that each is worked out once.

    The last are ``before``, ``after`` and ``children``: the schema of a value is the text before,
    those of its children, and the text after; and ``deeper``, how the children are read.

    A value is read in one of three modes: ``shape``, an example; ``node``, which may be a schema
    already; ``root``, the same for a whole response, which is always an object.
    """
    value, text, mode, form = F.col("value"), F.col("text"), F.col("mode"), F.col("form")
    keys, values, texts, kind = F.col("keys"), F.col("values"), F.col("texts"), F.col("kind")
    strings, variants = "map<string,string>", "map<string,variant>"
    nothing = F.array().cast("array<string>")
    has = lambda key: F.array_contains(keys, key)
    steps = [{"kind": F.substring_index(kind_of(value), "<", 1)}]
    steps.append(
        {
            "keys": F.when(kind == "OBJECT", F.array_distinct(F.json_object_keys(text))),
            "values": F.when(kind == "OBJECT", F.try_variant_get(value, "$", variants)),
            "texts": F.when(kind == "OBJECT", F.from_json(text, strings)),
        }
    )
    steps.append(
        {
            "is_schema": (mode != "shape") & F.arrays_overlap(keys, F.array(*map(F.lit, ("type", "properties", "$schema")))),
            "named": F.when(kind_of(F.try_element_at(values, F.lit("type"))) == "STRING", F.try_element_at(texts, F.lit("type"))),
            "inner": F.when(kind_of(F.try_element_at(values, F.lit("properties"))).startswith("OBJECT"), F.try_element_at(texts, F.lit("properties"))),
        }
    )
    schema, named, inner = F.coalesce("is_schema", F.lit(False)), F.col("named"), F.col("inner")
    form_of = (
        F.when(schema & (mode == "root") & has("type") & ~named.eqNullSafe(F.lit("object")), "wrapped")
        .when(schema & inner.isNotNull(), "properties")
        .when(schema & ((mode == "root") | named.eqNullSafe(F.lit("object"))), "bare object")
        .when(schema & named.eqNullSafe(F.lit("array")), "items")
        .when(schema, "as given")
        .when(kind == "OBJECT", "object")
        .when(kind == "ARRAY", "array")
        .otherwise("scalar")
    )
    steps.append({"form": form_of})
    # Keys of a schema that stay, those before and after the one whose value is made of children, and names of children.
    kept, slot, names = F.col("kept"), F.col("slot"), F.col("names")
    steps.append(
        {
            "kept": F.when(schema, F.filter(keys, lambda key: key != "$schema")),
            "names": F.when(form == "object", F.filter(F.array_distinct(F.transform(keys, strip)), lambda key: key != "")).when(
                form == "properties", F.filter(F.array_distinct(F.json_object_keys(inner)), lambda key: strip(key) != "")
            ),
        }
    )
    steps.append({"slot": F.array_position("kept", F.when(form == "items", "items").when(form == "properties", "properties")).cast("int")})
    given = lambda some: F.transform(some, lambda key: F.concat(quoted(key), F.lit(": "), printed(F.try_element_at(values, key), F.try_element_at(texts, key))))
    listed = F.concat(F.lit('"required": ['), F.array_join(F.transform(names, quoted), ", "), F.lit("]"))
    steps.append({"given": given(kept), "required": listed})
    steps.append(
        {
            "head": F.when(slot > 0, F.slice("given", F.lit(1), slot - 1)).otherwise(F.col("given")),
            "tail": F.when(slot > 0, F.slice("given", slot + 1, F.size("given"))).otherwise(nothing),
            "filled": F.array_compact(
                F.array(
                    F.when(~has("type"), '"type": "object"'),
                    F.when((form == "properties") & ~has("required"), F.col("required")),
                    F.when(~has("additionalProperties"), '"additionalProperties": false'),
                )
            ),
        }
    )
    head, tail, filled, empty = F.col("head"), F.col("tail"), F.col("filled"), F.array(F.lit(""))
    closed = lambda required: F.concat(F.lit("}, "), required, F.lit(', "additionalProperties": false}'))
    before = (
        F.when(form.isin("wrapped", "object"), OPEN_OBJECT)
        .when(form == "properties", F.concat(F.lit("{"), joined(head, F.array(F.lit('"properties": {')))))
        .when(form == "items", F.concat(F.lit("{"), joined(head, F.array(F.lit('"items": ')))))
        .when(form == "bare object", F.concat(F.lit("{"), joined(head, filled)))
        .when(form == "as given", F.concat(F.lit("{"), joined(head)))
        .when(form == "array", '{"type": "array", "items": ')
        .otherwise(scalar_schema(value, text))
    )
    after = (
        F.when(form == "wrapped", closed(F.lit('"required": ["value"]')))
        .when(form == "object", closed(F.col("required")))
        .when(form == "properties", F.concat(F.lit("}"), joined(empty, tail, filled), F.lit("}")))
        .when(form == "items", F.concat(joined(empty, tail), F.lit("}")))
        .when(form == "scalar", "")
        .otherwise("}")
    )
    # Children of an object come from one pair of maps; the one of an array, and a wrapped schema, by themselves.
    steps.append(
        {
            "before": before,
            "after": after,
            "inner_values": F.when(form == "properties", F.try_variant_get(F.try_element_at(values, F.lit("properties")), "$", variants)).when(form == "object", values),
            "inner_texts": F.when(form == "properties", F.from_json(inner, strings)).when(form == "object", texts),
            "item_text": F.when(form == "items", F.coalesce(F.try_element_at(texts, F.lit("items")), F.when(~has("items"), '{"type":"string"}')))
            .when(form == "array", F.when(F.try_variant_get(value, "$[0]", "variant").isNull(), "string").otherwise(F.get(F.from_json(text, "array<string>"), F.lit(0))))
            .when(form == "wrapped", text),
            "item_value": F.when(form == "items", F.coalesce(F.try_element_at(values, F.lit("items")), F.when(~has("items"), F.parse_json(F.lit('{"type":"string"}')))))
            .when(form == "array", F.coalesce(F.try_variant_get(value, "$[0]", "variant"), F.parse_json(F.lit('"string"'))))
            .when(form == "wrapped", value),
        }
    )
    # Of names that only differ in blanks the first gives the place, the last the value.
    source = lambda name: F.when(form == "object", F.element_at(F.filter(keys, lambda key: strip(key) == name), -1)).otherwise(name)
    of_name = lambda name, place: F.struct(
        place.cast("int").alias("place"), name.alias("key"), F.try_element_at("inner_values", source(name)).alias("value"),
        F.try_element_at("inner_texts", source(name)).alias("text"),
    )
    lone = F.struct(F.lit(0).alias("place"), F.when(form == "wrapped", "value").alias("key"), F.col("item_value").alias("value"), F.col("item_text").alias("text"))
    children = F.when(names.isNotNull(), F.transform(names, of_name)).when(form.isin("items", "array", "wrapped"), F.array(lone))
    deeper = F.when(form.isin("object", "array"), "shape").otherwise("node")
    return [*steps, {"deeper": deeper, "children": children}]


def schema_texts(examples: DataFrame) -> DataFrame:
    """``id, json_schema`` of distinct examples ``id, text``."""
    root = examples.select(
        "id", F.array().cast("array<int>").alias("path"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("key"),
        F.try_parse_json("text").alias("value"), "text", F.lit("root").alias("mode"),
    )
    nodes = root.where(kind_of(F.col("value")).startswith("OBJECT") & (F.size(F.json_object_keys("text")) > 0))
    levels: list[DataFrame] = []
    steps = taking_apart()
    while True:
        for columns in steps:
            nodes = nodes.withColumns(columns)
        level = cut(nodes.select("id", "path", "place", "key", "before", "after", "deeper", "children"))
        levels.append(level.drop("children", "deeper"))
        below = level.select("id", F.col("path").alias("above"), F.col("deeper").alias("mode"), F.explode("children").alias("child"))
        if not below.take(1):
            break
        child = ("child.place", "child.key", F.coalesce("child.value", F.parse_json(F.lit("null"))).alias("value"), "child.text", "mode")
        nodes = below.select("id", F.concat("above", F.array("child.place")).alias("path"), *child)
    made = None
    for level in reversed(levels):
        text = F.concat("before", "after")
        if made is not None:
            parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "entry"))), lambda part: part["entry"]), ", ")
            inside = made.groupBy("id", F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(parts.alias("inside"))
            level = level.join(inside, ["id", "path"], "left")
            text = F.concat("before", F.coalesce("inside", F.lit("")), "after")
        entry = F.when(F.col("key").isNull(), text).otherwise(F.concat(quoted(F.col("key")), F.lit(": "), text))
        made = level.select("id", "path", "place", entry.alias("entry"))
    return made.select("id", F.col("entry").alias("json_schema"))


def schema_of_examples(df: DataFrame, example: str, result: str = "json_schema") -> DataFrame:
    """Add the JSON Schema of each example object; null where there is none."""
    key = F.sha2(F.col(example), 256)
    examples = df.where(F.col(example).isNotNull()).groupBy(key.alias("id")).agg(F.first(example).alias("text"))
    made = schema_texts(examples).select(F.col("id").alias("_example_id"), F.col("json_schema").alias(result))
    return df.withColumn("_id_of_example", key).join(made, F.col("_id_of_example") == F.col("_example_id"), "left").drop("_example_id", "_id_of_example")


def observed_schema(df: DataFrame, json_column: str, *keys: str) -> DataFrame:
    """The structure that a column of JSON texts really has, merged over all rows."""
    merged = F.schema_of_variant_agg(F.try_parse_json(json_column)).alias("observed_schema")
    return df.groupBy(*keys).agg(merged) if keys else df.agg(merged)


def conformance(df: DataFrame, json_column: str, schema: str, *keys: str) -> DataFrame:
    """Rows whose JSON fits a Spark schema, and rows that do not."""
    parsed = F.from_json(json_column, f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    fits = parsed.isNotNull() & parsed["_broken"].isNull()
    counted = df.select(*keys, fits.alias("_fits"))
    counts = [F.count_if("_fits").alias("conforming"), F.count_if(~F.col("_fits")).alias("deviating")]
    return counted.groupBy(*keys).agg(*counts) if keys else counted.agg(*counts)
