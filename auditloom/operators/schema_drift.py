"""Schemas that drift between files: file schemas in parallel, folded through a type lattice, with an ordered change log.

A file is (feed, table_name, file_no); its header is what its records hold. Records are parsed once, in Arrow batches, into
one compact row each (field names, types, value digests), written to the shared folder; all else runs on those rows.
"""

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.sources.work import slices, stage_table

FILE = ["feed", "table_name", "file_no"]
#: JSON types, narrow to wide; ties of a majority go to the wider one.
JSON_TYPES = ("boolean", "integer", "double", "string", "array", "object")
_PARSED = "feed string, table_name string, file_no int, line_no int, record_key long, fields array<string>, types array<string>, digests array<long>"


def promote(a: str | None, b: str | None) -> str | None:
    """The narrowest type that holds both: NULL < boolean, integer < double; all else, mixed, is text.

    >>> promote("integer", "double"), promote("boolean", "integer"), promote(None, "array")
    ('double', 'string', 'array')
    """
    if a is None or b is None or a == b:
        return b if a is None else a
    return "double" if {a, b} == {"integer", "double"} else "string"


def _refuse(text: str) -> None:
    raise ValueError(text)


def _whole(text: str) -> str:
    """Without halves of surrogate pairs, which no column can hold."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def parse_object(payload: str | None) -> dict | None:
    """The payload as a dict if it is one whole JSON object, else None; nested too deep is broken.

    Numbers of one value are alike, however written, within arrays and objects; at the top they keep their type. Half surrogates become U+FFFD.

    >>> parse_object('{"a": 1.0, "b": [1.0]}'), parse_object('{"a": 1} x')
    ({'a': 1.0, 'b': [1]}, None)
    """
    if payload is None:
        return None
    try:
        value = json.loads(payload, parse_constant=_refuse)
        if not isinstance(value, dict):
            return None
        if "\\u" in payload:
            value = json.loads(_whole(json.dumps(value, ensure_ascii=False)), parse_constant=_refuse)
        return {k: _level(v) if isinstance(v, (list, dict)) else v for k, v in value.items()}
    except (ValueError, RecursionError):
        return None


def json_type(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    return {int: "integer", float: "double", str: "string", list: "array", dict: "object"}[type(value)]


def _level(value: object) -> object:
    """Numbers of one value alike, however written."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [_level(x) for x in value]
    return {k: _level(x) for k, x in value.items()} if isinstance(value, dict) else value


def _digest(value: object) -> int | None:
    """A 64-bit digest of the value; NULL for null."""
    if value is None:
        return None
    text = json.dumps(_level(value), sort_keys=True).encode()
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, to - at) for b in batches for at, to in slices(b.column("payload"), 8_000_000)):
        objects = [parse_object(p) for p in batch.column("payload").to_pylist()]
        kept = [i for i, o in enumerate(objects) if o is not None]
        rest = batch.select(["feed", "table_name", "file_no", "line_no", "record_key"]).take(pa.array(kept, pa.int64()))
        own = [objects[i] for i in kept]
        columns = [
            pa.array([list(o) for o in own], pa.list_(pa.string())),
            pa.array([[json_type(v) for v in o.values()] for o in own], pa.list_(pa.string())),
            pa.array([[_digest(v) for v in o.values()] for o in own], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays([*rest.columns, *columns], names=[*rest.schema.names, "fields", "types", "digests"])


def parsed_records(records: DataFrame) -> DataFrame:
    """One row per record whose payload is a whole JSON object, in the shared folder.

    Records without a feed, table or file number belong to no file and are left out; so are broken, empty and NULL payloads. Of a
    key that an object repeats the last value counts. Other columns are ignored.
    """
    source = records.select(
        "feed", "table_name", F.col("file_no").cast("int").alias("file_no"), F.col("line_no").cast("int").alias("line_no"), F.col("record_key").cast("long").alias("record_key"), "payload"
    )
    return stage_table(source.where(F.col("feed").isNotNull() & F.col("table_name").isNotNull() & F.col("file_no").isNotNull()).mapInArrow(_parse, _PARSED), "parsed")


_AREA = ["feed", "table_name", "block"]
_HELD = "array<struct<name:string,own:string,inner:string>>"


def file_schemas(parsed: DataFrame, block: int = 512) -> DataFrame:
    """One row per file, in the shared folder: feed, table_name, file_no, fields, prior_no and prior_fields of the file before (NULL for the first).

    fields: name to type, a map of what belongs to the file: a field that at least half its records hold; its type is that of most
    non-null values, else the type it had earlier. What a file owes to earlier ones is found in two levels, within blocks of consecutive
    numbers and then over what each block leaves behind, so that no window holds all files of a feed.
    """
    # The file itself is counted as the field NULL, beside its fields.
    both = F.concat(F.arrays_zip("fields", "types"), F.array(F.struct(F.lit(None).cast("string").alias("fields"), F.lit(None).cast("string").alias("types"))))
    cells = parsed.select(*FILE, F.explode(both).alias("c")).select(*FILE, F.col("c.fields").alias("field"), F.col("c.types").alias("t"))
    counts = cells.groupBy(*FILE, "field").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("t") == t, 1)).alias(t) for t in JSON_TYPES))
    most = F.array_max(F.array(*(F.struct(F.col(t).alias("n"), F.lit(i).alias("rank"), F.lit(t).alias("t")) for i, t in enumerate(JSON_TYPES))))
    # From here to the blocks' edges all stays where the block is.
    rows = counts.select(*FILE, F.floor(F.col("file_no") / block).alias("block"), "field", "n", F.when(most["n"] > 0, most["t"]).alias("own")).repartition(*_AREA)
    file = Window.partitionBy(*_AREA, "file_no")
    rows = rows.withColumn("records", F.max(F.when(F.col("field").isNull(), F.col("n"))).over(file)).where(F.col("field").isNull() | (2 * F.col("n") >= F.col("records")))
    line = Window.partitionBy(*_AREA, "field").orderBy("file_no")
    rows = rows.withColumn("inner", F.last("own", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    # A file has at most twice as many fields as its records have on average.
    held = F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct(F.col("field").alias("name"), "own", "inner"))))
    files = rows.groupBy(*_AREA, "file_no").agg(held.alias("held"))
    files = files.withColumn("before", F.lag(F.struct("file_no", "held")).over(Window.partitionBy(*_AREA).orderBy("file_no")))
    # What a block leaves: the last type of each field, and its last file under the field NULL.
    none = F.lit(None)
    left = rows.where("field IS NOT NULL").groupBy(*_AREA, "field").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("file_no"))).alias("type")).withColumn("last", none.cast(f"struct<file_no:int,held:{_HELD}>"))
    last = files.groupBy(*_AREA).agg(F.max_by(F.struct("file_no", "held"), "file_no").alias("last")).select(*_AREA, none.cast("string").alias("field"), none.cast("string").alias("type"), "last")
    over = Window.partitionBy("feed", "table_name", "field").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.unionByName(last).select(*_AREA, "field", F.last("type", ignorenulls=True).over(over).alias("type"), F.last("last", ignorenulls=True).over(over).alias("last"))
    entries = F.collect_list(F.when(F.col("field").isNotNull() & F.col("type").isNotNull(), F.struct("field", "type")))
    carried = carried.groupBy(*_AREA).agg(F.map_from_entries(entries).alias("outer"), F.max_by("last", F.when(F.col("field").isNull(), F.lit(1))).alias("last"))
    named = lambda c: F.map_from_arrays(F.transform(c, lambda x: x["name"]), F.transform(c, lambda x: F.coalesce(x["own"], x["inner"], F.try_element_at(F.col("outer"), x["name"]))))
    whole = files.join(carried, _AREA).withColumn("before", F.coalesce("before", "last"))
    return stage_table(whole.select(*FILE, named(F.col("held")).alias("fields"), F.col("before.file_no").alias("prior_no"), F.when(F.col("before").isNotNull(), named(F.col("before.held"))).alias("prior_fields")), "files")


def file_fields(files: DataFrame) -> DataFrame:
    """feed, table_name, file_no, field_name, type: one row per field of a file."""
    return files.select(*FILE, F.explode("fields").alias("field_name", "type"))


_AT = ["feed", "table_name", "file_no"]


def field_changes(parsed: DataFrame) -> DataFrame:
    """Every change of fields between a file and the one before it, as the log's rows.

    Result: feed, table_name, file_no (of the later file), change_kind (renamed, removed, added, retyped), field_name, new_name
    ('' unless renamed). A file without any whole record is no file. A field whose type was never seen is not retyped. Where
    several renames compete, the one with the largest share of equal values wins, then the first by name.
    """
    return _logged(parsed, file_schemas(parsed))


def _logged(parsed: DataFrame, files: DataFrame) -> DataFrame:
    now, then = F.map_keys("fields"), F.map_keys("prior_fields")
    other = lambda f: F.element_at("fields", f) != F.element_at("prior_fields", f)
    steps = files.where(F.col("prior_no").isNotNull()).select(
        *_AT, "prior_no", F.array_except(then, now).alias("gone"), F.array_except(now, then).alias("fresh"), F.filter(F.array_intersect(now, then), lambda f: F.coalesce(other(f), F.lit(False))).alias("retyped")
    )
    steps = steps.where((F.size("gone") > 0) | (F.size("fresh") > 0) | (F.size("retyped") > 0))
    pair = "struct<worse:double,field_name:string,new_name:string>"
    rows = steps.select(*_AT, "gone", "fresh", "retyped", F.lit(None).cast(pair).alias("p")).unionByName(rename_pairs(parsed, steps).select(*_AT, *(F.lit(None).cast("array<string>").alias(c) for c in ("gone", "fresh", "retyped")), "p"))
    # The best pair first, each name once: a fold over the few pairs of one step.
    taken: Callable[[Column, Column], Column] = lambda acc, x: F.exists(acc, lambda y: (y["field_name"] == x["field_name"]) | (y["new_name"] == x["new_name"]))
    chosen = F.aggregate(F.array_sort("pairs"), F.array().cast(f"array<{pair}>"), lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    own = rows.groupBy(*_AT).agg(*(F.max(c).alias(c) for c in ("gone", "fresh", "retyped")), F.collect_list("p").alias("pairs")).withColumn("renamed", chosen)
    change = lambda kind, f, new=None: F.struct(F.lit(kind).alias("change_kind"), f.alias("field_name"), (F.lit("") if new is None else new).alias("new_name"))
    lost, made = F.col("renamed.field_name"), F.col("renamed.new_name")
    log = F.concat(
        F.transform("renamed", lambda x: change("renamed", x["field_name"], x["new_name"])), F.transform(F.array_except("gone", lost), lambda f: change("removed", f)),
        F.transform(F.array_except("fresh", made), lambda f: change("added", f)), F.transform("retyped", lambda f: change("retyped", f)),
    )
    return own.select(*_AT, F.explode(log).alias("c")).select(*_AT, "c.*")


def rename_pairs(parsed: DataFrame, steps: DataFrame) -> DataFrame:
    """Pairs of a gone and a new field that hold the same value in more than half of the shared record keys: feed, table_name, file_no, p.

    steps: feed, table_name, file_no, prior_no, gone, fresh. Only fields of steps with both a gone and a new one are compared, record
    by record; the pairs of one record are as many as its gone fields times its new ones.
    """
    at = ["feed", "table_name", "step"]
    sides = F.array(F.struct("file_no", F.col("fresh").alias("names"), F.lit(True).alias("in_new")), F.struct(F.col("prior_no").alias("file_no"), F.col("gone").alias("names"), F.lit(False).alias("in_new")))
    wanted = steps.where((F.size("gone") > 0) & (F.size("fresh") > 0)).select("feed", "table_name", F.col("file_no").alias("step"), F.explode(sides).alias("s")).select(*at, "s.*")
    rows = parsed.where(F.col("record_key").isNotNull()).join(wanted, FILE)
    cells = rows.select(*at, "record_key", "in_new", "line_no", F.explode(F.filter(F.arrays_zip("fields", "digests"), lambda c: c["digests"].isNotNull() & F.array_contains("names", c["fields"]))).alias("c"))
    # A record that a file repeats counts once, with its last line.
    cells = cells.groupBy(*at, "record_key", "in_new", F.col("c.fields").alias("field")).agg(F.max_by("c.digests", F.struct("line_no", "c.digests")).alias("digest"))
    # As many members as a step has gone and new fields.
    sided = lambda new: F.collect_list(F.when(F.col("in_new") == new, F.struct("field", "digest")))
    records = cells.groupBy(*at, "record_key").agg(sided(False).alias("old"), sided(True).alias("new"))
    crossed = F.flatten(F.transform("old", lambda a: F.transform("new", lambda b: F.struct(a["field"].alias("field_name"), b["field"].alias("new_name"), (a["digest"] == b["digest"]).alias("same")))))
    pairs = records.select(*at, F.explode(crossed).alias("c")).groupBy(*at, "c.field_name", "c.new_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("c.same").alias("same")).where(2 * F.col("same") > F.col("n"))
    return pairs.select("feed", "table_name", F.col("step").alias("file_no"), F.struct((-F.col("same") / F.col("n")).alias("worse"), "field_name", "new_name").alias("p"))


def promoted(types: Column) -> Column:
    """promote() folded over an array of types; text where none was seen."""
    table = F.create_map(*(F.lit(x) for a in JSON_TYPES for b in JSON_TYPES for x in (f"{a} {b}", promote(a, b))))
    step = lambda acc, x: F.when(acc.isNull(), x).otherwise(F.element_at(table, F.concat(acc, F.lit(" "), x)))
    return F.coalesce(F.aggregate(types, F.lit(None).cast("string"), step), F.lit("string"))


def union_schema(parsed: DataFrame) -> DataFrame:
    """The union schema: per table and field the promoted type, with the feeds, files and first file that have it.

    Types are folded through promote() over the distinct types of a field, at most as many as there are JSON types.
    """
    fields = file_fields(file_schemas(parsed))
    return fields.groupBy("table_name", "field_name").agg(
        promoted(F.array_sort(F.collect_set("type"))).alias("type"), F.count_distinct("feed").alias("n_feeds"), F.count(F.lit(1)).alias("n_files"), F.min("file_no").alias("first_file_no")
    )


def canonical_fields(files: DataFrame, changes: DataFrame) -> tuple[dict[str, str], dict[str, str | None]]:
    """For the unified table: field name to column name, and column name to promoted type.

    Names that renames connect become one column, called by the name that most files use, unless the two ever belong to one
    file. Reads field names with their types, the distinct renames, and which of the renamed names meet in a file: rows by names, not by records.
    """
    fields = file_fields(files)
    spread = {r.field_name: (r.n, r.types) for r in fields.groupBy("field_name").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("type")).alias("types")).collect()}
    steps = changes.where(F.col("change_kind") == "renamed").groupBy("field_name", "new_name").count().collect()
    asked = sorted({n for r in steps for n in (r.field_name, r.new_name)})
    met = files.select(F.array_sort(F.array_intersect(F.map_keys("fields"), F.array(*(F.lit(n) for n in asked)).cast("array<string>"))).alias("s")).where(F.size("s") > 1).distinct()
    together = {(r.a, r.b) for r in met.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b").distinct().collect()} if asked else set()
    group = {f: {f} for f in spread}
    for r in sorted(steps, key=lambda r: (-r["count"], r.field_name, r.new_name)):
        a, b = group.get(r.field_name), group.get(r.new_name)
        if a is None or b is None or a is b or any((min(x, y), max(x, y)) in together for x in a for y in b):
            continue
        for f in b:
            group[f] = a
        a |= b
    names: dict[str, str] = {}
    types: dict[str, str | None] = {}
    for own in {id(g): g for g in group.values()}.values():
        lead = min(own, key=lambda f: (-spread[f][0], f))
        names |= dict.fromkeys(own, lead)
        types[lead] = reduce(promote, (t for f in sorted(own) for t in spread[f][1]), None)
    return names, types


_SPARK = {"boolean": "boolean", "integer": "long", "double": "double"}
_ARROW = {"boolean": pa.bool_(), "integer": pa.int64(), "double": pa.float64()}


def _cast(value: object, kind: str | None) -> object:
    """The value in the column's type; text keeps strings as they are and everything else as JSON; what doesn't fit a type is NULL."""
    if value is None:
        return None
    if kind == "boolean":
        return value if isinstance(value, bool) else None
    if kind == "integer":
        return value if type(value) is int and -(1 << 63) <= value < 1 << 63 else None
    if kind == "double":
        return float(value) if type(value) in (int, float) and abs(value) < 1e308 else None
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def unified_table(records: DataFrame, table_name: str) -> DataFrame:
    """All whole records of one table in one consistent schema.

    Columns record_id, feed, file_no, line_no, record_key, delivered_at, then one column per canonical field in the order of its
    name, in the promoted type (arrays and objects as JSON text). A field whose name differs from an earlier column only by
    case gets a suffix `__2`, `__3` and so on. Fields that belong to no file are strays and stay out of the columns, but not
    out of the result: `strays` holds them as JSON text. No record of the table: only the fixed columns and `strays`.
    """
    own = records.where(F.col("table_name") == table_name)
    parsed = parsed_records(own)
    files = file_schemas(parsed)
    names, types = canonical_fields(files, _logged(parsed, files))
    fixed = ["record_id", "feed", "file_no", "line_no", "record_key", "delivered_at"]
    used = {c.lower() for c in [*fixed, "strays"]}
    columns: dict[str, str] = {}
    for lead in sorted(types):
        name, k = lead, 1
        while name.lower() in used:
            k += 1
            name = f"{lead}__{k}"
        used.add(name.lower())
        columns[lead] = name

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, to - at) for b in batches for at, to in slices(b.column("payload"), 8_000_000)):
            objects = [parse_object(p) for p in batch.column("payload").to_pylist()]
            kept = [i for i, o in enumerate(objects) if o is not None]
            rest = batch.select(fixed).take(pa.array(kept, pa.int64()))
            values: dict[str, list] = {lead: [None] * len(kept) for lead in columns}
            strays: list[str | None] = [None] * len(kept)
            for at, i in enumerate(kept):
                left = {}
                for f, v in objects[i].items():
                    lead = names.get(f)
                    if lead is None:
                        left[f] = v
                    elif v is not None and (values[lead][at] is None or f == lead):
                        values[lead][at] = _cast(v, types[lead])
                        if values[lead][at] is None:
                            left[f] = v
                strays[at] = json.dumps(left, ensure_ascii=False) if left else None
            arrays = [pa.array(values[lead], _ARROW.get(types[lead], pa.string())) for lead in columns]
            yield pa.RecordBatch.from_arrays([*rest.columns, *arrays, pa.array(strays, pa.string())], names=[*fixed, *columns.values(), "strays"])

    source = own.select(*fixed, "payload")
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in fixed), *(f"`{columns[lead].replace('`', '``')}` {_SPARK.get(types[lead], 'string')}" for lead in columns), "strays string"])
    return source.mapInArrow(cast, schema)
