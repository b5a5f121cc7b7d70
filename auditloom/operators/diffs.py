"""Diffs to rows: lines with scope and resolved text, and one row of facts per diff. One Arrow pass, no shuffle."""

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions import commands, recipe
from auditloom.sources.work import rows_of_texts, spread

_LINE = [
    ("idx", T.IntegerType(), pa.int32()), ("side", T.StringType(), pa.string()), ("body", T.StringType(), pa.string()), ("file", T.StringType(), pa.string()), ("lineno", T.IntegerType(), pa.int32()),
    ("function", T.StringType(), pa.string()), ("callers", T.ArrayType(T.StringType()), pa.list_(pa.string())), ("context", T.StringType(), pa.string()), ("resolved", T.StringType(), pa.string()), ("whole", T.BooleanType(), pa.bool_()),
    ("pipe_from", T.StringType(), pa.string()), ("pipe_to", T.StringType(), pa.string()), ("marks", T.ArrayType(T.StringType()), pa.list_(pa.string())),
]

_URL = re.compile(r"(?<![a-z0-9+])[a-z][a-z0-9+]{0,20}://[^\s\"'()<>`]+", re.I)
_DIGEST = re.compile(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$", re.I)
_OID = re.compile(r"^(?:Subproject commit ([0-9a-f]{40})|oid sha256:([0-9a-f]{64}))")
_SUMS = re.compile(r"^\s*(?:md5|sha1|sha224|sha256|sha384|sha512|b2)sums(?:_\w+)?\+?=")
#: The arrays of a recipe that name other packages.
DEPENDENCY_FIELDS = ("depends", "makedepends", "checkdepends", "optdepends", "provides", "replaces", "conflicts")


_READ = tuple[list[recipe.Line], dict[str, str], dict[str, list[str]]]


def given(diffs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The id and the text of every diff that is not empty, over all cores."""
    return spread(diffs.where(F.length(text_column) > 0).select(id_column, F.col(text_column).cast("string").alias("_t")))


def lines_of(read: _READ) -> list[tuple]:
    """A row per line, see diff_lines."""
    for x in read[0]:
        if x.side == "+":
            x.marks = commands.marks_of(x.body, x.resolved)
    return [tuple(getattr(x, n) for n, _, _ in _LINE) for x in read[0]]


def diff_lines(diffs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per line of each diff: the id, idx, side, body, file, lineno, function, callers, context, resolved, whole, pipe_from, pipe_to, marks.

    side is + or - or ' ' (context), @ for headers. resolved is the logical line with its variables put in, on the first line of
    a continued one; NULL on headers and continuations. marks are the ids of the rules that an added line's commands meet. NULL and empty
    diffs have no lines. Texts without headers are all context.
    """
    schema = T.StructType([diffs.schema[id_column], *(T.StructField(n, k) for n, k, _ in _LINE)])
    run = rows_of_texts({n: k for n, _, k in _LINE}, lambda text: lines_of(recipe.read(text)), id_column)
    return given(diffs, id_column, text_column).mapInArrow(run, schema)


def _items(arrays: dict[str, list[str]], scalars: dict[str, str], name: str) -> list[str]:
    return arrays.get(name, [scalars[name]] if scalars.get(name) else [])


def _bare(names: list[str]) -> list[str]:
    return sorted({x for x in (re.split(r"[<>=:]", n, maxsplit=1)[0].strip().lower() for n in names) if x})


#: Programs that take dependencies from a registry, and the words by which they do.
_REGISTRIES = {**dict.fromkeys(("npm", "pnpm", "yarn", "bun"), ("install", "i", "add", "ci")), **dict.fromkeys(("pip", "pip3"), ("install",)), "gem": ("install",), "bundle": ("install",), "composer": ("install", "require"), "cargo": ("install", "fetch"), "go": ("get", "install")}
_PINNED = ("--locked", "--frozen", "--frozen-lockfile", "--no-index", "--offline", "--require-hashes", "ci")


def _registry(text: str) -> list[str]:
    """The programs of a line that resolve dependencies from a registry without being held to a lock."""
    own = [recipe.bare_words(w) for w, _, _ in recipe.simple_commands(recipe.strip_comment(text))]
    return [w[0] for w in own if len(w) > 1 and w[1] in _REGISTRIES.get(w[0], ()) and not set(w) & set(_PINNED)]


def facts_of(read: _READ) -> dict:
    """What one diff, as read, changes, as flags and sets; before is the old side, after the new one."""
    lines, scalars, arrays = read
    old = [recipe.Line(x.idx, " ", x.body, x.file) for x in lines if x.side in (" ", "-")]
    was, were = recipe.assignments(recipe.joined(old))
    # Urls as written: a line that only means another version by its variables names the same source.
    written = {side: {u for x in lines if x.side == side for u in _URL.findall(recipe.strip_comment(x.body))} for side in "+-"}
    added = sorted({recipe.expand(u, scalars, arrays)[0] for u in written["+"] - written["-"]})
    removed = sorted({recipe.expand(u, was, were)[0] for u in written["-"] - written["+"]})
    sums = lambda a, s: [w for n in sorted({*a, *s}) if _SUMS.match(n + "=") for w in _items(a, s, n)]
    now, then = sums(arrays, scalars), sums(were, was)
    version = {k: (was.get(k), scalars.get(k)) for k in ("pkgver", "pkgrel", "epoch")}
    n_sources = len(_items(arrays, scalars, "source"))
    keys, keys_before = set(_items(arrays, scalars, "validpgpkeys")), set(_items(were, was, "validpgpkeys"))
    carried = {side: {m.group(1) or m.group(2) for x in lines if x.side == side and (m := _OID.match(x.body))} for side in "+-"}
    out = {
        "carriers_moved": carried["+"] != carried["-"] and bool(carried["+"]), "hook_declared": bool(scalars.get("install")) or any((x.file or "").endswith(".install") for x in lines),
        "computed_sources": any("$(" in w or "`" in w for n, own in arrays.items() if re.fullmatch(r"source(?:_\w+)?", n) for w in own) and any(x.side == "+" and ("$(" in x.body or "`" in x.body) for x in lines),
        "odd_version": bool(re.search(r"[^A-Za-z0-9._+~:-]", scalars.get("pkgver", ""))) and any("pkgver" in x.body and "://" in x.body for x in lines),
        "added_lines": sum(x.side == "+" for x in lines), "removed_lines": sum(x.side == "-" for x in lines),
        "files": sorted({x.file for x in lines if x.file}), "added_urls": added, "removed_urls": removed,
        "pkgver_before": version["pkgver"][0], "pkgver_after": version["pkgver"][1], "version_changed": any(a != b for a, b in version.values()), "epoch_added": not was.get("epoch") and bool(scalars.get("epoch")),
        "sums_changed": now != then and bool(now), "sums_removed": bool(then) and not now, "sums_skipped": "SKIP" in now and "SKIP" not in then and any(_DIGEST.match(x) for x in then),
        "sums_emptied": any(x.side == "+" and (m := re.match(r"\s*(\w+)=\(\s*\)", x.body)) and _SUMS.match(m[1] + "=") and not arrays.get(m[1], [""]) for x in lines),
        "sums_short": 0 < len(now) < n_sources, "digests": sorted({x.lower() for x in now if _DIGEST.match(x)}),
        "keys_added": sorted(keys - keys_before), "keys_removed": sorted(keys_before - keys),
        "functions_changed": sorted({x.function for x in lines if x.side in "+-" and x.function and x.body.strip()}),
        "parse_time": sum(x.side == "+" and x.function is None and x.file is not None and bool(re.match(r"\s*\w+\+?=.*(?:\$\((?!\()|`)", recipe.strip_comment(x.body))) for x in lines),
        "registry_installs": sorted({n for x in lines if x.side == "+" and x.resolved and x.function for n in _registry(x.resolved)}),
        "scriptlet_unread": any(x.side == "+" and re.match(r"\s*install=", x.body) for x in lines) and not any((x.file or "").endswith(".install") for x in lines),
        "unresolved": sum(1 for x in lines if x.side == "+" and x.resolved is not None and not x.whole and "://" in x.resolved), "oversized": sum(len(x.body) > recipe.LINE_CHARS or x.overgrown for x in lines),
    }
    for name in DEPENDENCY_FIELDS:
        a, b = set(_bare(_items(were, was, name))), set(_bare(_items(arrays, scalars, name)))
        out[name + "_added"], out[name + "_removed"] = sorted(b - a), sorted(a - b)
    return out


def _kind(v: object) -> T.DataType:
    return T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.ArrayType(T.StringType()) if isinstance(v, list) else T.StringType()


_FACTS = T.StructType([T.StructField(k, _kind(v)) for k, v in facts_of(recipe.read("")).items()])
_ARROW = {T.BooleanType(): pa.bool_(), T.LongType(): pa.int64(), T.StringType(): pa.string(), T.ArrayType(T.StringType()): pa.list_(pa.string())}


FACT_KINDS = {f.name: _ARROW[f.dataType] for f in _FACTS}


def diff_facts(diffs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row of facts per diff, see facts_of. NULL and empty diffs have none."""
    schema = T.StructType([diffs.schema[id_column], *_FACTS])
    run = rows_of_texts(FACT_KINDS, lambda text: [tuple(facts_of(recipe.read(text)).values())], id_column)
    return given(diffs, id_column, text_column).mapInArrow(run, schema)


# ---- the same steps in plain expressions, where nothing has to be parsed ---------------------------------------------


def text_lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, idx, body: a text's lines. Only \\n ends a line, \\r\\n counts as \\n, one empty line at the end is no line."""
    t = F.regexp_replace(F.regexp_replace(F.col(text_column), "\r\n", "\n"), r"\n\z", "")
    known = docs.where(F.length(text_column) > 0)
    return known.select(id_column, F.posexplode(F.split(t, "\n", -1)).alias("idx", "body"))


def numbered(lines: DataFrame, id_column: str) -> DataFrame:
    """lines with file and lineno on the new side of a diff, by windows over one text's lines. Texts without headers have neither.

    A `+++` names the file, a hunk header sets the number; removed lines carry it without moving it on.
    """
    w = Window.partitionBy(id_column).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    hunk = F.nullif(F.regexp_extract("body", r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)", 1), F.lit("")).cast("int")
    named = F.nullif(F.regexp_extract("body", r"^\+\+\+ (?:[ab]/)?([^\t]*)", 1), F.lit(""))
    rows = lines.withColumns({"_f": F.last(named, ignorenulls=True).over(w), "_h": F.last(F.when(hunk.isNotNull(), F.struct("idx", hunk.alias("at"))), ignorenulls=True).over(w)})
    header = F.col("body").rlike(r"^(?:@@ |\+\+\+ |--- )")
    moves = (~header & ~F.col("body").startswith("-") & F.col("_h").isNotNull()).cast("int")
    inside = Window.partitionBy(id_column, F.col("_h.idx")).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("_h.at") + F.sum(moves).over(inside) - 1
    return rows.select(id_column, "idx", F.col("_f").alias("file"), F.when(~header & ~F.col("body").startswith("-"), at).cast("int").alias("lineno"))


def continued(lines: DataFrame, id_column: str) -> DataFrame:
    """id, idx (of its first line), n_lines: logical lines, where a \\ at the end of a line continues it on the next."""
    w = Window.partitionBy(id_column).orderBy("idx")
    open_ = (F.length(F.regexp_extract("body", r"\\+$", 0)) % 2 == 1)
    starts = F.coalesce(~F.lag(open_).over(w), F.lit(True)).cast("int")
    grouped = lines.withColumn("_g", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(id_column, "_g").agg(F.min("idx").alias("idx"), F.count(F.lit(1)).alias("n_lines")).drop("_g")


def compacted(lines: DataFrame, id_column: str) -> DataFrame:
    """id, idx, body: logical lines without outer white space, empty ones left out, numbered anew from 0."""
    w = Window.partitionBy(id_column).orderBy("idx")
    open_ = F.length(F.regexp_extract("body", r"\\+$", 0)) % 2 == 1
    grouped = lines.withColumns({"_o": open_, "_s": F.coalesce(~F.lag(open_).over(w), F.lit(True)).cast("int")}).withColumn("_g", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.when(F.col("_o"), F.concat(F.regexp_replace("body", r"\\$", ""), F.lit(" "))).otherwise(F.col("body"))
    # A group is one logical line.
    whole = grouped.groupBy(id_column, "_g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", part.alias("t")))), lambda x: x["t"]), "").alias("body"))
    kept = whole.withColumn("body", F.btrim("body", F.lit(" \t\x0b\x0c\r"))).where("body <> ''")
    return kept.select(id_column, (F.row_number().over(Window.partitionBy(id_column).orderBy("_g")) - 1).alias("idx"), "body")


def is_trivial() -> Column:
    """Of facts: does a diff change nothing but version and checksums, and sources only with the version."""
    lists = ("depends_added", "depends_removed", "makedepends_added", "makedepends_removed", "functions_changed", "keys_added", "keys_removed", "registry_installs")
    still = ~(F.col("sums_removed") | F.col("sums_skipped") | F.col("sums_emptied") | F.col("epoch_added") | F.col("computed_sources") | F.col("hook_declared"))
    for c in lists:
        still &= F.size(c) == 0
    host = lambda side: F.array_distinct(F.transform(f"{side}_urls", lambda u: F.regexp_extract(u, "://([^/?#]+)", 1)))
    return F.col("version_changed") & still & (F.size(F.array_except(host("added"), host("removed"))) == 0)


def srcinfo(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, key, place, value: the distinct values of each key of a `key = value` text, in their order."""
    pair = text_lines(docs, id_column, text_column).select(
        id_column, "idx", F.regexp_extract("body", r"^[ \t]*([a-z0-9_]+) = (.*\S)", 1).alias("key"), F.regexp_extract("body", r"^[ \t]*([a-z0-9_]+) = (.*\S)", 2).alias("value")
    )
    first = pair.where("key <> ''").groupBy(id_column, "key", "value").agg(F.min("idx").alias("idx"))
    place = F.row_number().over(Window.partitionBy(id_column, "key").orderBy("idx"))
    return first.select(id_column, "key", place.alias("place"), "value")


def delta(old: DataFrame, new: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, change: what two sets of values per key have not in common; added or removed. NULL is a value."""
    both = old.select(*by, value, F.lit(-1).alias("s")).unionByName(new.select(*by, value, F.lit(1).alias("s"))).distinct().groupBy(*by, value).agg(F.sum("s").alias("s"))
    return both.where("s <> 0").select(*by, value, F.when(F.col("s") > 0, "added").otherwise("removed").alias("change"))


#: The names of what an audit may not have read, in their order.
GAPS = (
    "diff_truncated", "scan_truncated", "line_truncated", "tree_not_analyzed", "companion_truncated", "unresolved_source", "unresolved_parse_time", "snapshot_refused", "unpinned_build_deps", "unpinned_source_ref",
    "ruleset_drifted", "deps_not_scanned", "stage_degraded",
)


def coverage_gaps(facts: DataFrame, id_column: str, notes: DataFrame | None = None) -> DataFrame:
    """id, gaps: what of a diff could not be read, in the order of GAPS; only diffs with a gap.

    The diff itself tells of long lines, unread scriptlets and what only a run would resolve. notes: id, gap; what its source, the
    scan of its tree, its dependencies' scan or a failed stage tells of it; names that are not among GAPS are left out.
    """
    named: dict[str, Column] = {
        "line_truncated": F.col("oversized") > 0,
        "tree_not_analyzed": F.col("scriptlet_unread"),
        "unresolved_source": (F.col("unresolved") > 0) | F.col("computed_sources"),
        "unresolved_parse_time": F.col("parse_time") > 0,
        "unpinned_build_deps": F.size("registry_installs") > 0,
        "unpinned_source_ref": F.exists("added_urls", lambda u: u.rlike(r"^git\+") & ~u.rlike("#(?:commit|tag)=")),
    }
    rows = facts.select(id_column, F.explode(F.array(*(F.when(c, k) for k, c in named.items()))).alias("gap")).where("gap IS NOT NULL")
    rows = rows if notes is None else rows.unionByName(notes.join(facts.select(id_column), id_column, "left_semi").select(id_column, "gap").where(F.col("gap").isin(*GAPS)))
    # As many members as there are names.
    own = rows.groupBy(id_column).agg(F.collect_set("gap").alias("_g"))
    return own.select(id_column, F.filter(F.array(*(F.lit(g) for g in GAPS)), lambda g: F.array_contains("_g", g)).alias("gaps"))
