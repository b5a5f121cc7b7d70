"""Properties of recipes, as the property history and the property machine take them: one Arrow pass over the recipes as they stand after a diff."""

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions import names, recipe
from auditloom.operators import diffs
from auditloom.sources.work import rows_of_texts

#: Build systems by the programs that drive them.
_BUILDERS = {
    "cmake": "cmake", "meson": "meson", "ninja": "meson", "make": "make", "gmake": "make", "configure": "autotools", "autoreconf": "autotools", "autogen.sh": "autotools", "cargo": "cargo", "go": "go", "npm": "npm", "yarn": "npm", "pnpm": "npm", "python": "python", "python3": "python", "pip": "python",
    "gradle": "gradle", "gradlew": "gradle", "mvn": "maven", "qmake": "qmake", "scons": "scons", "bazel": "bazel",
}
_HOST = re.compile(r"://(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*(?:/([^/?#]+))?")
_STOP = frozenset(names.STOPWORDS)


def _set(values: object) -> str:
    return json.dumps(sorted(set(values)), ensure_ascii=False)


def _scheme(v: str) -> str:
    """As names.version_scheme() tells."""
    for scheme, pattern in (("hash", r"[a-f][a-f0-9]{6,39}"), ("calver", r"\d{4}\.\d{1,2}(?:\.\d+)?"), ("date", r"\d{8}"), ("semver", r"\d+\.\d+\.\d+.*")):
        if re.fullmatch(pattern, v, re.S):
            return scheme
    return "other"


def properties_of(text: str) -> list[tuple[str, str]]:
    """(property_key, value) of a recipe or a diff's new side, value as JSON: a sorted set, a string or a boolean."""
    lines, scalars, arrays = recipe.read(text)
    body = [x for x in lines if x.side in ("+", " ") and x.context == "function_body" and {x.function, *x.callers} & {"prepare", "build", "check"} and x.body.strip() not in ("", "}")]
    commands = [recipe.bare_words(w) for x in body if x.resolved for w, _, _ in recipe.simple_commands(recipe.strip_comment(x.resolved))]
    programs = {w[0].rsplit("/", 1)[-1] for w in commands if w}
    places = [m for n, own in arrays.items() if re.fullmatch(r"source(?:_\w+)?", n) for s in own if (m := _HOST.search(s))]
    n = len(body)
    bucket = next((name for most, name in names.LINE_EDGES if n <= most), names.LINE_BEYOND)
    return [
        ("version_scheme", json.dumps(_scheme(scalars.get("pkgver", "")))), ("pkgdesc_tokens", _set(t for t in re.findall(r"[a-z][a-z0-9_\-]*", scalars.get("pkgdesc", "").lower()) if t not in _STOP)),
        ("depends", _set(re.split(r"[<>=:]", d, maxsplit=1)[0].strip() for d in arrays.get("depends", []) if d.strip())), ("source_hosts", _set(m[1].lower() for m in places)), ("source_orgs", _set(f"{m[1].lower()}/{m[2]}" for m in places if m[2])),
        ("build_system_markers", _set({_BUILDERS[p] for p in programs if p in _BUILDERS} or {"none"})), ("build_line_count", json.dumps(bucket)),
        ("configure_flags", _set(w.partition("=")[0] for own in commands for w in own[1:] if re.match(r"--?[A-Za-z][\w-]+", w))), ("install_hook_present", json.dumps(bool(scalars.get("install")))), ("license", _set(arrays.get("license", []))),
    ]


def recipe_properties(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, property_key, value, value_hash: ten properties of each recipe, in the form of package_properties. NULL and empty texts have none."""
    schema = T.StructType([docs.schema[id_column], T.StructField("property_key", T.StringType()), T.StructField("value", T.StringType())])
    rows = diffs.given(docs, id_column, text_column).mapInArrow(rows_of_texts({"property_key": pa.string(), "value": pa.string()}, properties_of, id_column), schema)
    return rows.withColumn("value_hash", F.sha2("value", 256))
