"""What a diff's added lines write, fetch and execute, and the findings that follow from an execution of what was written.

One Arrow pass turns each diff into rows of actions; the rest are equi-joins on (diff, function, file name). Writes are reduced
to their first line per name before the join, so an execution meets at most one row of each kind of write.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions import payload, recipe
from auditloom.operators import diffs
from auditloom.sources.work import rows_of_texts, stage_table

#: Programs of a project's own build that a recipe may write and run.
BENIGN = ("configure", "configure.sh", "autogen.sh", "bootstrap", "build.ninja", "Makefile", "setup.py", "gradlew", "mvnw")
PACKAGING = ("package", *recipe.HOOKS)
_URL = re.compile(r"(?<![a-z0-9+])[a-z][a-z0-9+]{0,20}://[^\s\"'()<>`|;]+", re.I)
_KINDS = [("idx", T.IntegerType(), pa.int32()), ("function", T.StringType(), pa.string()), ("kind", T.StringType(), pa.string()), ("path", T.StringType(), pa.string()), ("base", T.StringType(), pa.string())]


def source_name(entry: str) -> str:
    """The file name under which a source entry arrives: before `::` if it is renamed, else the last part of its url."""
    name, renamed, _ = entry.partition("::")
    return name if renamed else re.sub(r"[?#].*$", "", entry.rstrip("/")).rsplit("/", 1)[-1]


_BUILD_ONLY = re.compile(r"\$\{?(?:srcdir|startdir|pkgdir|BUILDDIR|PWD)\b")
#: Programs that take a file as data or are judged elsewhere when they are given one.
_HANDLERS = {*recipe.INTERPRETERS, *recipe.COPIERS, *recipe.COMPILERS, *recipe.FETCHERS, "tee", "cat", "echo", "printf", "rm", "mkdir", "cd", "chmod", "chown", "touch", "sed", "grep", "test", "[", "make", "gmake", "ninja"}
#: Targets that every build of that kind has.
_USUAL_TARGETS = frozenset({"all", "build", "install", "check", "test", "tests", "clean", "distclean", "dist", "docs", "doc", "html", "man", "release", "default", "install-strip"})


def _targets(text: str) -> list[str]:
    """The unusual targets that a line gives to make or ninja."""
    out = []
    for words, _, _ in recipe.simple_commands(text):
        own = recipe.bare_words(words)
        if own and own[0] in ("make", "gmake", "ninja"):
            plain = [w for before, w in zip(own, own[1:]) if not w.startswith("-") and "=" not in w and not w.isdigit() and before not in ("-C", "-f", "-j", "-l", "-o", "-I", "--directory", "--file", "--makefile")]
            out += [w for w in plain if w not in _USUAL_TARGETS and not re.search(r"[$/]", w)]
    return out


def _text_below(lines: list[recipe.Line], x: recipe.Line, quoted: set[int]) -> Iterator[str]:
    """The here-document's lines that follow a line. idx is a line's place in the diff."""
    for y in lines[x.idx + 1 :]:
        if y.idx not in quoted:
            return
        yield y.body


def actions_of(read: diffs._READ) -> list[tuple[int, str | None, str, str, str]]:
    """(idx, function, kind, path, base) of a diff, as read: its declared sources, then what its added lines do within functions that are run.

    function is the enclosing one if a package manager runs it, else the first of its callers that is. Here-document texts do nothing.
    The kind payload is an executable that any added lines encode, wherever they are; its path is the encoding and the kind.
    """
    lines, scalars, arrays = read
    out = [(-1, None, "declared", s, source_name(s)) for s in [*arrays.get("source", []), *([scalars["source"]] if scalars.get("source") else [])]]
    quoted = recipe.heredoc_bodies(lines)
    run = {*recipe.BUILD_FUNCTIONS, *recipe.HOOKS}
    configs: dict[tuple[str, str], int] = {}
    for x in lines:
        if x.side != "+" or x.resolved is None or x.idx in quoted or x.context == "message":
            continue
        within = next((f for f in [x.function, *x.callers] if f in run), None)
        if within is None:
            continue
        body = recipe.strip_comment(x.resolved)
        done = recipe.actions(body)
        out += [(x.idx, within, kind, path, path.rsplit("/", 1)[-1]) for kind, path in done]
        if any(kind == "fetch" for kind, _ in done) or re.search(r"\b(?:curl|wget2?|aria2c|axel|git\s+clone)\b", body):
            out += [(x.idx, within, "url", u, u.rsplit("/", 1)[-1]) for u in _URL.findall(body)]
        out += [(x.idx, within, "target", t, "Makefile") for t in _targets(body)]
        for words, _, _ in recipe.simple_commands(body):
            own = recipe.bare_words(words)
            used = {recipe.normal_path(v) for w in own[1:] for v in (w, w.rpartition("=")[2])} if own and own[0].rsplit("/", 1)[-1] not in _HANDLERS else set()
            out += [(x.idx, within, "handed", p, p.rsplit("/", 1)[-1]) for (f, p), at in configs.items() if f == within and at < x.idx and (p in used or ("/" in p and p.rpartition("/")[0] in used))]
        if _BUILD_ONLY.search(body) or ("<<" in body and any(_BUILD_ONLY.search(b) for b in _text_below(lines, x, quoted))):
            configs |= {(within, path): x.idx for kind, path in done if kind == "generate"}
        if re.search(r"\b(?:patch|git\s+apply)\b", body):
            out += [(x.idx, within, "patch", p, p.rsplit("/", 1)[-1]) for p in re.findall(r"(?<![^\s<\"'])[^\s<\"']+\.(?:patch|diff)\b", body)]
        if m := re.match(r"\s*(?:export\s+)?PATH=(.*)", body):
            dirs = re.findall(r"\$\{?srcdir\}?/([\w.+-]+)(?![\w.+/-])", m.group(1))
            out += [(x.idx, within, "path_dir", p, p) for p in dirs]
        if re.search(r"\binstall\b|\bcp\b", body):
            for words, _, _ in recipe.simple_commands(body):
                files = [w for w in words[1:] if not w.startswith("-")]
                if len(files) >= 2 and (m := re.search(r"\$\{?pkgdir\}?(/.*)", files[-1])):
                    out.append((x.idx, within, "installed", files[-2], m.group(1)))
    out += [(x.idx, None, "exec_start", m.group(1), m.group(1)) for x in lines if x.side == "+" and (m := re.match(r"\s*ExecStart\w*\s*=\s*[-@+!]*(/[^\s\"']+)", x.body))]
    added = [x for x in lines if x.side == "+"]
    for x in added:
        body = recipe.strip_comment(x.body)
        if found := payload.encoded_payload(body) or (x.resolved and x.resolved != x.body and payload.encoded_payload(recipe.strip_comment(x.resolved))):
            out.append((x.idx, x.function, "payload", found, found))
    if found := payload.uuencoded_payload([x.body for x in added]):
        out.append((added[found[0]].idx, added[found[0]].function, "payload", found[1], found[1]))
    return out


_ARROW = {n: k for n, _, k in _KINDS}


def diff_actions(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per action, see actions_of. NULL and empty diffs have none."""
    schema = T.StructType([docs.schema[id_column], *(T.StructField(n, k) for n, k, _ in _KINDS)])
    return diffs.given(docs, id_column, text_column).mapInArrow(rows_of_texts(_ARROW, lambda text: actions_of(recipe.read(text)), id_column), schema)


def diff_parts(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """diff_lines, diff_facts and diff_actions of one reading of every diff, written once into the shared folder."""
    line, action = ([T.StructField(n, k) for n, k, _ in own] for own in (diffs._LINE, _KINDS))
    kinds = {"kind": pa.string(), "line": pa.struct([(n, k) for n, _, k in diffs._LINE]), "fact": pa.struct(list(diffs.FACT_KINDS.items())), "action": pa.struct(list(_ARROW.items()))}
    schema = T.StructType([docs.schema[id_column], T.StructField("kind", T.StringType()), T.StructField("line", T.StructType(line)), T.StructField("fact", diffs._FACTS), T.StructField("action", T.StructType(action))])
    names = [n for n, _, _ in diffs._LINE]

    def rows(text: str) -> list[tuple]:
        read = recipe.read(text)
        out: list[tuple] = [("fact", None, diffs.facts_of(read), None)]
        out += [("action", None, None, dict(zip(_ARROW, a))) for a in actions_of(read)]
        return out + [("line", dict(zip(names, x)), None, None) for x in diffs.lines_of(read)]

    parts = stage_table(diffs.given(docs, id_column, text_column).mapInArrow(rows_of_texts(kinds, rows, id_column), schema), "parts", ["kind"])
    return tuple(parts.where(F.col("kind") == k).select(id_column, f"{k}.*") for k in ("line", "fact", "action"))


def flow_findings(actions: DataFrame, id_column: str, tree: DataFrame | None = None) -> DataFrame:
    """The first finding of each rule per diff: id, rule_id, severity, category, idx, match.

    tree: id, path; the files that are committed beside the recipe. Rules: R121 generated, then executed; R124 copied, then
    executed; R137 fetched, then executed; R138 a declared source executed; R136 a committed file executed undeclared; W001 (R150 in packaging)
    a file executed that is neither declared, committed nor written; R061 a fetch of an undeclared url; W003 a patch not committed;
    R140 a PATH with a source folder that is neither declared nor committed; R139 a service that starts a file of that kind.
    R120 an encoded executable; W005 a target of a build whose Makefile is not committed; X022 a file that names a build-only path, handed to a tool. R121 before R124 on one execution; executions of what was written are not unread.
    """
    none = actions.where(F.lit(False)).select(id_column, "base").distinct()
    declared = actions.where("kind = 'declared'").select(id_column, "base").distinct().withColumn("declared", F.lit(True))
    committed = (tree.select(id_column, F.substring_index("path", "/", -1).alias("base")).distinct() if tree is not None else none).withColumn("committed", F.lit(True))
    first = actions.where(F.col("kind").isin("generate", "copy", "fetch")).groupBy(id_column, "function", "base").agg(
        *(F.min(F.when(F.col("kind") == k, F.col("idx"))).alias(k) for k in ("generate", "copy", "fetch"))
    )
    runs = actions.where("kind = 'execute'").join(first, [id_column, "function", "base"], "left").join(declared, [id_column, "base"], "left").join(committed, [id_column, "base"], "left")
    before = lambda k: F.coalesce(F.col(k) <= F.col("idx"), F.lit(False))
    known = F.col("declared").isNotNull()
    there = F.col("committed").isNotNull()
    written = before("generate") | before("copy") | before("fetch")
    rules = [
        ("R137", "CRITICAL", "execution", before("fetch") & ~known),
        ("R121", "HIGH", "execution", before("generate") & ~before("fetch") & ~F.col("base").isin(*BENIGN)),
        ("R124", "HIGH", "execution", before("copy") & ~before("generate") & ~before("fetch") & ~known & ~F.col("base").isin(*BENIGN)),
        ("R138", "HIGH", "execution", known & ~F.col("base").isin(*BENIGN)),
        ("R136", "HIGH", "execution", there & ~known & ~written),
        ("R150", "HIGH", "execution", ~there & ~known & ~written & F.col("function").isin(*PACKAGING) & ~F.col("base").isin(*BENIGN)),
        ("W001", "INFO", "unverifiable", ~there & ~known & ~written & ~F.col("function").isin(*PACKAGING) & ~F.col("base").isin(*BENIGN)),
    ]
    hit = F.filter(F.array(*(F.when(c, F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"), F.lit(k).alias("category"))) for i, s, k, c in rules)), lambda h: h.isNotNull())
    found = runs.select(id_column, "idx", F.col("path").alias("match"), F.explode(hit).alias("_h")).select(id_column, "_h.*", "idx", "match")
    sources = actions.where("kind = 'declared'").select(id_column, F.regexp_replace("path", "^.*?::", "").alias("path")).distinct()
    other = actions.where("kind = 'url'").join(sources, [id_column, "path"], "left_anti")
    found = found.unionByName(other.select(id_column, F.lit("R061").alias("rule_id"), F.lit("HIGH").alias("severity"), F.lit("network").alias("category"), "idx", F.col("path").alias("match")))
    patches = actions.where("kind = 'patch'").join(declared, [id_column, "base"], "left_anti").join(committed, [id_column, "base"], "left_anti")
    found = found.unionByName(patches.select(id_column, F.lit("W003").alias("rule_id"), F.lit("INFO").alias("severity"), F.lit("unverifiable").alias("category"), "idx", F.col("path").alias("match")))
    dirs = actions.where("kind = 'path_dir'").join(declared, [id_column, "base"], "left_anti").join(committed, [id_column, "base"], "left_anti")
    found = found.unionByName(dirs.select(id_column, F.lit("R140").alias("rule_id"), F.lit("HIGH").alias("severity"), F.lit("execution").alias("category"), "idx", F.col("path").alias("match")))
    # What a service starts, and the file that the recipe puts there: its own name decides whether it was declared or committed.
    put = actions.where("kind = 'installed'").select(id_column, F.col("base").alias("path"), F.substring_index("path", "/", -1).alias("base"))
    started = actions.where("kind = 'exec_start'").select(id_column, "path", "idx").join(put, [id_column, "path"])
    started = started.join(declared, [id_column, "base"], "left_anti").join(committed, [id_column, "base"], "left_anti")
    found = found.unionByName(started.select(id_column, F.lit("R139").alias("rule_id"), F.lit("HIGH").alias("severity"), F.lit("persistence").alias("category"), "idx", F.col("path").alias("match")))
    goals = actions.where("kind = 'target'").join(committed, [id_column, "base"], "left_anti")
    found = found.unionByName(goals.select(id_column, F.lit("W005").alias("rule_id"), F.lit("INFO").alias("severity"), F.lit("unverifiable").alias("category"), "idx", F.col("path").alias("match")))
    handed = actions.where("kind = 'handed'")
    found = found.unionByName(handed.select(id_column, F.lit("X022").alias("rule_id"), F.lit("HIGH").alias("severity"), F.lit("evasion").alias("category"), "idx", F.col("path").alias("match")))
    encoded = actions.where("kind = 'payload'")
    found = found.unionByName(encoded.select(id_column, F.lit("R120").alias("rule_id"), F.lit("HIGH").alias("severity"), F.lit("execution").alias("category"), "idx", F.col("path").alias("match")))
    best = found.groupBy(id_column, "rule_id").agg(F.min(F.struct("idx", "severity", "category", "match")).alias("_m"))
    return best.select(id_column, "rule_id", "_m.severity", "_m.category", "_m.idx", "_m.match")
