"""Findings over the files that are committed beside a recipe. tree: id, path, head (the first bytes, BINARY) and, if there, content (the whole, NULL for what is neither carrier nor archive)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.payload import archive_trailer, magic_of

#: Committed files that are read by something that can run what they name.
CARRIERS = ("service", "socket", "timer", "path", "desktop", "rules", "conf", "install", "hook", "patch", "diff")
_PIPED = r"(?i)\b(?:curl|wget)\b[^\n]*\|\s*(?:sudo\s+)?(?:ba|z|da)?sh\b|\b(?:ba)?sh\s+-c\s[^\n]*\b(?:curl|wget)\b"
_BUILD_ONLY = r"\$\{?(?:srcdir|startdir|pkgdir|BUILDDIR|PWD)\b"


def is_carrier(path: Column) -> Column:
    return path.rlike(r"\.(?:" + "|".join(CARRIERS) + ")$")


def _name(c: str) -> Column:
    return F.substring_index(c, "/", -1)


def _text(head: Column) -> Column:
    """The head as text; for a patch only what it adds."""
    t = F.decode(head, "ISO-8859-1")
    added = F.array_join(F.filter(F.split(t, "\n"), lambda x: x.startswith("+")), "\n")
    return F.when(F.col("path").rlike(r"\.(?:patch|diff)$"), added).otherwise(t)


def tree_findings(tree: DataFrame, id_column: str, declared: DataFrame | None = None) -> DataFrame:
    """The first finding of each rule per tree: id, rule_id, severity, category, path.

    declared: id, base; file names of the recipe's sources. R118 an executable that isn't declared, tests and fixtures aside; R122 an archive with bytes
    behind its end (of those whose whole content is there); R146 a carrier that pipes a fetch into a shell; R149 a carrier
    directive that runs something from a build-only path. NULL heads have no findings.
    """
    whole = F.coalesce("content", "head") if "content" in tree.columns else F.col("head")
    files = tree.select(F.col(id_column), "path", "head", whole.alias("_all"), _name("path").alias("base"))
    known = declared.select(id_column, "base").distinct().withColumn("_d", F.lit(True)) if declared is not None else files.where(F.lit(False)).select(id_column, "base").withColumn("_d", F.lit(True))
    rows = files.join(known, [id_column, "base"], "left")
    carrier = is_carrier(F.col("path"))
    text = _text(F.col("_all"))
    runs = F.exists(F.split(text, "\n"), lambda x: x.rlike(r"^\+?\s*(?:Exec\w*|RUN|PROGRAM|TryExec|run|exec)\b.*" + _BUILD_ONLY) & ~x.rlike(r"^\+?\s*(?:Name|Comment|Description|#)"))
    aside = F.col("path").rlike(r"(?i)(?:^|/)(?:tests?|testdata|fixtures?|specs?|examples?)/|(?:^|/)(?:test|fixture|sample|mock)[^/]*$")
    rules = [
        ("R118", "HIGH", "integrity", (magic_of(F.col("head")) == "elf") & F.col("_d").isNull() & ~aside),
        ("R122", "HIGH", "integrity", F.col("_trailer") > 0),
        ("R146", "CRITICAL", "execution", carrier & text.rlike(_PIPED)),
        ("R149", "HIGH", "persistence", carrier & runs & ~text.rlike(_PIPED)),
    ]
    hits = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"), F.lit(k).alias("category"))) for i, s, k, c in rules)), lambda h: h.isNotNull())
    found = rows.withColumn("_trailer", archive_trailer("_all")).select(id_column, "path", F.explode(hits).alias("_h"))
    best = found.groupBy(id_column, "_h.rule_id").agg(F.min(F.struct("path", "_h.severity", "_h.category")).alias("_m"))
    return best.select(id_column, "rule_id", "_m.severity", "_m.category", "_m.path")
