"""Dependencies against what is known: novelty, rarity, divergence of names, hosts and metadata."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import names
from auditloom.operators.rules import structural
from auditloom.sources.work import stage_table


def novel(added: DataFrame, known: DataFrame) -> DataFrame:
    """Added names (subject, name) that no observation (name) knows; nothing is novel while nothing is known."""
    seen = known.select("name").distinct()
    fresh = added.join(seen, "name", "left_anti")
    return fresh if seen.limit(1).count() else fresh.limit(0)


def expansion(added: DataFrame, observed: DataFrame, least: int = 3, gate: float = 1.5) -> DataFrame:
    """Subjects that add at least `least` names whose number times mean rarity, 1/(1+observations), reaches the gate: subject, n_added, magnitude."""
    rated = added.distinct().join(observed, "name", "left").withColumn("rarity", 1 / (1 + F.coalesce("n", F.lit(0))))
    sums = rated.groupBy("subject").agg(F.count(F.lit(1)).alias("n_added"), F.avg("rarity").alias("r"))
    return sums.select("subject", "n_added", F.round(F.col("n_added") * F.col("r"), 6).alias("magnitude")).where((F.col("n_added") >= least) & (F.col("magnitude") >= gate))


def shares_no_token(name: Column, url: Column) -> Column:
    """Do a package's name and the path it is built from have no word of three letters or more in common, either within the other."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    path = words(F.regexp_replace(F.regexp_replace(url, r"^[^:]*://[^/]*/?", ""), r"\.(?:git|tar|tgz|zip|gz|xz|zst|bz2)\b", ""))
    own = words(F.regexp_replace(name, "-(?:git|bin|svn|hg|nightly|dkms|utils|data|cli)$", ""))
    return (F.size(own) > 0) & (F.size(path) > 0) & ~F.exists(own, lambda a: F.exists(path, lambda b: b.contains(a) | a.contains(b)))


def outside_hosts(hosts: DataFrame, canonical: DataFrame) -> DataFrame:
    """Packages with an ecosystem's prefix none of whose hosts (name, host) is canonical for it (prefix, domain), nor a subdomain of one: name, prefix."""
    rows = hosts.withColumn("prefix", F.regexp_extract("name", "^([a-z]+)-", 1)).join(canonical.select("prefix").distinct(), "prefix", "left_semi")
    parents = rows.select("name", "prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.array_join(F.slice(F.split("host", r"\."), i, F.lit(127)), "."))).alias("domain"))
    good = parents.join(canonical, ["prefix", "domain"], "left_semi").select("name", "prefix").distinct()
    return rows.select("name", "prefix").distinct().join(good, ["name", "prefix"], "left_anti")


def undeclared_hosts(metadata: DataFrame, recipe: DataFrame, subject: str) -> DataFrame:
    """Hosts that the generated metadata names and the recipe doesn't: subject, host."""
    return metadata.select(subject, "host").distinct().join(recipe.select(subject, "host").distinct(), [subject, "host"], "left_anti")


#: Names of more characters than this are compared by their pieces, which are long then; shorter ones by what deletions leave of them, n(n+1)/2+1 texts each.
_SHORT = 24


def _without(name: str, most: Column) -> Column:
    """Hashes of what is left of a name without up to `most` (1 or 2) of its characters, each once."""
    one = f"transform(sequence(1, length({name})), i -> xxhash64(concat(substring({name}, 1, i - 1), substring({name}, i + 1))))"
    two = (
        f"flatten(transform(sequence(1, length({name}) - 1), i -> transform(sequence(i + 1, length({name})), "
        f"j -> xxhash64(concat(substring({name}, 1, i - 1), substring({name}, i + 1, j - i - 1), substring({name}, j + 1))))))"
    )
    less = F.concat(F.array(F.xxhash64(name)), F.expr(one))
    return F.array_distinct(F.when((most < 2) | (F.length(name) < 2), less).otherwise(F.concat(less, F.expr(two))))


def candidates(given: DataFrame, popular: DataFrame, ratio: int) -> DataFrame:
    """name, k, target, target_n: pairs that may be k edits apart, each once; all that are, and few that aren't.

    k edits, a swap being one, leave two names with a text in common that lacks at most k characters of either: short names meet by such texts.
    Of a longer name cut into 2k+1 pieces, k edits leave one as it is, moved by k places at most (a swap may spoil two): those meet by (length, place, piece).
    """
    rows = given.where(F.length("name") >= 4).select("name", "n", names.stem(F.col("name")).alias("stem"), F.when(F.length("name") < 8, 1).otherwise(2).alias("k"))
    targets = popular.select(F.col("name").alias("target"), F.col("n").alias("target_n"), F.length("name").alias("len"), names.stem(F.col("name")).alias("target_stem"))
    differ = (F.col("target_n") >= ratio * F.col("n")) & (F.col("target_stem") != F.col("stem"))
    # By the size of their files these sides are small enough to be broadcast; they hold hundreds of rows a name.
    left = rows.where(F.length("name") <= _SHORT).withColumn("rest", F.explode(_without("name", F.col("k"))))
    # A target of up to 5 characters is compared with names of one edit only.
    right = targets.where((F.col("len") >= 3) & (F.col("len") <= _SHORT + 2)).withColumn("rest", F.explode(_without("target", F.when(F.col("len") < 6, 1).otherwise(2))))
    close = left.join(right.hint("merge"), "rest").where(differ & (F.col("name") != F.col("target")) & (F.abs(F.length("name") - F.col("len")) <= F.col("k"))).select("name", "k", "target", "target_n")
    rows = rows.where(F.length("name") > _SHORT)
    rows = rows.withColumn("parts", 2 * F.col("k") + 1)
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i")).withColumn("at", F.expr("cast(floor(length(name) * i / parts) as int)"))
    pieces = pieces.withColumn("piece", F.expr("substring(name, at + 1, cast(floor(length(name) * (i + 1) / parts) as int) - at)")).withColumn("size", F.length("piece")).where("size > 0")
    wide = pieces.select("name", "n", "k", "stem", "piece", F.explode(F.expr("sequence(greatest(0, at - k), at + k)")).alias("at"), F.expr("sequence(length(name) - k, length(name) + k)").alias("lens"))
    wide = wide.withColumn("len", F.explode("lens")).drop("lens")
    # Which pieces of which targets can be asked for: depends on lengths only, so it is a small table.
    asked = pieces.select(F.length("name").alias("own"), "k", "size", "at").distinct()
    asked = asked.select("size", F.explode(F.expr("sequence(greatest(0, at - k), at + k)")).alias("at"), F.expr("sequence(own - k, own + k)").alias("lens")).withColumn("len", F.explode("lens")).drop("lens").distinct()
    targets = targets.join(asked, "len").withColumn("piece", F.expr("substring(target, at + 1, size)")).drop("size")
    pairs = wide.join(targets.hint("merge"), ["len", "at", "piece"]).where(differ).select("name", "k", "target", "target_n")
    return close.unionByName(pairs).distinct()


def near_names(given: DataFrame, popular: DataFrame, ratio: int) -> DataFrame:
    """Names one (below 8 characters) or two edits from a popular name, a swap of neighbours being one: name, target, distance.

    given and popular: name, n. A target is seen at least `ratio` times as often as the name and is no variant of it (-git, -bin and so on); names of
    fewer than four characters have none. The nearest target comes out, then the most popular, then the first by name.
    Candidates come of equi-joins (`candidates`), not of a comparison of all pairs. What they read several times is written first: it is evaluated once,
    and planned once.
    """
    same = popular is given
    given = stage_table(given, "given")
    popular = given if same else stage_table(popular, "popular")
    pairs = candidates(given, popular, ratio).withColumn("distance", names.osa_distance("name", "target", "k")).where("distance <= k AND distance > 0")
    best = pairs.groupBy("name").agg(F.min(F.struct("distance", (-F.col("target_n")).alias("r"), "target")).alias("_b"))
    return best.select("name", F.col("_b.target").alias("target"), F.col("_b.distance").alias("distance"))


def hijacks(provided: DataFrame, established: DataFrame) -> DataFrame:
    """Newly provided or replaced names (subject, name) that are established packages unrelated to the subject: subject, name."""
    hit = provided.join(established.select("name").distinct(), "name", "left_semi")
    related = lambda a, b: a.contains(b) | b.contains(a)
    return hit.where(~related(names.stem(F.col("subject")), names.stem(F.col("name")))).select("subject", "name").distinct()


def scope_expansion(provided: DataFrame, established: DataFrame, observed: DataFrame, widely: int = 25) -> DataFrame:
    """The first newly provided or replaced name (subject, name) of each subject that is an unrelated established package (HIGH) or observed (name, n) widely (MEDIUM): subject, severity, name."""
    high = hijacks(provided, established).select("subject", F.lit("HIGH").alias("severity"), "name")
    medium = provided.select("subject", "name").distinct().join(observed.where(F.col("n") >= widely).select("name").distinct(), "name", "left_semi").select("subject", F.lit("MEDIUM").alias("severity"), "name")
    best = high.unionByName(medium).groupBy("subject").agg(F.min(F.struct("severity", "name")).alias("_m"))
    return best.select("subject", "_m.severity", "_m.name")


def adoption_findings(states: DataFrame, facts: DataFrame, id_column: str) -> DataFrame:
    """id, rule_id, severity, category: R141 a package that was orphaned and has a maintainer, R143 one whose recipe is then rewritten (R142) with unpinned build dependencies.

    states: id, was_orphaned (1, 0, -1 unknown), maintainer. facts: as diff_facts gives them; a package without a diff can have R141.
    """
    adopted = states.where((F.col("was_orphaned") == 1) & (F.coalesce(F.trim("maintainer"), F.lit("")) != "")).select(id_column).distinct()
    risky = structural(facts, id_column).where("rule_id = 'R142'").select(id_column).join(facts.where(F.size("registry_installs") > 0).select(id_column), id_column, "left_semi")
    named = lambda df, i, s: df.select(id_column, F.lit(i).alias("rule_id"), F.lit(s).alias("severity"), F.lit("takeover").alias("category"))
    return named(adopted, "R141", "MEDIUM").unionByName(named(adopted.join(risky, id_column, "left_semi").distinct(), "R143", "HIGH"))


#: Severity and category of the rules over a registry.
REGISTRY_RULES = {
    "D001": ("MEDIUM", "dependency"), "D002": ("HIGH", "dependency"), "D004": ("HIGH", "dependency"), "R065": ("INFO", "temporal"), "R066": ("INFO", "temporal"), "R067": ("MEDIUM", "temporal"), "R073": ("INFO", "temporal"), "R074": ("HIGH", "naming"),
    "R075": ("MEDIUM", "dependency"), "R093": ("MEDIUM", "graph"), "R100": ("HIGH", "corpus"), "R101": ("MEDIUM", "naming"), "R106": ("FATAL", "indicator"), "R107": ("INFO", "graph"), "R110": ("MEDIUM", "naming"), "R111": ("INFO", "graph"), "R112": ("INFO", "graph"),
    "R116": ("HIGH", "dependency"), "R148": ("HIGH", "integrity"),
}


def as_findings(subjects: DataFrame, subject: str, rule_id: str) -> DataFrame:
    """The subjects that a detector found, as findings: subject (text), rule_id, severity, category; one per subject."""
    severity, category = REGISTRY_RULES[rule_id]
    return subjects.where(F.col(subject).isNotNull()).select(F.col(subject).cast("string").alias("subject"), F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(category).alias("category")).distinct()
