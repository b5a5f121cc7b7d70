"""Reading shell recipes and their diffs: lines, scopes, variables, expansions. Plain Python, run once per diff in Arrow batches."""

import re
from dataclasses import dataclass, field

#: Limits: characters from which a line counts as oversized (it is read whole all the same), passes of expansion, and the characters by which the
#: variables of a diff may make its lines longer. Values that double from one to the next have no end: what would grow beyond it stays as written, a gap.
LINE_CHARS, PASSES, GROWTH_CHARS = 8192, 16, 1 << 22
#: Functions that a package manager calls, by when.
BUILD_FUNCTIONS = ("prepare", "build", "check", "package", "pkgver")
HOOKS = ("pre_install", "post_install", "pre_upgrade", "post_upgrade", "pre_remove", "post_remove")

_FUNCTION = re.compile(r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{?|^\s*function\s+([A-Za-z_][\w-]*)\s*\{")
_ASSIGN = re.compile(r"^\s*(?:local\s+|export\s+|readonly\s+)?([A-Za-z_]\w*)(\+?)=(.*)$", re.S)
_MESSAGE = re.compile(r"^\s*(?:echo|printf|note|msg2?|warning|error)\b(?![^#]*[|>`])")
_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@")
_WORD = re.compile(r"""(?:[^\s"'\\]|\\.|"(?:[^"\\]|\\.)*"|'[^']*')+""", re.S)
_CALL = re.compile(r"(?:^|[;&|({]|\b(?:then|do|else)\b)\s*([A-Za-z_][\w-]*)\b")
_INNER = re.compile(r"\$\{([^{}]*)\}|\$([A-Za-z_]\w*)")
_NAME = re.compile(r"^([A-Za-z_]\w*)(?:\[([^\]]*)\])?(.*)$", re.S)
_ANSI = re.compile(r"\$'((?:\\.|[^'\\])*)'")


def split_lines(text: str) -> list[str]:
    """Lines end at \\n only; \\r\\n counts as \\n; one empty line at the end is no line.

    >>> split_lines("a\\r\\nb\\n"), split_lines("")
    (['a', 'b'], [])
    """
    lines = text.replace("\r\n", "\n").split("\n")
    return lines[:-1] if lines[-1] == "" else lines


@dataclass
class Line:
    idx: int
    side: str  # '+', '-', ' ' or '@' for headers
    body: str
    file: str | None = None
    lineno: int | None = None
    function: str | None = None
    callers: list[str] = field(default_factory=list)
    context: str = "other"
    resolved: str | None = None
    whole: bool = True
    overgrown: bool = False  # not expanded in full, see GROWTH_CHARS
    pipe_from: str | None = None
    pipe_to: str | None = None
    marks: list[str] = field(default_factory=list)  # see commands.py


def diff_lines(text: str) -> list[Line]:
    """The lines of a unified diff with file and number on the new side; text without any header is all context."""
    out: list[Line] = []
    file, at = None, None
    raw = split_lines(text)
    headed = any(_HUNK.match(x) or x.startswith("+++ ") for x in raw)
    for i, x in enumerate(raw):
        if x.startswith("+++ "):
            file, at = re.sub(r"^[ab]/", "", x[4:].split("\t")[0].strip()), None
            out.append(Line(i, "@", x, file))
        elif x.startswith("--- ") or x.startswith("diff "):
            out.append(Line(i, "@", x, None))
        elif m := _HUNK.match(x):
            at = int(m.group(1))
            out.append(Line(i, "@", x, file))
        elif headed and at is not None and x[:1] in ("+", "-", " "):
            out.append(Line(i, x[0], x[1:], file, None if x[0] == "-" else at))
            at += x[0] != "-"
        else:
            out.append(Line(i, " ", x, file, at))
            at = at + 1 if at is not None else None
    return out


def strip_comment(line: str) -> str:
    """Without what follows the first unquoted # that starts a word.

    >>> strip_comment("make # all"), strip_comment("echo '#1' a#b")
    ('make ', "echo '#1' a#b")
    """
    if "#" not in line:
        return line
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and (quote == "'" or line[i - 1] != "\\") else quote
        elif c in "'\"" and (i == 0 or line[i - 1] != "\\"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t;&|("):
            return line[:i]
    return line


def joined(lines: list[Line]) -> list[tuple[Line, str]]:
    """Logical lines: those that end in an odd number of backslashes continue on the next one of the same side and file."""
    out: list[tuple[Line, str]] = []
    first, text = None, ""
    for x in lines:
        if first is not None and (x.side != first.side or x.file != first.file):
            out.append((first, text))
            first, text = None, ""
        body = x.body
        tail = len(body) - len(body.rstrip("\\"))
        first = first or x
        if tail % 2 and x.side != "@":
            text += body[:-1] + " "
            continue
        out.append((first, text + body))
        first, text = None, ""
    if first is not None:
        out.append((first, text))
    return out


def scope(lines: list[Line]) -> None:
    """Set function, context and callers of every line, by brace depth; a new file starts afresh. Removed lines don't count."""
    stack: list[tuple[str, int]] = []
    depth, file = 0, None
    calls: dict[str, set[str]] = {}
    for x in lines:
        if x.file != file or x.side == "@":
            if x.file != file:
                stack, depth = [], 0
            file = x.file
            if x.side == "@":
                continue
        if x.side == "-":
            x.function = stack[-1][0] if stack else None
            x.context = "function_body" if stack else "other"
            continue
        body = strip_comment(x.body)
        m = _FUNCTION.match(body)
        if m:
            stack.append((m.group(1) or m.group(2), depth))
        x.function = stack[-1][0] if stack else None
        x.context = "message" if _MESSAGE.match(body) else "function_body" if stack and not m else "other"
        if stack and not m:
            calls.setdefault(stack[-1][0], set()).update(_CALL.findall(body))
        depth = max(0, depth + body.count("{") - body.count("${") - body.count("}") + len(re.findall(r"\$\{[^{}]*\}", body)))
        opened = m is not None and "{" not in body
        while stack and depth <= stack[-1][1] and not opened and (not m or "}" in body):
            stack.pop()
    known = set(calls) | {x.function for x in lines if x.function}
    callers: dict[str, set[str]] = {f: {g for g in calls if f in calls[g] and g != f} for f in known}
    for _ in known:
        grown = {f: own | set().union(*(callers.get(g, set()) for g in own)) if own else own for f, own in callers.items()}
        if grown == callers:
            break
        callers = grown
    for x in lines:
        if x.function:
            x.callers = sorted(callers.get(x.function, set()) - {x.function})


def unquote(word: str) -> str:
    """A word as the shell would pass it on, expansions aside.

    >>> unquote('a"b c"\\'d\\'')
    'ab cd'
    """
    out, quote, i = [], "", 0
    while i < len(word):
        c = word[i]
        if c == "\\" and quote != "'" and i + 1 < len(word):
            if quote == '"' and word[i + 1] not in '$`"\\':
                out.append(c)
            out.append(word[i + 1])
            i += 2
            continue
        if quote:
            quote = "" if c == quote else quote
            if quote:
                out.append(c)
        elif c in "'\"":
            quote = c
        else:
            out.append(c)
        i += 1
    return "".join(out)


def decode_ansi(text: str) -> str:
    """$'..' quotes as the characters they spell.

    >>> decode_ansi("$'\\\\x62\\\\165n' add")
    'bun add'
    """

    def one(m: re.Match) -> str:
        plain = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v"}
        return re.sub(
            r"\\(?:x([0-9A-Fa-f]{1,2})|([0-7]{1,3})|u([0-9A-Fa-f]{1,4})|(.))",
            lambda e: chr(int(e[1], 16)) if e[1] else chr(int(e[2], 8) & 255) if e[2] else chr(int(e[3], 16)) if e[3] else plain.get(e[4], e[4]),
            m.group(1),
            flags=re.S,
        )

    return _ANSI.sub(one, text)


def glob_pattern(glob: str, greedy: bool) -> str:
    """A shell pattern as a regular expression."""
    out, i, many = [], 0, ".*" if greedy else ".*?"
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if close > 0:
            inner = glob[i + 1 : close]
            out.append("[" + ("^" + re.escape(inner[1:]).replace(r"\-", "-") if inner[0] in "!^" else re.escape(inner).replace(r"\-", "-")) + "]")
            i = close
        else:
            out.append(many if c == "*" else "." if c == "?" else re.escape(c))
        i += 1
    return "".join(out)


def _operate(value: str, op: str) -> str | None:
    if op.startswith(("##", "#")):
        glob = op.lstrip("#")
        m = re.match(glob_pattern(glob, op.startswith("##")), value, re.S)
        return value[m.end() :] if m else value
    if op.startswith("%"):
        glob, longest = op.lstrip("%"), op.startswith("%%")
        # A * in front takes the whole value or, for the shortest end, nothing; to try it everywhere would cost the square of a long value.
        starts = range(1 if glob.startswith("*") else len(value) + 1) if longest else range(len(value), -1, -1)
        pattern = re.compile(glob_pattern(glob if longest else glob.lstrip("*"), True) + r"\Z", re.S)
        return next((value[:i] for i in starts if pattern.match(value, i)), value)
    if op.startswith("/"):
        every, body = op.startswith("//"), op.lstrip("/") if not op.startswith("//") else op[2:]
        old, _, new = body.partition("/")
        return re.sub(glob_pattern(old, True), lambda _: new, value, count=0 if every else 1, flags=re.S) if old else value
    if op in ("^^", ",,"):
        return value.upper() if op == "^^" else value.lower()
    if op in ("^", ","):
        return (value[:1].upper() if op == "^" else value[:1].lower()) + value[1:]
    if m := re.match(r"^:\s*(-?\d+)(?::\s*(-?\d+))?$", op):
        start = int(m[1]) if not m[1].startswith("-") or op.startswith(": ") else None
        if start is None:
            return None
        rest = value[start:] if start >= 0 else value[max(0, len(value) + start) :]
        return rest if m[2] is None else rest[: int(m[2])]
    return None


class Overgrown(Exception):
    """Expansion would make a text longer than there is room for."""


def expand(text: str, table: dict[str, str], arrays: dict[str, list[str]], room: int = GROWTH_CHARS) -> tuple[str, bool]:
    """The text with its variables put in, and whether all could be. Indirect and length forms are left alone. Overgrown if that adds more than `room`.

    >>> expand("${n%-git}/$v ${u:-none} ${!x}", {"n": "abc-git", "v": "1"}, {})
    ('abc/1 none ${!x}', False)
    """
    whole, most, size = True, len(text) + room, 0

    def put(m: re.Match) -> str:
        nonlocal size
        own = one(m)
        size += len(own) - len(m.group())
        if size > most:
            raise Overgrown
        return own

    def one(m: re.Match) -> str:
        nonlocal whole
        inner = m.group(1) if m.group(1) is not None else m.group(2)
        parts = _NAME.match(inner)
        if not parts:
            whole = False
            return m.group().replace("$", "\0", 1)
        name, index, op = parts.groups()
        if index is not None:
            own = arrays.get(name)
            value = None if own is None else " ".join(own) if index in ("@", "*") else own[int(index)] if index.isdigit() and int(index) < len(own) else ""
        else:
            value = table.get(name, arrays[name][0] if arrays.get(name) else None)
        if op[:2] in (":-", ":="):
            return value if value else op[2:]
        if op[:1] in ("-", "=") and op:
            return value if value is not None else op[1:]
        if op[:2] == ":+" or op[:1] == "+":
            return op.lstrip(":")[1:] if value else ""
        done = None if value is None else _operate(value, op) if op else value
        if done is None:
            whole = False
            return m.group().replace("$", "\0", 1)
        return done

    for _ in range(PASSES):
        size = len(text)
        fresh = _INNER.sub(put, text)
        if fresh == text:
            break
        text = fresh
    return text.replace("\0", "$"), whole


class Room:
    """What is left of GROWTH_CHARS over several texts; a text that would take more stays as it is and takes all, but each text may grow by LINE_CHARS."""

    def __init__(self) -> None:
        self.left = GROWTH_CHARS

    def expand(self, text: str, table: dict[str, str], arrays: dict[str, list[str]]) -> tuple[str, bool, bool]:
        """As expand(), and whether the text had to stay."""
        try:
            out, whole = expand(text, table, arrays, max(self.left, LINE_CHARS))
        except Overgrown:
            self.left = 0
            return text, False, True
        self.left -= max(0, len(out) - len(text))
        return out, whole, False


def assignments(logical: list[tuple[Line, str]]) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Scalars and arrays as they stand after the diff: lines of the new side, in order, `+=` appending; a few passes settle forward uses."""
    scalars: dict[str, str] = {}
    arrays: dict[str, list[str]] = {}
    opened: tuple[str, list[str]] | None = None
    for x, text in logical:
        if x.side not in ("+", " "):
            continue
        text = strip_comment(text)
        if opened:
            head, closed, _ = text.partition(")")
            opened[1].extend(unquote(w) for w in _WORD.findall(head))
            if closed:
                opened = None
            continue
        m = _ASSIGN.match(text)
        if not m:
            continue
        name, plus, value = m.groups()
        value = value.strip()
        if value.startswith("("):
            items = arrays[name] = (arrays.get(name, []) if plus else [])
            head, closed, _ = value[1:].partition(")") if not re.search(r"['\"]", value) else (value[1:].rstrip().rstrip(")"), ")" if value.rstrip().endswith(")") else "", "")
            items.extend(unquote(w) for w in _WORD.findall(head))
            opened = None if closed else (name, items)
        elif not re.search(r"\$\(|`", value):
            word = _WORD.match(value)
            plain = unquote(decode_ansi(word.group() if word else ""))
            scalars[name] = (scalars.get(name, "") if plus else "") + plain
    for _ in range(10):
        room = Room()
        settled = {k: room.expand(v, {n: w for n, w in scalars.items() if n != k} if "$" in v else {}, arrays)[0] for k, v in scalars.items()}
        if settled == scalars:
            break
        scalars = settled
    room = Room()
    return scalars, {k: [room.expand(w, scalars, {})[0] for w in own] for k, own in arrays.items()}


def aliases(logical: list[tuple[Line, str]]) -> dict[str, str]:
    """The aliases that a diff's new side sets."""
    own: dict[str, str] = {}
    for x, text in logical:
        if x.side in ("+", " ") and "alias" in text:
            for words, _, _ in simple_commands(strip_comment(text)):
                if words[:1] == ["alias"]:
                    own |= {n: v for n, given, v in (w.partition("=") for w in words[1:]) if given and re.fullmatch(r"[\w.+-]+", n)}
    return own


def expand_aliases(text: str, known: dict[str, str]) -> str:
    """The text with aliases put in where a command stands, each at most once in its own expansion.

    >>> expand_aliases("get x | run; echo get", {"get": "curl -s", "run": "get y", "echo": "echo"})
    'curl -s x | curl -s y; echo get'
    """
    for _ in range(len(known)):
        out, at, fresh = [], 0, True
        for m in _TOKEN.finditer(text):
            word = m.group(1)
            if word in _SEPARATORS:
                fresh = True
            elif fresh:
                if word in known and not known[word].startswith(word):
                    out += [text[at : m.start(1)], known[word]]
                    at = m.end(1)
                fresh = False
        if not out:
            break
        text = "".join([*out, text[at:]])
        if len(text) > GROWTH_CHARS:
            break
    return text


def collapse(path: str) -> str:
    """`a/b/../c` as `a/c`."""
    while True:
        fresh = re.sub(r"(?<![^/\s\"'=])(?!\.\.?/)[^/\s\"'=$]+/\.\./", "", path)
        if fresh == path:
            return path
        path = fresh


def read(text: str) -> tuple[list[Line], dict[str, str], dict[str, list[str]]]:
    """A diff read whole: its lines with scope and resolved text, and the variables after it."""
    lines = diff_lines(text.removeprefix("\ufeff"))
    scope(lines)
    logical = joined(lines)
    scalars, arrays = assignments(logical)
    room, called = Room(), aliases(logical)
    for x, own in logical:
        if x.side in ("+", " ", "-"):
            own = expand_aliases(own, called) if called else own
            x.resolved, x.whole, x.overgrown = room.expand(decode_ansi(own), scalars, arrays)
            x.resolved = collapse(re.sub(r"(?<=\w)(?:''|\"\")(?=\w)", "", x.resolved))
            if "|" in x.resolved and (ends := pipeline_ends(strip_comment(x.resolved))):
                x.pipe_from, x.pipe_to = ends
    return lines, scalars, arrays


# ---- commands and what they do to files ------------------------------------------------------------------------------

_TOKEN = re.compile(r"""\s*(\d?>>?&?|<<<|<<-?|<|\|\||&&|[|;&()]|(?:[^\s"'\\<>|;&()]|\\.|"(?:[^"\\]|\\.)*"|'[^']*')+)""", re.S)
_SEPARATORS = {"|", "||", "&&", ";", "&", "(", ")"}
_HEREDOC = re.compile(r"<<(-?)\s*(['\"]?)(\w+)\2")
#: Programs by what they do with a file argument.
INTERPRETERS = frozenset({"sh", "bash", "zsh", "dash", "ksh", "python", "python2", "python3", "perl", "ruby", "node", "lua", "php", "source", "."})
COMPILERS = frozenset({"cc", "gcc", "g++", "c++", "clang", "clang++", "rustc", "go"})
COPIERS = frozenset({"cp", "mv", "install", "ln", "rsync"})
FETCHERS = frozenset({"curl", "wget", "wget2", "aria2c", "axel"})
PREFIXES = frozenset({"sudo", "env", "exec", "command", "nice", "nohup", "time", "then", "do", "else", "if", "while", "!"})


def simple_commands(text: str) -> list[tuple[list[str], list[tuple[str, str]], str]]:
    """The simple commands of a line: their words unquoted, their redirections (sign, file), and the separator before each.

    >>> simple_commands('curl -o "a b" u && sh "a b" > /dev/null')
    [(['curl', '-o', 'a b', 'u'], [], ''), (['sh', 'a b'], [('>', '/dev/null')], '&&')]
    """
    out: list[tuple[list[str], list[tuple[str, str]], str]] = []
    words: list[str] = []
    redirects: list[tuple[str, str]] = []
    before, pending = "", ""
    for m in _TOKEN.finditer(text):
        t = m.group(1)
        if t in _SEPARATORS:
            if words or redirects:
                out.append((words, redirects, before))
            words, redirects, before, pending = [], [], t, ""
        elif re.fullmatch(r"\d?>>?&?|<<<|<<-?|<", t):
            pending = t
        elif pending:
            redirects.append((pending.lstrip("012"), unquote(t)))
            pending = ""
        else:
            words.append(unquote(t))
    if words or redirects:
        out.append((words, redirects, before))
    return out


def bare_words(words: list[str]) -> list[str]:
    """Without assignments and prefixes in front."""
    i = 0
    while i < len(words) and (words[i] in PREFIXES or re.match(r"^[A-Za-z_]\w*=", words[i])):
        i += 1
    return words[i:]


def _option(words: list[str], *names: str) -> str | None:
    for i, w in enumerate(words):
        for n in names:
            if w == n and i + 1 < len(words):
                return words[i + 1]
            if n.startswith("--") and w.startswith(n + "="):
                return w[len(n) + 1 :]
    return None


def normal_path(path: str) -> str:
    return re.sub(r"^(?:\./)+", "", collapse(re.sub(r"/{2,}", "/", path.strip())))


def outputs(own: list[str], redirects: list[tuple[str, str]]) -> list[str]:
    """Where a fetching command puts what it fetches."""
    name = own[0].rsplit("/", 1)[-1]
    target = next((w[2:] for w in own[1:] if re.match(r"^-[oO]\S", w) and name != "curl" or re.match(r"^-o\S", w)), None) or _option(own, "-o", "--output", "--output-document", "-O")
    target = target or next((own[i + 1] for i, w in enumerate(own[:-1]) if re.match(r"^-[a-zA-Z]*[oO]$", w)), None)
    written = [p for sign, p in redirects if sign.startswith(">") and not p.startswith(("/dev/", "&"))]
    urls = [w for w in own[1:] if not w.startswith("-") and "://" in w]
    if target and "://" not in target and target != "-":
        return [target]
    if written:
        return written
    if urls and (name != "curl" or any(re.match(r"^-\w*O$|^--remote-name$", w) for w in own)):
        return [re.sub(r"[?#].*$", "", urls[0]).rsplit("/", 1)[-1]]
    return []


def actions(text: str) -> list[tuple[str, str]]:
    """What a line does to files, in order: (generate | copy | fetch | execute, path).

    >>> actions("curl -sSo x.sh https://u && chmod +x x.sh && ./x.sh"), actions("echo a | tee b > /dev/null; cp b c; python3 -u c")
    ([('fetch', 'x.sh'), ('execute', 'x.sh')], [('generate', 'b'), ('copy', 'c'), ('execute', 'c')])
    """
    out: list[tuple[str, str]] = []
    for words, redirects, _ in simple_commands(text):
        own = bare_words(words)
        files = [w for w in own[1:] if not w.startswith("-")]
        name = own[0].rsplit("/", 1)[-1] if own else ""
        written = [p for sign, p in redirects if sign.startswith(">") and not p.startswith(("/dev/", "&"))]
        if name in FETCHERS:
            out += [("fetch", p) for p in outputs(own, redirects)]
            continue
        if name == "git" and "clone" in own and files:
            rest = files[files.index("clone") + 1 :]
            if rest:
                out.append(("fetch", rest[1] if len(rest) > 1 else re.sub(r"\.git$", "", rest[0].rstrip("/").rsplit("/", 1)[-1])))
            continue
        if name == "tee":
            out += [("generate", p) for p in files]
        elif name in COPIERS and len(files) > 1 and not any(w.startswith("-") and "d" in w and name == "install" and "D" not in w for w in own[1:] if not w.startswith("--")):
            out.append(("copy", _option(own, "-t", "--target-directory") or files[-1]))
        elif name in INTERPRETERS and files and not any(w in ("-c", "-e") for w in own):
            out.append(("execute", files[0]))
        elif name in COMPILERS:
            out += [("execute", p) for p in files if re.search(r"\.(?:c|cc|cpp|cxx|rs|go|s)$", p)]
        elif name in ("make", "gmake", "ninja"):
            if given := _option(own, "-f", "--file", "--makefile"):
                out.append(("execute", given))
        elif own and "/" in own[0] and "://" not in own[0] and not own[0].startswith("/usr/bin/"):
            out.append(("execute", own[0]))
        out += [("generate", p) for p in written]
    return [(kind, normal_path(p)) for kind, p in out if p and not p.endswith("/") and not re.search(r"[*?{}]", p.replace("${", "").replace("}", ""))]


def heredoc_bodies(lines: list[Line]) -> set[int]:
    """idx of the lines that are the text of a here-document, per side of the diff that stays."""
    inside: list[tuple[str, bool]] = []
    out: set[int] = set()
    for x in lines:
        if x.side not in ("+", " "):
            continue
        if inside:
            word, tabs = inside[0]
            if (x.body.lstrip("\t") if tabs else x.body) == word:
                inside.pop(0)
            else:
                out.add(x.idx)
            continue
        inside = [(m.group(3), m.group(1) == "-") for m in _HEREDOC.finditer(strip_comment(x.body)) if "<<<" not in m.group()]
    return out


def pipeline_ends(text: str) -> tuple[str, str] | None:
    """First and last program of a line's last pipeline of two or more, without paths.

    >>> pipeline_ends("cd x; lftp -c u | tar x | sudo bash -s"), pipeline_ends("make && make install")
    (('lftp', 'bash'), None)
    """
    chain: list[str] = []
    for words, _, before in simple_commands(text):
        own = bare_words(words)
        name = own[0].rsplit("/", 1)[-1] if own else ""
        chain = [*chain, name] if before == "|" else [name]
    return (chain[0], chain[-1]) if len(chain) > 1 else None
