"""What the commands of one line are after, judged by their words, options and targets rather than by the line's spelling.

Each check looks at simple commands as recipe.simple_commands() cuts them, so quoting, option order and spacing make no difference.
"""

import re

from auditloom.functions import recipe

#: The ports of ordinary distribution hosts, the domains of free registrars, modules and classes that reach the network.
USUAL_PORTS = frozenset({"80", "443", "8080", "8443"})
FREE_DOMAINS = frozenset({"tk", "ml", "ga", "cf", "gq", "pw"})
NETWORK_NAMES = ("socket", "urllib", "LWP", "Net::", "open-uri")
#: Fixed value: curl's short options that take a value, which ends a cluster of options.
_CURL_VALUES = frozenset("AbcCdDeEFHhKmoPQrtTuUwxXyYz")

_CUE = re.compile(r"/dev/|curl|wget|base64|://|FLAGS|-fplugin|execstack|stack-protector|--dynamic-linker|chmod|setcap|\binstall\b|\b(?:cp|mv|dd|tee|ln)\b|>|\b(?:python|perl|ruby|node|php|lua)")
_SET = re.compile(r"([A-Za-z_]\w*)\+?=(.*)", re.S)
_ONE_LINERS = re.compile(r"(?:python|perl|ruby|node|php|lua)[\d.]*")
_HTTP = re.compile(r"https?://([^/?#\s\"'<>()`\\]+)", re.I)


def _name(words: list[str]) -> str:
    return words[0].rsplit("/", 1)[-1] if words else ""


def _is_socket(word: str) -> bool:
    """Is there a path below /dev/tcp or /dev/udp, or below a part of /dev that only the shell will know."""
    _, below, rest = word.partition("/dev/")
    kind, more, _ = rest.partition("/")
    return bool(below and more) and (kind in ("tcp", "udp") or not set("$*?[").isdisjoint(kind))


def _authorities(text: str) -> list[tuple[str, str]]:
    """Host and port (or '') of every http url."""
    out = []
    for whole in _HTTP.findall(text):
        host, colon, port = whole.rpartition("@")[2].rpartition(":")
        out.append((host, port) if colon and port.isdigit() else (whole.rpartition("@")[2], ""))
    return [(h.rstrip(".,;").lower(), p) for h, p in out]


def _flags(words: list[str]) -> list[str]:
    """The single flags of a command and of the flag variables that it sets; what goes to the linker is taken apart."""
    out: list[str] = []
    for w in words:
        m = _SET.fullmatch(w)
        if m is None or m[1].endswith("FLAGS"):
            out += re.split(r"[\s,]+", m[2] if m else w)
    return out


def _loads_plugin(flags: list[str]) -> bool:
    return any(f.startswith(("-fplugin=", "--dynamic-linker")) for f in flags)


def _drops_hardening(flags: list[str]) -> bool:
    return any(f == "-fno-stack-protector" or f == "-zexecstack" or (f == "execstack" and i and flags[i - 1] == "-z") for i, f in enumerate(flags))


def _unchecked(words: list[str]) -> bool:
    """Does curl or wget take any certificate."""
    if _name(words) == "wget":
        return "--no-check-certificate" in words
    if _name(words) != "curl":
        return False
    for w in words[1:]:
        if w == "--insecure":
            return True
        if w.startswith("-") and not w.startswith("--"):
            for c in w[1:]:
                if c == "k":
                    return True
                if c in _CURL_VALUES:
                    break
    return False


def _special(mode: str) -> bool:
    """Does a mode set the setuid or setgid bit.

    >>> [_special(m) for m in ("4755", "02755", "755", "u+s", "g=rxs", "+x", "1777")]
    [True, True, False, True, True, False, False]
    """
    if mode.isdigit():
        return not set("89") & set(mode) and bool(int(mode, 8) & 0o6000)
    return any("s" in re.split(r"[+=]", clause, maxsplit=1)[1] for clause in mode.split(",") if re.fullmatch(r"[ugoa]*[+=][rwxXst]+", clause))


def _privileged(words: list[str]) -> list[str]:
    """The paths to which a command gives a setuid or setgid bit or a capability."""
    name, operands = _name(words), [w for w in words[1:] if not re.fullmatch(r"--?[A-Za-z-]*", w)]
    if name == "chmod" and operands and _special(operands[0]):
        return operands[1:]
    if name == "setcap" and operands and operands[0].startswith("cap_"):
        return operands[1:]
    if name == "install":
        for i, w in enumerate(words):
            mode = words[i + 1] if re.fullmatch(r"-\w*m|--mode", w) and i + 1 < len(words) else m[1] if (m := re.fullmatch(r"(?:-\w*m|--mode=)(\d+)", w)) else ""
            if mode and _special(mode):
                return words[-1:]
    return []


def targets(words: list[str], redirects: list[tuple[str, str]]) -> list[str]:
    """The paths that a command writes to: of a copy the last, of tee each, of dd its of=, and redirections."""
    name = _name(words)
    plain = [w for w in words[1:] if not w.startswith("-")]
    out = [path for sign, path in redirects if sign.startswith(">")]
    if name in recipe.COPIERS and (len(plain) > 1 or name == "install"):
        out += plain[-1:]
    elif name == "tee":
        out += plain
    elif name == "dd":
        out += [w[3:] for w in plain if w.startswith("of=")]
    return out


def _in_home(path: str) -> str | None:
    """The rest of a path below someone's home, NULL if it is elsewhere."""
    first, _, rest = path.partition("/")
    if first in ("~", "$HOME", "${HOME}"):
        return rest
    if path.startswith("/root/"):
        return path[6:]
    return path.split("/", 3)[3] if path.startswith("/home/") and path.count("/") > 2 else None


_SYSTEM = ("/etc/", "/boot/", "/usr/bin/", "/usr/lib/")
_COMMAND = tuple[list[str], list[tuple[str, str]], str]


def _chains(commands: list[_COMMAND]) -> set[str]:
    """R042 and R056: a file that the line fetches is run, or read into the shell, further on."""
    fetched: set[str] = set()
    out = set()
    for words, redirects, _ in commands:
        if _name(words) in recipe.FETCHERS:
            fetched |= {recipe.normal_path(p) for p in recipe.outputs(words, redirects)}
            continue
        given = [w for w in words[1:] if not w.startswith("-")] + [p for sign, p in redirects if sign == "<"]
        if _name(words) in ("source", "."):
            out |= {"R056"} if fetched & {recipe.normal_path(p) for p in given[:1]} else set()
        elif words and (recipe.normal_path(words[0]) in fetched or (_name(words) in recipe.INTERPRETERS and fetched & {recipe.normal_path(p) for p in given})):
            out.add("R042")
    return out


def _decodes(commands: list[_COMMAND]) -> bool:
    """Does base64 decode what a here-text or a variable gives, directly or through echo."""
    dynamic = lambda words: any("$" in w or "`" in w for w in words)
    for i, (words, redirects, before) in enumerate(commands):
        if _name(words) == "base64" and any(w == "--decode" or re.fullmatch(r"-\w*[dD]\w*", w) for w in words[1:]):
            told = before == "|" and i and _name(commands[i - 1][0]) in ("echo", "printf") and dynamic(commands[i - 1][0])
            if told or dynamic(words[1:]) or any(sign.startswith("<<") for sign, _ in redirects):
                return True
    return False


def _reaches_out(words: list[str]) -> bool:
    """Is it code given to an interpreter in the line that names the network."""
    if not _ONE_LINERS.fullmatch(_name(words)):
        return False
    code = [words[i + 1] for i, w in enumerate(words[:-1]) if re.fullmatch(r"-[A-Za-z]*[ce]", w)]
    return any("://" in c or any(n in c for n in NETWORK_NAMES) for c in code)


def marks_of(raw: str, resolved: str | None) -> list[str]:
    """The ids of the rules that a line's commands meet, sorted: by the line as written where the rule looks at that, else by its resolved text."""
    if not _CUE.search(raw) and not (resolved and _CUE.search(resolved)):
        return []
    found: set[str] = set()
    for host, port in _authorities(raw):
        found |= {"R047"} if port and port not in USUAL_PORTS else set()
        found |= {"R048"} if host.rpartition(".")[2] in FREE_DOMAINS and "." in host else set()
    commands = lambda text: [(recipe.bare_words(w), r, s) for w, r, s in recipe.simple_commands(recipe.strip_comment(text))]
    for words, redirects, _ in recipe.simple_commands(recipe.strip_comment(raw)):
        flags = _flags(words)
        found |= {"R049"} if _loads_plugin(flags) else set()
        found |= {"R050"} if _drops_hardening(flags) else set()
        words = recipe.bare_words(words)
        for path in targets(words, redirects):
            found |= {"R052"} if (_in_home(path) or "").startswith(".") else set()
            found |= {"R058"} if path.startswith(_SYSTEM) else set()
        found |= {"R059" if path.startswith("/") else "R053" for path in _privileged(words)}
    if resolved is not None:
        own = commands(resolved)
        found |= _chains(own)
        found |= {"R043"} if _decodes(own) else set()
        for words, redirects, _ in own:
            found |= {"R041"} if any(map(_is_socket, [*words, *(p for _, p in redirects)])) else set()
            found |= {"R044"} if _reaches_out(words) else set()
            found |= {"R057"} if _unchecked(words) else set()
    return sorted(found)
