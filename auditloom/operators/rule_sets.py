"""Rule sets that users give: read from TOML, checked, gated, and joined to the catalogue. All of it happens on the driver, before a plan is built."""

import re
import tomllib
from re import _constants as codes
from re import _parser as patterns
from typing import NamedTuple

from auditloom.functions.recipe import BUILD_FUNCTIONS, HOOKS
from auditloom.operators.rules import RULES, Rule
from auditloom.operators.scoring import WEIGHTS

_FIELDS = {"id", "name", "pattern", "severity", "category", "match_target", "scope", "added_only", "include_comments", "exclude_if_matches", "weight_override", "enabled", "experimental", "stage"}
_TARGETS = {"raw_line": "raw", "resolved": "resolved"}
_SCOPES = {"function_body", "message", "other", *BUILD_FUNCTIONS, *HOOKS}


class Problem(NamedTuple):
    rule_id: str
    text: str


def _open(tree: object, inside: bool) -> bool:
    """Does a part that may repeat without end hold another one that may."""
    for op, arg in tree:
        if op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT):
            endless = arg[1] is codes.MAXREPEAT and op is not codes.POSSESSIVE_REPEAT
            if (endless and inside) or _open(arg[2], inside or endless):
                return True
        elif op is codes.SUBPATTERN and _open(arg[3], inside):
            return True
        elif op is codes.BRANCH and any(_open(x, inside) for x in arg[1]):
            return True
        elif op in (codes.ASSERT, codes.ASSERT_NOT) and _open(arg[1], inside):
            return True
    return False


def backtracks(pattern: str) -> bool:
    """May a search for the pattern take more than the square of a line, by repetitions within repetitions.

    >>> backtracks(r"(a+)+b"), backtracks(r"(?:x|(?:y*z)*)q"), backtracks(r"curl.*\\|\\s*sh"), backtracks(r"(?:a+){1,5}")
    (True, True, False, False)
    """
    return _open(patterns.parse(pattern), False)


def lint(entries: list[dict]) -> list[Problem]:
    """What is wrong with rule entries, in their order; nothing for entries that can be used."""
    out: list[Problem] = []
    met: set[str] = set()
    for e in entries:
        own = str(e.get("id") or "")
        say = lambda text, i=own: out.append(Problem(i, text))
        if not re.fullmatch(r"[A-Z]+\d{3,}", own):
            say("id is no letters and number")
        elif own in met:
            say("id is given twice")
        met.add(own)
        for name in sorted(set(e) - _FIELDS):
            say(f"unknown field {name}")
        if e.get("severity") not in WEIGHTS:
            say("unknown severity")
        if e.get("match_target", "resolved") not in _TARGETS:
            say("unknown match_target")
        for s in e.get("scope") or []:
            if s not in _SCOPES:
                say(f"unknown scope {s}")
        if e.get("weight_override") is not None and type(e["weight_override"]) is not int:
            say("weight_override is no whole number")
        if not e.get("pattern"):
            say("no pattern")
        for p in [e.get("pattern"), *(e.get("exclude_if_matches") or [])]:
            try:
                if p and backtracks(p):
                    say("pattern repeats within a repetition")
            except re.error:
                say("pattern is not a regular expression")
    return out


def load_rules(entries: list[dict], experimental: bool = False, base: tuple[Rule, ...] = RULES) -> tuple[tuple[Rule, ...], dict[str, int], list[Problem]]:
    """The rules to run, the weights that override those of severities, and the problems.

    Entries replace rules of the same id and add others; `enabled = false` switches one off, an experimental one runs only if asked for. A
    FATAL rule of the base stays as it is, whatever an entry says. Entries with a problem are left out.
    """
    problems = lint(entries)
    broken = {p.rule_id for p in problems}
    own = {r.id: r for r in base}
    weights: dict[str, int] = {}
    for e in entries:
        i = e.get("id")
        if i in broken:
            continue
        if i in own and own[i].severity == "FATAL":
            problems.append(Problem(i, "a FATAL rule cannot be changed"))
        elif not e.get("enabled", True) or (e.get("experimental", False) and not experimental):
            own.pop(i, None)
        else:
            unless = "|".join(f"(?:{p})" for p in e.get("exclude_if_matches") or [])
            own[i] = Rule(
                i, e.get("name", i), e["pattern"], e["severity"], e.get("category", "custom"), _TARGETS[e.get("match_target", "resolved")], tuple(e.get("scope") or ()), e.get("added_only", True), e.get("include_comments", False), unless, e.get("stage", "")
            )
            if e.get("weight_override") is not None:
                weights[i] = e["weight_override"]
    return tuple(own.values()), weights, problems


def read_rules(text: str, experimental: bool = False, base: tuple[Rule, ...] = RULES) -> tuple[tuple[Rule, ...], dict[str, int], list[Problem]]:
    """load_rules() of a TOML text with [[rule]] tables."""
    return load_rules(tomllib.loads(text).get("rule", []), experimental, base)
