"""What the text of a task names: identifiers, concepts, paths and what it leaves out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

# Words that carry no meaning in a task, in the order in which they are given.
STOP = set(
    """a an the is are was were be been being have has had do does did will would shall should may might must can could
    i me my we our you your he she it they this that these those what which who whom and or but if then else when where how why
    not no nor so too very just also only in on at to for of with from by as into about after before between through during above
    below up down out off over under all each every both few more most other some such than own same without against""".split()
)
# Verbs that say what to do, verbs that also name code, words of infrastructure, names that are no exclusions.
TO_DO = set(
    """add change modify update fix refactor remove delete implement create replace rename move increase decrease make ensure
    allow prevent improve optimize adjust""".split()
)
TECHNICAL = set(
    """validate parse test check verify handle support enable disable set get extract split merge debug investigate trace mine
    build route normalize resolve compute calculate find load save write read""".split()
)
INFRASTRUCTURE = set("docker compose kubernetes k8s deploy deployment ci cd infrastructure container helm terraform nginx yaml".split())
NO_EXCLUSION = set("django flask react fastapi express next the a an".split())
# What makes a clause that leaves something out: opening words, and the verb that has to follow (or may).
LEAVE = set("modify edit change touch alter update include".split())
LEAVING = set("modifying changing altering touching updating editing including".split())
AVOIDED = set("modifying changing touching editing".split())
OPENINGS = [(("must", "not"), LEAVE, True), (("do", "not"), LEAVE, True), (("don't",), LEAVE, True), (("without",), LEAVING, True), (("avoid",), AVOIDED, False), (("except",), set(), False), (("excepting",), set(), False), (("excluding",), set(), False)]
# The forms of paths, names in quotes, dotted names, routes and numbers.
PATH = re.compile(r"[\w./\\]+\.\w{1,5}")
QUOTED = re.compile(r"[`'\"]([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)[`'\"]")
DOTTED = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+")
ROUTE = re.compile(r"/[a-z0-9_/{}:]+")
NUMBER = re.compile(r"\b\d+\b")
_WORD = re.compile(r"[A-Za-z_](?:[\w']*\w)?")


@dataclass
class Intent:
    """What a task's text names."""

    text: str
    exclusions: list[str] = field(default_factory=list)
    quoted: list[str] = field(default_factory=list)
    dotted: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    api_paths: list[str] = field(default_factory=list)
    values: list[str] = field(default_factory=list)
    verbs: list[str] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    concepts: list[str] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    infrastructure: bool = False
    creates: bool = False

    @property
    def terms(self) -> list[str]:
        """All single words to search for."""
        return list(dict.fromkeys([*self.identifiers, *self.concepts, *(f"{a}_{b}" for a, b in self.pairs)]))

    @property
    def compounds(self) -> list[str]:
        """Names that two neighbouring words may have together."""
        forms = ("{a}_{b}", "{b}_{a}", "{A}{B}", "{B}{A}", "{a}{B}", "{b}{A}")
        return list(dict.fromkeys(f.format(a=a, b=b, A=a.capitalize(), B=b.capitalize()) for a, b in self.pairs for f in forms))


def _clauses(line: str) -> Iterator[tuple[int, int]]:
    """Where a line says what to leave out: the begin of the opening and of the clause, which goes on to its end."""
    words = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(line)]
    k = 0
    while k < len(words):
        for opening, verbs, needed in OPENINGS:
            n = len(opening)
            if tuple(w for w, _, _ in words[k : k + n]) != opening:
                continue
            followed = k + n < len(words) and words[k + n][0] in verbs
            if needed and not followed:
                continue
            last = words[k + n][2] if followed else words[k + n - 1][2]
            if line[last:].strip() and line[last : last + 1].isspace():
                yield words[k][1], last
                return
        k += 1


def exclusions(text: str) -> tuple[list[str], str]:
    """The files and names that a text leaves out, and the text without these clauses."""
    found, rest = [], []
    for line in text.split("\n"):
        for begin, at in _clauses(line):
            clause = line[at:].strip()
            for piece in PATH.findall(clause) or re.findall(r"\b[A-Z]\w{3,}\b", clause) or [clause]:
                name = piece.strip().strip("`\"'")
                if name and name.lower() not in STOP | NO_EXCLUSION and name not in found:
                    found.append(name)
            line = line[:begin]
        rest.append(line)
    return found, "\n".join(rest)


def _sort(token: str) -> str:
    """Whether a token is noise, a wish, a wish that names code, an identifier, or a concept."""
    low = token.lower()
    named = "_" in token or any(c.isupper() for c in token[1:])
    for group, sort in ((STOP, "noise"), (TO_DO, "wish"), (TECHNICAL, "code")):
        if low in group:
            return sort
    return "identifier" if named else "concept" if len(low) > 2 else "noise"


def intent(text: str) -> Intent:
    """Identifiers, concepts and limits of a task. Clauses that exclude are read first and don't count as wishes."""
    out = Intent(text)
    out.exclusions, rest = exclusions(text)
    out.quoted, out.dotted = QUOTED.findall(rest), DOTTED.findall(rest)
    out.paths = [p for p in PATH.findall(rest) if "/" in p or "\\" in p or p.count(".") == 1]
    out.api_paths, out.values = ROUTE.findall(rest), NUMBER.findall(rest)
    content: list[str] = []
    for token in re.findall(r"[A-Za-z_]\w*", rest):
        low, sort = token.lower(), _sort(token)
        if sort in ("wish", "code"):
            out.verbs.append(low)
        if sort in ("code", "concept"):
            out.concepts.append(low)
        if sort == "identifier":
            out.identifiers.append(token)
        if sort in ("identifier", "concept"):
            content.append(low)
    out.pairs = list(zip(content, content[1:], strict=False))
    out.identifiers += [n for n in dict.fromkeys(out.quoted + out.dotted) if n not in out.identifiers]
    named = {t.lower() for t in out.concepts + out.identifiers + out.paths}
    out.infrastructure = bool(named & INFRASTRUCTURE) or any(re.search(r"docker|compose|\.ya?ml$", p.lower()) for p in out.paths)
    words = re.findall(r"\w+", text.lower())
    out.creates = any(w == "new" for w in words[:-1]) or ("new" in words and bool(set(out.verbs) & {"add", "create", "implement", "scaffold"}))
    return out


def search_terms(want: Intent, spellings: dict[str, list[str]] | None = None) -> list[str]:
    """The words of a full-text query, any of which may match: names with their spellings (or the parts of dotted ones),
    ten compounds at most, concepts; no repeats, and nothing that the task leaves out."""
    spellings, terms = spellings or {}, []
    for name in want.identifiers:
        terms += name.split(".") if "." in name else [name, *spellings.get(name, [])]
    terms += want.compounds[:10] + want.concepts
    out_of_bounds = {t for e in want.exclusions for t in re.findall(r"[a-z0-9_]+", e.lower()) if len(t) > 1 and t not in STOP}
    seen: dict[str, str] = {}
    for term in (re.sub(r"\W", "", t) for t in terms):
        if len(term) > 1 and term.lower() not in out_of_bounds:
            seen.setdefault(term.lower(), term)
    return list(seen.values())
