"""Licence scans by sentence rules.

A text is cut into sentences, which may be wrapped onto several lines; each is normalised (lower case, comment marks and
punctuation dropped, spellings unified) and mapped to the identifier of a known licence sentence, where it is one: by a
table of the first words of all known sentences, whose entries are then compared. The sequence of identifiers is matched
against ordered rules: at each place the first rule that fits takes the sentences it covers. Sentences that are known but
that no rule takes are reported as such, so that unknown combinations show.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, small_batches, text_column
from .license_texts import NOTICES, ONE_LINE, RULES, TEXTS

#: Pieces of a text: lines, and in them what . ! ? or ; before white space ends (but for the v. of a version).
_CUT = re.compile(r"(\n+)|(?<=[.!?;])(?<![\s,(][vV]\.)[ \t\r\x0b\x0c]+")
#: Where a line ends its sentence; the marks of a comment; where a line begins an item of a list or a comment.
_HARD, _COMMENT, _ITEM = re.compile(r"(?:(?<![\s,(][vV])\.|[!?;:]|\*/|-->)[\"')\s]*$"), re.compile(r"\s*([#*/;%!<>\-]*)"), re.compile(r"\s*(?:/\*|<!--|[#*/;%!<>\-\s]*(?:\(?(?:\d{1,2}|[a-zA-Z])[.)]|[-•])\s)")
#: Words, in lower case, of which a known sentence holds at least one; notices need hold none, so no text is passed over for them.
_HINTS = (
    "license", "licence", "copyright", "(c)", "©", "permission", "permitted", "warrant", "reserved", "public", "software", "notice", "distribut", "endorse", "above", "useful", "version", "obtain", "cc0", "liab", "acknowledg",
    "copied", "eupl", "stuff", "parties", "promote", "origin",
)
_WORD = re.compile(r"[^\W_]")
_MARKS, _PUNCTUATION = re.compile(r"^[\s#*/;%!<>\-]+|[\s*/\-]+$"), re.compile(r"[\"'`“”‘’,:()\[\]*]|[.;!?]+(?=\s|$)")

_LONG = {"attribution": "by", "noncommercial": "nc", "sharealike": "sa", "noderivatives": "nd", "noderivs": "nd"}


def normalise(sentence: str) -> str:
    s = _PUNCTUATION.sub(" ", _MARKS.sub("", sentence.lower())).replace("licence", "license")
    return " ".join(s.split())


#: Words of a sentence that the table of known sentences is keyed by.
LEAD = 3
_ENUMERATED = re.compile(r"(?:\(?(?:\d{1,2}|[a-z])\.? )(?=\S)")


def _known_table() -> dict[str, list[tuple[str, re.Pattern]]]:
    """First words -> the sentences that begin with them, the longest first, as what they are known by."""
    table: dict[str, list[tuple[int, str, re.Pattern]]] = {}
    for name, text in TEXTS.items():
        by, _, _ = text.rpartition("|")
        choices = re.findall(r"<([^<>]*)>", by)
        literal = re.split(r"<[^<>]*>", by)
        pattern = re.escape(normalise(literal[0]))
        for choice, after in zip(choices, literal[1:], strict=True):
            either = "(?:" + "|".join(re.escape(normalise(c)) for c in choice.split("|")) + ")" if choice else ".*?"
            pattern = " ".join(x for x in (pattern, either, re.escape(normalise(after))) if x)
        starts = [f"{c} {literal[1]}" for c in choices[0].split("|")] if not literal[0].strip() else [literal[0]]
        for start in starts:
            key = " ".join(normalise(start).split()[:LEAD])
            table.setdefault(key, []).append((-len(by), name, re.compile(rf"{pattern}(?= |$)")))
    return {key: [(name, pattern) for _, name, pattern in sorted(found, key=lambda x: x[:2])] for key, found in table.items()}


class Run:
    """Normalised pieces as one text. What is looked for ahead of a place is remembered, so that no stretch of the text is
    searched twice for it, however many sentences begin before it."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.text = pieces, " ".join(pieces)
        self.ends = list(accumulate((len(p) for p in pieces), lambda end, n: end + 1 + n))
        self.starts = [e - len(p) for e, p in zip(self.ends, pieces, strict=True)]
        self._seen: dict[re.Pattern, tuple[int, re.Match | None]] = {}

    def ahead(self, pattern: re.Pattern, at: int) -> re.Match | None:
        """The first place of ``pattern`` from ``at`` on."""
        since, m = self._seen.get(pattern, (at + 1, None))
        if since > at or m and m.start() < at:
            m = pattern.search(self.text, at)
            self._seen[pattern] = at, m
        return m

    def sentence(self, pattern: re.Pattern, at: int) -> int | None:
        """The end of the known sentence that begins at ``at``; its gaps are of any length."""
        first, *others = PARTS[pattern]
        m = first.match(self.text, at)
        for part in others:
            m = m and self.ahead(part, m.end() + 1)
        return m.end() if m else None

    def notice(self, name: str, pattern: re.Pattern, at: int) -> re.Match | None:
        """The notice that begins at ``at``."""
        m = pattern.match(self.text, at, len(self.text) if name in ONE_LINE else at + _NOTICE)
        if m is None or name in ONE_LINE:
            return m
        if ".*?" not in pattern.pattern:
            return pattern.match(self.text, at)
        version = self.ahead(_VERSION_AHEAD, at)
        later = version and self.ahead(_LATER_AHEAD, version.end())
        end = later.end() if later else version.end() + 2 if version else 0  # a version may have .1
        return pattern.match(self.text, at, max(end, at + _NOTICE))


def _match(run: Run, at: int, alone: bool) -> tuple[str, dict[str, str], int, int] | None:
    """(name, what was captured, where its version is or -1, end) of the known sentence or notice that begins at a place;
    ``alone``: the run is one piece."""
    text = run.text
    bare = _ENUMERATED.match(text, at)  # 1. or a) before a sentence of a list
    for i in (at, bare.end()) if bare else (at,):
        words = text[i : i + 100].split(" ", LEAD)
        for name, pattern in KNOWN.get(" ".join(words[:LEAD]), ()):
            if end := run.sentence(pattern, i):
                return name, {}, -1, end
    if (alone and _ANY_ONE_LINE.match(text, at)) or _ANY.match(text, at, at + _NOTICE):
        for name, pattern in NAMED:
            if (alone or name not in ONE_LINE) and (m := run.notice(name, pattern, at)):
                got = {k: v for k, v in m.groupdict().items() if v}
                return name, got, m.start("v") if "v" in got else -1, m.end()
    return None


def _parts(pattern: re.Pattern) -> list[re.Pattern]:
    """What a known sentence's pattern has before, between and after its gaps."""
    first, *others = pattern.pattern.split(" .*? ")
    return [re.compile(p if p.endswith("(?= |$)") else f"{p}(?= )") for p in (first, *(f" {p}" for p in others))]


def _any(names: list[str]) -> re.Pattern:
    return re.compile("|".join(re.sub(r"\?P<\w+>", "?:", pattern) for name, pattern in NOTICES if name in names))


KNOWN, NAMED = _known_table(), [(name, re.compile(pattern)) for name, pattern in NOTICES]
PARTS = {pattern: _parts(pattern) for found in KNOWN.values() for _, pattern in found}
#: More characters than what a notice is known by has; its version, and a name of any length, may come after them.
_NOTICE = 400
_VERSION_AHEAD, _LATER_AHEAD = re.compile(r"version \d"), re.compile("any later version")
#: Whether there is a notice at all, over several lines or within one.
_ANY, _ANY_ONE_LINE = _any([name for name, _ in NOTICES if name not in ONE_LINE]), _any(sorted(ONE_LINE))


def _rule(words: str) -> re.Pattern:
    parts = []
    for word in words.split():
        either = "|".join(f"{w} " for w in word.rstrip("?").split("/"))
        parts.append(f"(?:{either})" + "?" * word.endswith("?"))
    return re.compile("".join(parts))


_COMPILED = [(name, _rule(words)) for name, words in RULES]


def runs(text: str) -> Iterator[list[str]]:
    """The pieces of a text, in runs that a wrapped sentence may go through: up to punctuation, an empty line (but for
    comment marks), an item of a list, or an edge of a comment."""
    run, marked, mark = [], "", ""
    pieces = _CUT.split(text)
    for k in range(0, len(pieces), 2):
        piece, lines = pieces[k], (pieces[k - 1] or "").count("\n") if k else 1
        if lines:  # else the piece goes on in a line, whose mark counts
            mark = _COMMENT.match(piece)[1]
        inside = marked.startswith("/*") or marked in ("*", "-") and not mark or bool(marked) == bool(mark)
        if run and (not piece.strip() or lines != 1 or not inside or _ITEM.match(piece)):
            yield run
            run = []
        if not piece.strip():
            continue
        if not run:
            marked = mark
        if not _WORD.search(piece) and not normalise(piece):
            if run:
                yield run
                run = []
            yield [piece]
            continue
        run.append(piece)
        if _HARD.search(piece):
            yield run
            run = []
    if run:
        yield run


def known(run: Run, k: int) -> tuple[str, dict[str, str], int] | None:
    """The identifier of the sentence that begins with piece k of a run, what its pattern captured, and how many pieces it
    has."""
    start, end = run.starts[k], run.ends[k]
    if k + 1 == len(run.pieces):
        hit, alone = None, _match(run, start, True)
    else:
        hit, alone = _match(run, start, False), None
        # without a hit, the piece has at most a notice of one line
        if (hit or _ANY_ONE_LINE.match(run.pieces[k])) and (alone := _match(Run([run.pieces[k]]), 0, True)):
            alone = (*alone[:2], -1, start + alone[3])
    if hit and alone and hit[0] == alone[0]:
        _, got, at, upto = hit
        # a number that only begins the next line is no version, and no more is captured: the line is the sentence
        loose = at - 1 in run.ends[k : bisect_left(run.ends, at)] and not run.text.endswith((" version", " v"), start, at - 1)
        hit = alone if loose or len(got) <= len(alone[1]) and upto <= end or len(got) < len(alone[1]) else hit
    hit = hit or alone
    if hit is None:
        return None
    return hit[0], hit[1], 1 + bisect_left(run.ends, hit[3], k) - k


def _name(template: str, got: dict[str, str]) -> str:
    kind = got.get("kind", "").strip()
    if "CC-" in template:
        kind = "-".join(_LONG.get(p, p) for p in kind.split("-")).upper()
    else:
        kind = {"affero": "A", "lesser": "L", "library": "L"}.get(kind, "")
    version = got.get("v", got.get("v2", ""))
    name = template.replace("{kind}", kind).replace("{v}", version + "+" * ("later" in got))
    return (name.upper() if template == "{v}" else name).rstrip("-")


def scan(text: str) -> tuple[int, list[str], list[tuple[str, int, int]], list[str]]:
    """(number of sentences, identifiers in order, licences with their first and last sentence, identifiers no rule took)."""
    found, sentences = [], 0
    for pieces in runs(text):
        run, k = Run([normalise(p) for p in pieces]), 0
        while k < len(pieces):
            if hit := known(run, k):
                sentences += k > 0  # a known sentence begins with a line of its own
                found.append((sentences, *hit[:2]))
            k += hit[2] if hit else 1
        sentences += 1
    line = [(i, name, got) for i, name, got in found if name != "copyright"]
    starts, at = {}, 0
    for k, (_, name, _) in enumerate(line):
        starts[at] = k
        at += len(name) + 1
    sequence, at, licences, rest = "".join(name + " " for _, name, _ in line), 0, [], []
    while at < len(sequence):
        k = starts[at]
        for template, rule in _COMPILED:
            if m := rule.match(sequence, at):
                last = k + m[0].count(" ") - 1
                got = {a: b for _, _, g in reversed(line[k : last + 1]) for a, b in g.items()}
                licences.append((_name(template, got), line[k][0], line[last][0]))
                at = m.end()
                break
        else:
            rest.append(line[k][1])
            at += len(line[k][1]) + 1
    return sentences, [name for _, name, _ in found], licences, rest


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses, n_licenses, unmatched) for each row of ``docs`` (doc_id, text):
    sentence_ids and unmatched are comma-joined, licenses has name:first:last sentence, in their order.

    A null or empty text has no sentences. Equal texts have equal results, repeated rows and ids each have their own. Texts
    of any length are scanned whole, in time that grows with their length: a sentence that begins at a line is looked
    for up to the end of the lines that it may be wrapped onto. Other columns are not looked at; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_sentences", "sentence_ids", "licenses", "n_licenses", "unmatched"]
        for batch in batches:
            rows = [scan(t) for t in text_column(batch).to_pylist()]
            cols = [[n for n, *_ in rows], [",".join(s) for _, s, *_ in rows], [",".join(f"{a}:{b}:{c}" for a, b, c in f) for *_, f, _ in rows], [len(f) for *_, f, _ in rows], [",".join(r) for *_, r in rows]]
            yield pa.record_batch([batch.column(0)] + [pa.array(c, pa.string() if n in ("sentence_ids", "licenses", "unmatched") else pa.int64()) for c, n in zip(cols, names[1:], strict=True)], names)

    small_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_sentences long, sentence_ids string, licenses string, n_licenses long, unmatched string")
