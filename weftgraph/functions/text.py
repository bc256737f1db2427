"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words with a short form, agent nouns with their verbs, and stems that end in a silent e.
SYNONYMS = {
    "configuration": "config", "configure": "config", "configuring": "config", "configured": "config", "authentication": "auth", "authenticate": "auth",
    "authenticating": "auth", "initialization": "init", "initialize": "init", "initializing": "init", "specification": "spec", "specifications": "spec",
    "parameters": "param", "parameter": "param",
}
AGENTS = {"parser": "parse", "validator": "validate", "validators": "validate", "processor": "process", "miner": "mine", "compiler": "compile", "builder": "build", "watcher": "watch"}
SILENT_E = ["pars", "clos", "mak", "writ"]


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


_VERB = "verb"
# Endings of plurals of which no other rule follows, then other endings, the first that fits: (ending as a
# pattern, characters that a word has to have more than, characters cut off, what takes their place).
PLURALS = [("ies", 4, 3, "y"), ("(?:sses|shes|ches|xes)", 4, 2, "")]
ENDINGS = [
    ("ation", 6, 5, "ate"), ("ation", 0, 0, ""), ("ition", 6, 5, "ite"), ("tion", 5, 3, ""), ("ying", 5, 4, "y"), ("ing", 4, 3, _VERB), ("ied", 4, 3, "y"), ("ed", 4, 2, _VERB),
]


def _verb(base: Column) -> Column:
    """A verb whose ending was cut: with its silent e, and without a doubled last letter."""
    return F.when(base.rlike("(at|iz|id)$") | base.isin(SILENT_E), F.concat(base, F.lit("e"))).when(base.rlike(r"([^s])\1$"), F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)


def _by_rules(word: Column, rules: list[tuple[str, int, int, str]], otherwise: Column) -> Column:
    out = None
    for ending, longer, cut, put in rules:
        base = F.substring(word, F.lit(1), F.length(word) - cut)
        new = _verb(base) if put == _VERB else F.concat(base, F.lit(put))
        fits = word.rlike(f"{ending}$") & (F.length(word) > longer)
        out = F.when(fits, new) if out is None else out.when(fits, new)
    return out.otherwise(otherwise)


def stem(word: Column) -> Column:
    """A careful stem of a term: short words stay, known words have their own, then plurals, then other endings."""
    w = F.lower(F.trim(word))
    plural = w.rlike("s$") & ~w.rlike("(ss|us|is)$") & (F.length(w) > 3)
    single = F.when(plural, F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    rest = _by_rules(single, ENDINGS, F.coalesce(_mapped(AGENTS, single), single))
    return F.when(F.length(w) <= 3, w).otherwise(F.coalesce(_mapped(SYNONYMS, w), _by_rules(w, PLURALS, rest)))


def normalize_task(text: Column) -> Column:
    """Only letters, digits and marks that identifiers and paths use; blanks collapsed; case kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_./:\-\"'`(){}\[\]<> ]", " "), r"\s+", " "))


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 of the text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def camel_parts(name: Column) -> Column:
    """fooBarHTTP2 -> foo, Bar, HTTP2."""
    return F.regexp_extract_all(name, F.lit("[A-Z]+(?![a-z])[0-9]*|[A-Z]?[a-z]+[0-9]*|[0-9]+"), F.lit(0))


def variants(name: Column) -> Column:
    """Spellings under which an identifier may be found: as it is, in lower case, snake, kebab, dotted, joined, its
    parts, and the stem of each part; without repeats, in this order."""
    parts = F.transform(F.flatten(F.transform(F.split(name, r"[^A-Za-z0-9]+"), camel_parts)), F.lower)
    joined = lambda sep: F.array_join(parts, sep)
    whole = F.array(name, F.lower(name), joined("_"), joined("-"), joined("."), joined(""))
    return F.array_distinct(F.filter(F.concat(whole, parts, F.transform(parts, stem)), lambda x: x != ""))


def token_estimate(text: Column) -> Column:
    """max(1.3 tokens for each word, 1 for every 4 characters)."""
    n = F.regexp_count(text, F.lit(r"[^\t\n\f\r ]+"))  # a vertical tab is no space here, as in SQL
    return F.greatest(F.floor(n * 1.3), F.floor(F.length(text) / 4)).cast("long")


def normalize_route(path: Column) -> Column:
    """A URL or path as a template: no query, fragment or host; parameters and numbers become :param; lower case."""
    p = F.trim(F.substring_index(F.substring_index(path, "?", 1), "#", 1))
    p = F.when(p.contains("://"), F.regexp_replace(p, r"^.*?://[^/]*/?", "/")).otherwise(p)
    p = F.when(p.startswith("${"), F.regexp_replace(p, r"^\$\{[^}]*\}", "")).when(p.startswith("$") & p.contains("/"), F.regexp_replace(p, "^[^/]*/", "")).otherwise(p)
    segments = F.filter(F.transform(F.split(p, "/"), lambda s: F.trim(s)), lambda s: s != "")
    param = r"^(:[a-zA-Z0-9_$]+|\d+|[0-9a-fA-F-]{36})$"
    one = lambda s: F.when(s.rlike(param) | (s.contains("{") & s.contains("}")) | s.contains("${") | (s.contains("<") & s.contains(">")), F.lit(":param")).otherwise(F.lower(s))
    return F.when(F.trim(F.coalesce(path, F.lit(""))) == "", F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.transform(segments, one), "/")))


def segments(route: Column) -> Column:
    return F.filter(F.split(route, "/"), lambda s: s != "")


def literals(route: Column) -> Column:
    return F.filter(segments(route), lambda s: s != ":param")


def routes_match(client: Column, server: Column) -> Column:
    """Whether two normalized routes meet: equal segments or a :param on either side, over the whole or, of two segments
    or more, over the shorter one's length at the end; at least one literal segment in common."""
    a, b = segments(client), segments(server)
    n = F.least(F.size(a), F.size(b))
    tail = lambda x: F.slice(x, F.size(x) - n + 1, n)
    same = F.forall(F.zip_with(tail(a), tail(b), lambda x, y: (x == y) | (x == ":param") | (y == ":param")), lambda x: x)
    plain = lambda x: F.filter(tail(x), lambda s: s != ":param")
    # slice wants a start of 1 or more, so empty routes are settled first
    return F.when((n == 0) | (F.size(literals(client)) == 0), False).when(client == server, True).when((F.size(a) != F.size(b)) & (n < 2), False).otherwise(same & F.arrays_overlap(plain(a), plain(b)))


def template_only(url: Column) -> Column:
    """Whether a client's URL has no literal segment, so that it can't name a route: empty, a bare variable, a template
    around a path, or parameters alone."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return (u == "") | u.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") | (u.contains("${") & F.lower(u).contains("path")) | (F.size(literals(normalize_route(u))) == 0)


def citation(file: Column, start: Column, end: Column) -> Column:
    """file:start-end, as far as there are lines; '' without a file."""
    at = F.when(start.isNotNull(), F.concat(F.lit(":"), start.cast("string"), F.when(end.isNotNull(), F.concat(F.lit("-"), end.cast("string"))).otherwise("")))
    return F.when(F.coalesce(file, F.lit("")) == "", "").otherwise(F.concat(file, F.coalesce(at, F.lit(""))))


def first_sentence(text: Column) -> Column:
    """A story up to its first full stop."""
    return F.when(F.trim(text) != "", F.concat(F.trim(F.substring_index(text, ".", 1)), F.lit(".")))


def slug(text: Column) -> Column:
    """A name for files and anchors: letters and digits in lower case, joined by hyphens; a digest where none are left."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(plain != "", F.substring(plain, 1, 100)).otherwise(F.substring(F.sha2(text, 256), 1, 16))


def json_object(text: Column) -> Column:
    """The JSON object in a text as text: the whole of it, else in a fenced block, else from the first to the last brace;
    null where none of these is one."""
    t = F.trim(text)
    fenced = F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    braced = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    is_object = lambda x: F.coalesce(x.rlike(r"(?s)^\s*\{.*\}\s*$"), F.lit(False)) & F.try_parse_json(x).isNotNull()
    return F.when(is_object(t), t).when(is_object(fenced), fenced).when(is_object(braced), braced)


def symbols_match(candidate: Column, gold: Column) -> Column:
    """Whether a node's id is meant by a gold name: equal, or its end after :: or a dot; case aside."""
    c, g = F.lower(F.trim(candidate)), F.lower(F.trim(gold))
    return (c == g) | c.endswith(F.concat(F.lit("::"), g)) | c.endswith(F.concat(F.lit("."), g))


def files_match(candidate: Column, gold: Column) -> Column:
    """Whether two paths mean one file: one ends with the other; slashes, case and leading dots aside."""
    plain = lambda x: F.lower(F.regexp_replace(F.trim(F.replace(x, F.lit("\\"), F.lit("/"))), "^[./]+", ""))
    c, g = plain(candidate), plain(gold)
    return c.endswith(g) | g.endswith(c)
