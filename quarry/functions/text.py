"""Text functions of the search index as Column expressions, and the count of a whole text's terms, which runs in Python."""

from __future__ import annotations

import re
import sys
from collections import Counter

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])
#: Words the index leaves out.
STOP_WORDS = (
    "a an and are can do does for get how i in is it of on or set that the this to use used using we what when where which why with"
).split()
#: Consonants that are doubled before -ing and -ed (fixed value).
DOUBLED = "bdgmnprt"
#: Paths of tests, fixtures, generated and vendored code (fixed values).
COPY_PATH = (
    r"(?i)(^|/)(tests?|__tests__|spec|testdata|fixtures?|__fixtures__|generated|__generated__|vendor)(/|$)"
    r"|(_test|\.(?:test|spec|gen|generated|pb))\.[a-z]+$|(^|/)(test_[^/]+|conftest)\.py$|(^|/)zz_generated[._]"
)
#: Words that ask for tests, and words that ask for anything but (fixed values).
WANTS_TESTS = r"(?i)\b(tests?|testdata|specs?|coverage|assert(?:ion)?s?|fixtures?|mocks?|generated|vendor(?:ed)?)\b"
CONTRAST = (
    r"(?i)\b(production|prod|non-?tests?|cop(?:y|ies)|duplicates?|skip(?:s|ped|ping)?|exclud(?:e|es|ed|ing)|ignor(?:e|es|ed|ing))\b"
)


def split_identifiers(text: Column) -> Column:
    """A space at each word boundary inside identifiers: HTTPServer -> HTTP Server, readFile -> read File."""
    return F.regexp_replace(F.regexp_replace(text, "([A-Z]+)([A-Z][a-z]{2})", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")


def _cut(c: Column, n: int) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - n)


def _singular(w: Column) -> Column:
    n = F.length(w)
    hissing = F.lit(False)
    for end in ("ses", "xes", "zes", "ches", "shes"):
        hissing = hissing | w.endswith(end)
    single = ~(w.endswith("ss") | w.endswith("us") | w.endswith("is"))
    many = F.when((n >= 5) & w.endswith("ies"), F.concat(_cut(w, 3), F.lit("y"))).when((n >= 5) & hissing, _cut(w, 2)).when((n >= 4) & single, _cut(w, 1))
    return F.when(w.endswith("s"), many.otherwise(w)).otherwise(w)


def _stem(w: Column) -> Column:
    def undoubled(s):
        last = F.substring(s, -1, 1)
        return F.when((F.length(s) >= 4) & (last == F.substring(s, F.length(s) - 1, F.lit(1))) & last.isin(*DOUBLED), _cut(s, 1)).otherwise(s)

    n = F.length(w)
    return F.when(w.endswith("ing") & (n >= 6), undoubled(_cut(w, 3))).when(w.endswith("ed") & (n >= 5), undoubled(_cut(w, 2))).otherwise(w)


def _without_e(w: Column) -> Column:
    return F.when(w.endswith("e") & (F.length(w) >= 4), _cut(w, 1)).otherwise(w)


def fold_all(words: Column) -> Column:
    """Each word of an array folded: plurals, then -ing and -ed, then a final e. Every step leaves three letters or more. A pass
    for each step, so that no step's expression is evaluated more than once."""
    return F.transform(F.transform(F.transform(words, _singular), _stem), _without_e)


def fold(term: Column) -> Column:
    """One form for the regular inflections of a lower-case word. Null stays null."""
    return fold_all(F.array(term))[0]


def raw_terms(text: Column) -> Column:
    """Words in order: identifiers split, lower case, one-letter and stop words dropped; not folded."""
    parts = F.split(F.lower(split_identifiers(text)), "[^a-z0-9]+")
    return F.filter(parts, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def terms(text: Column) -> Column:
    """The index terms of a text, in order. Null has none."""
    return F.coalesce(fold_all(raw_terms(text)), F.array().cast("array<string>"))


def terms_among(raw: Column, wanted: list[str]) -> Column:
    """Those of an array of unfolded words whose folded form is wanted, folded. Folding keeps the first two letters, so only
    words that begin like a wanted one are folded at all."""
    if not wanted:
        return F.array().cast("array<string>")
    heads = sorted({w[:2] for w in wanted})
    return F.filter(fold_all(F.filter(raw, lambda w: F.substring(w, 1, 2).isin(*heads))), lambda w: w.isin(*wanted))


def query_terms(query: str) -> list[str]:
    """The distinct terms of a query, in order: the same rules on the driver, for one short string."""
    text = re.sub("([a-z0-9])([A-Z])", r"\1 \2", re.sub("([A-Z]+)([A-Z][a-z]{2})", r"\1 \2", query))
    return list(dict.fromkeys(map(fold_word, (w for w in re.split("[^a-z0-9]+", text.lower()) if len(w) > 1 and w not in STOP_WORDS))))


def fold_word(w: str) -> str:
    if len(w) >= 5 and w.endswith("ies"):
        w = w[:-3] + "y"
    elif len(w) >= 5 and re.search("(s|x|z|ch|sh)es$", w):
        w = w[:-2]
    elif len(w) >= 4 and re.search("s$", w) and not re.search("(ss|us|is)$", w):
        w = w[:-1]
    if m := re.fullmatch("(.{3,})(ing|ed)", w):
        w = re.sub(f"^(.{{2,}})([{DOUBLED}])\\2$", r"\1\2", m[1])
    return re.sub("^(.{3,})e$", r"\1", w)


#: The folded forms of words, as far as a task keeps them.
FOLDED_WORDS = 200_000
_SPLITS = (re.compile("([A-Z]+)([A-Z][a-z]{2})"), re.compile("([a-z0-9])([A-Z])"), re.compile("[a-z0-9]{2,}"))


def count_terms(text: str | None, folded: dict[str, str | None]) -> dict[str, int]:
    """How often each index term of a text occurs: what ``terms`` gives, by one pass that folds a word once. ``folded`` is the
    caller's store of words' forms (None for a stop word), emptied when it is full."""
    if not text:
        return {}
    a, b, words = _SPLITS
    out: dict[str, int] = {}
    for w, n in Counter(words.findall(b.sub(r"\1 \2", a.sub(r"\1 \2", text)).lower())).items():
        if w not in folded:
            if len(folded) >= FOLDED_WORDS:
                folded.clear()
            folded[w] = None if w in STOP_WORDS else fold_word(w)
        if (t := folded[w]) is not None:
            out[t] = out.get(t, 0) + n
    return out


def plural_match(words: Column, term: Column) -> Column:
    """Whether an array of words holds a term, its plural by -s, or, if it ends so, the term without."""
    return F.array_contains(words, term) | F.array_contains(words, F.concat(term, F.lit("s"))) | (term.endswith("s") & F.array_contains(words, _cut(term, 1)))


def append_unique(own: Column, more: Column) -> Column:
    """An array, each value once, with what it lacks of another behind it."""
    return F.array_union(own, more)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def utf16_left(text: Column, n: int) -> Column:
    """At most ``n`` UTF-16 units of a text, a pair never cut in two. Rows without supplementary characters take the short way."""
    plain = F.length(text) == utf16_length(text)
    units = lambda c: F.transform(F.split(c, ""), lambda x: F.when(F.octet_length(x) > 3, 2).otherwise(1))
    fits = F.aggregate(
        units(text), F.struct(F.lit(0).alias("used"), F.lit(0).alias("taken")),
        lambda a, u: F.struct((a["used"] + u).alias("used"), (a["taken"] + F.when(a["used"] + u <= n, 1).otherwise(0)).alias("taken")),
        lambda a: a["taken"],
    )
    return F.when(plain, F.substring(text, 1, n)).otherwise(F.substring(text, F.lit(1), fits))


def tokens_estimate(text: Column) -> Column:
    """Four UTF-16 units make a token, rounded half up."""
    return F.floor(utf16_length(text) / 4 + 0.5).cast("long")


def is_copy(path: Column) -> Column:
    return path.rlike(COPY_PATH)


#: Paths of tests, by the narrower rule of reports on changes (fixed value).
TEST_PATH = r"(?i)(^|/)(tests?|specs?|__tests__)/|\.(test|spec)\.[cm]?[jt]sx?$|_test\.(go|py|rb)$"


def is_test(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def names_hit(name: Column, query: str) -> Column:
    """Whether a query has a symbol's name, the last part of a dotted one, among its words, case aside."""
    words = sorted({w for w in re.split(r"[^\w]+", query.lower()) if w})
    return F.lower(F.substring_index(name, ".", -1)).isin(words)


def asks_for_tests(query: str, prefix: str = "") -> bool:
    return bool(re.search(WANTS_TESTS, query) and not re.search(CONTRAST, query)) or bool(prefix and re.search(COPY_PATH, prefix))


def under(path: Column, prefix: str) -> Column:
    """Segment-aware prefix test."""
    prefix = prefix.strip("/")
    return F.lit(True) if prefix in ("", ".") else (path == prefix) | path.startswith(prefix + "/")


def directory(path: Column) -> Column:
    """The folder of a path; ``.`` for a path without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def span_bounds(span: Column) -> tuple[Column, Column]:
    """Start and end line of ``L<start>-L<end>``; null for anything else."""
    ok = span.rlike(r"^L\d+-L\d+$")
    get = lambda i: F.when(ok, F.regexp_extract(span, r"^L(\d+)-L(\d+)$", i).cast("int"))
    return get(1), get(2)


def strip_ordinals(node_id: Column) -> Column:
    """Ids without the ``~2``, ``~3`` that tell duplicates apart."""
    return F.regexp_replace(node_id, r"~\d+(?=\.|$)", "")


def clean_signature(text: Column) -> Column:
    """One line, without what opens a body."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\s*(=>|\{|:|=)+\s*$", "")
