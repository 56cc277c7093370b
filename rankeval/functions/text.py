"""Text and path expressions: tokens, path rules, search patterns of a report, clean-up of reply lines."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TOKEN = 2

#: What is not source code. Directory names, file suffixes, and the names of test directories.
NON_SOURCE_DIRS = ("docs", "doc", ".github", "examples", "benchmarks")
NON_SOURCE_SUFFIXES = (".md", ".rst", ".txt", ".cfg", ".ini", ".toml", ".lock", ".json", ".yaml", ".yml")
TEST_DIRS = ("tests", "test", "testing")

#: Patterns of a report. Java needs (?U) for letters beyond ASCII.
FILE_SUFFIXES = ("py", "pyx", "pxd", "c", "cc", "cpp", "h", "js")
ERROR = r"(?U)\b\w*(?:Error|Exception|Warning)\b\s*:\s*([^\n]+)"
DOTTED = r"(?U)\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\b"
SNAKE = r"(?U)\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"
CAMEL_NAME = r"(?U)\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b"
PATH = rf"(?U)\b[\w][\w./-]*\.(?:{'|'.join(FILE_SUFFIXES)})\b"
MIN_NAME, MIN_MESSAGE, PER_KIND = 4, 8, 10


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def tokenize(text: Column | str) -> Column:
    """Lower-cased tokens in order, repeats kept; a word of several parts follows them whole."""

    def parts(word: Column) -> Column:
        found = F.filter(F.transform(_all(word, r"[A-Z]+(?![a-z])|[A-Z][a-z]*|[a-z]+|[0-9]+"), F.lower), lambda p: F.length(p) >= MIN_TOKEN)
        whole = F.transform(F.array(found), lambda p: F.when(F.size(p) > 1, F.concat(p, F.array(F.lower(word)))).otherwise(p))
        # Most words have one case and no digit: they are their only part.
        plain = F.when(F.length(word) >= MIN_TOKEN, F.array(F.lower(word))).otherwise(F.array().cast("array<string>"))
        return F.when(word.rlike("^(?:[A-Z]?[a-z]+)$"), plain).otherwise(F.element_at(whole, 1))

    t = F.coalesce(_col(text), F.lit(""))
    compound = F.flatten(F.transform(_all(t, "[A-Za-z0-9_]+"), parts))
    # Without underscores, inner capitals and digits beside letters, every word is its only part. Literal searches in a
    # copy that has one letter for each kind of character cost far less than a pattern over the text.
    simple = F.filter(F.split(F.translate(t, string.ascii_uppercase, string.ascii_lowercase), "[^a-z0-9]+", -1), lambda w: F.length(w) >= MIN_TOKEN)
    kinds = F.translate(t, string.ascii_uppercase + string.ascii_lowercase + string.digits, "A" * 26 + "a" * 26 + "0" * 10)
    mixed = F.lit(False)
    for pair in ("_", "aA", "AA", "a0", "A0", "0a", "0A"):
        mixed = mixed | kinds.contains(pair)
    return F.when(mixed, compound).otherwise(simple)


def tokenize_path(path: Column | str) -> Column:
    return F.concat(tokenize(path), F.array(F.lower(_col(path))))


def normalize_path(path: Column | str) -> Column:
    """Slashes one way and single, no leading slash or ./; case stays."""
    return F.regexp_replace(F.regexp_replace(_col(path), r"[\\/]+", "/"), r"^/?(\./)*", "")


def is_test_path(path: Column | str) -> Column:
    p = _col(path)
    return p.rlike(rf"(^|/)({'|'.join(TEST_DIRS)})/") | p.rlike(r"(^|/)test_[^/]*$") | p.rlike(r"_test\.py$")


def is_source(path: Column | str) -> Column:
    """Not a test, not below a directory of docs or the like, no suffix of text or settings. Unknown suffixes are source."""
    p = _col(path)
    dirs = "|".join(d.replace(".", r"\.") for d in NON_SOURCE_DIRS)
    ends = "|".join(s.replace(".", r"\.") for s in NON_SOURCE_SUFFIXES)
    return ~(is_test_path(p) | p.rlike(rf"(^|/)({dirs})/") | p.rlike(rf"({ends})$"))


def valid_sha(sha: Column | str) -> Column:
    return F.coalesce(_col(sha).rlike(r"\A[0-9a-f]{40}\z"), F.lit(False))


def existing_form(path: Column | str) -> Column:
    """A path as tools look it up: blanks off both ends, then every leading dot and slash."""
    return F.ltrim(F.trim(_col(path)), F.lit("./"))


def issue_patterns(text: Column | str, limit: int = PER_KIND) -> Column:
    """A struct of four lists, each distinct in order of first mention and cut at limit."""
    t = _col(text)
    first = lambda a: F.slice(F.array_distinct(a), 1, limit)
    strip = lambda m: F.regexp_replace(m, r"(?U)^\s+|\s+$", "")
    messages = F.filter(F.transform(_all(t, ERROR, 1), strip), lambda m: F.length(m) >= MIN_MESSAGE)
    messages = F.filter(F.transform(messages, lambda m: F.regexp_replace(m, "^[`\"'.]+|[`\"'.]+$", "")), lambda m: F.length(m) >= MIN_MESSAGE)
    dotted = F.filter(_all(t, DOTTED), lambda n: (F.length(n) >= MIN_NAME) & ~F.substring_index(n, ".", -1).isin(*FILE_SUFFIXES))
    names = F.filter(F.concat(_all(t, SNAKE), _all(t, CAMEL_NAME)), lambda n: F.length(n) >= MIN_NAME)
    return F.struct(first(messages).alias("error_strings"), first(dotted).alias("dotted_names"), first(names).alias("identifiers"), first(_all(t, PATH)).alias("traceback_paths"))


def reply_line(line: Column | str) -> Column:
    """A line of a reply less blanks, backticks and list marks."""
    s = F.regexp_replace(_col(line), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "^`+|`+$", ""), r"^[-*0123456789. ]+", ""), r"(?U)^\s+|\s+$", "")


def format_duration(seconds: Column | str) -> Column:
    s = F.floor(_col(seconds)).cast("long")
    m = F.floor(s / 60).cast("long")
    return F.when(m > 0, F.format_string("%dm %02ds", m, s - 60 * m)).otherwise(F.format_string("%ds", s))


def first_lines_within(lines: Column, max_lines: int, max_chars: int) -> Column:
    """The first lines that fit: at most max_lines, and max_chars with a line end each."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        full = acc["full"] | (acc["used"] + F.length(x) + 1 > max_chars)
        return F.struct(F.when(full, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"), F.when(full, acc["used"]).otherwise(acc["used"] + F.length(x) + 1).alias("used"), full.alias("full"))

    return F.aggregate(F.slice(lines, 1, max_lines), start, step, lambda acc: acc["kept"])
