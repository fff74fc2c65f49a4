"""Column builders over names, paths and source text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that the tokeniser strips, in this order.
SUFFIXES = ["ing", "ers", "er", "ed", "es", "s"]
#: Weights of symbol kinds in ranked search.
KIND_WEIGHT = {"class": 1.0, "function": 1.0, "method": 1.0, "type": 0.95, "constant": 0.9, "other": 0.85, "import": 0.6}


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, "[.]([^./]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), "[.][^.]*$", "")


#: What marks a test for the chain language: parts of the path, of the basename, and endings.
TEST_PARTS = ["/test/", "/tests/", "/__tests__/", "/fixtures/"]
TEST_NAME_ENDS = [".test.ts", ".test.tsx", ".test.js", ".spec.ts", ".spec.js"]
#: What marks a test for the index: folders and endings.
TEST_FOLDERS = ["test/", "tests/", "__tests__/", "spec/", "specs/", "fixtures/", "testdata/"]
TEST_FILE_ENDS = ["_test.go", "_test.py", "_test.rs", "_test.cc", "_test.cpp", "_test.cxx", "_spec.rb", ".test.js", ".test.jsx", ".test.ts", ".test.tsx", ".spec.js", ".spec.jsx", ".spec.ts", ".spec.tsx"]
GENERATED_PARTS = ["/vendor/", "/gen/", "/generated/"]


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _normal(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def is_test_path(path: Column) -> Column:
    """The chain language's notion of a test file: by folder, basename or ending."""
    p = _normal(path)
    name = basename(p)
    return _any([*(p.contains(x) for x in TEST_PARTS), name.startswith("test_"), name.contains("_test."), *(name.endswith(x) for x in TEST_NAME_ENDS)])


def is_test_path_canonical(path: Column) -> Column:
    """The index's notion: more folders and endings, and ``test_*.py`` at the root only."""
    p = _normal(path)
    name = basename(p)
    folder = [c for x in TEST_FOLDERS for c in (p.startswith(x), p.contains("/" + x))]
    return _any([*folder, *(name.endswith(x) for x in TEST_FILE_ENDS), ~p.contains("/") & p.startswith("test_") & p.endswith(".py")])


def is_generated_path(path: Column) -> Column:
    p = _normal(path)
    return _any(p.contains(x) for x in GENERATED_PARTS)


#: White space as source readers strip it, and line ends as they split at them, for Java's and RE2's expressions.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def source_lines(content: Column) -> Column:
    """Lines of a text; an end of line at its end doesn't begin another, an empty text has none."""
    v = F.split(content, LINE_END)
    return F.when(F.element_at(v, -1) == "", F.slice(v, 1, F.size(v) - 1)).otherwise(v)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def words(text: Column) -> Column:
    """Lower-case tokens: camel case and separators split, common suffixes stripped, single letters dropped."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    parts = F.split(F.trim(F.lower(spaced)), " +")

    def stripped(w: Column) -> Column:
        out = w
        for suffix in reversed(SUFFIXES):
            out = F.when(w.endswith(suffix) & (F.length(w) > len(suffix) + 2), F.substring(w, F.lit(1), F.length(w) - len(suffix))).otherwise(out)
        return out

    return F.filter(F.transform(parts, stripped), lambda w: F.length(w) >= 2)


def symbol_text() -> Column:
    return F.concat_ws(" ", "name", "kind", "file", "language")


def glob_regex(glob: str) -> str:
    """A full-match regex: ``**`` crosses directories, ``*`` and ``?`` stay inside one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
            i += 1
    return f"^{out}$"


def wildcard_regex(pattern: str) -> str:
    """Case-insensitive prefix-anchored pattern in which ``*`` stands for anything."""
    return "(?i)^" + ".*".join(re.escape(p) for p in pattern.split("*"))


def risk_band(complexity: Column) -> Column:
    return F.when(complexity <= 5, "low").when(complexity <= 10, "medium").when(complexity <= 20, "high").otherwise("critical")


def grade(total: Column) -> Column:
    return F.when(total >= 90, "A").when(total >= 80, "B").when(total >= 70, "C").when(total >= 50, "D").otherwise("F")


def grade_rank(letter: Column) -> Column:
    """0 for A to 4 for F."""
    return F.when(letter == "A", 0).when(letter == "B", 1).when(letter == "C", 2).when(letter == "D", 3).otherwise(4)


def param_count(signature: Column) -> Column:
    """Commas outside of brackets, and one, inside the first parentheses; 0 when they are empty."""
    inner = F.regexp_extract(signature, "[(]([^)]*)[)]", 1)
    zero = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        deeper = F.when(c.isin("(", "<"), 1).when(c.isin(")", ">"), -1).otherwise(0)
        return F.struct((acc["depth"] + deeper).alias("depth"), (acc["n"] + ((c == ",") & (acc["depth"] == 0)).cast("int")).alias("n"))

    return F.when(stripped(inner) == "", 0).otherwise(F.aggregate(F.split(inner, ""), zero, step)["n"])


#: Patterns of a declared name, the first that fits counts.
NAME_PATTERNS = [
    r"(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?(?:abstract\s+)?(?:synchronized\s+)?(?:[\w<>,\s\[\]]+)\s+(\w+)\s*\(",
    r"(?:static\s+)?(?:final\s+)?(?:abstract\s+)?(?:[\w<>,\s\[\]]+)\s+(\w+)\s*\(",
    r"def\s+(\w+)\s*\(",
    r"function\s+(\w+)\s*\(",
]


def name_of(content: Column) -> Column:
    """Declared name by the first pattern that fits, else ``unknown``."""
    found = [F.nullif(F.regexp_extract(content, p, 1), F.lit("")) for p in NAME_PATTERNS]
    return F.coalesce(*found, F.lit("unknown"))


def has_modifier(content: Column, word: str) -> Column:
    """Whether the first line has ``word`` before white space or ``<``."""
    return F.split_part(content, F.lit("\n"), F.lit(1)).rlike(rf"(?:^|\s){re.escape(word)}(?:\s|<)")


#: What a text loses, in this order, before copies are compared.
NOT_CODE = [r'"""[\s\S]*?"""', r"'''[\s\S]*?'''", r"//[^\n]*", r"/\*[\s\S]*?\*/", r"#[^\n]*", BLANK + "+"]


def fingerprint(text: Column) -> Column:
    """Digest of a text without docstrings, comments and white space, runs of name characters made alike."""
    body = text
    for p in NOT_CODE:
        body = F.regexp_replace(body, p, "")
    body = F.regexp_replace(body, "[a-zA-Z_][a-zA-Z0-9_]*", "_")
    return F.substring(F.sha2(body.cast("binary"), 256), 1, 32)
