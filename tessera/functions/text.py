"""Column functions over text and paths."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import registry as R


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def normal_path(path: Column) -> Column:
    """Slashes forward, none at either end."""
    return F.btrim(posix(path), F.lit("/"))


def absolute(path: Column, root: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.rtrim(root, F.lit("/")), path))


def absolute_all(paths: Column, root: Column) -> Column:
    """Array of {path, repo_relative}: the absolute path beside what it was made from."""
    return F.transform(paths, lambda p: F.struct(absolute(p, root).alias("path"), p.alias("repo_relative")))


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/", 1)).otherwise(F.lit(""))


def segments(path: Column) -> Column:
    return F.split(posix(path), "/")


def is_test_path(path: Column) -> Column:
    """Under a test tree by prefix, or by a directory (never by the file's own name)."""
    parts = segments(path)
    dirs = F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))
    prefix = F.lit(False)
    for p in R.TEST_PREFIXES:
        prefix = prefix | posix(path).startswith(p)
    return prefix | F.arrays_overlap(dirs, F.array(*[F.lit(s) for s in R.TEST_SEGMENTS]))


def is_pruned(path: Column) -> Column:
    """Below a pruned or dotted directory, judged on the relative path."""
    parts = segments(path)
    dirs = F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))
    return F.arrays_overlap(dirs, F.array(*[F.lit(s) for s in R.PRUNED_DIRS])) | F.exists(parts, lambda s: s.startswith("."))


def language(path: Column) -> Column:
    return R.mapped(R.LANGUAGES, F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)))


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a glob: ** over folders, * and ? inside one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "/_-" else "[" + c + "]"), i + 1
    return f"^{out}$"


def file_name(unit: Column) -> Column:
    """A unit's id as a file name."""
    return F.translate(unit, "/\\:", "___")


def safe_id(text: Column, default: str = "item") -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(text, "[^A-Za-z0-9._-]", "-"), F.lit("-")), F.lit("")), F.lit(default))


def finding_id(given: Column, file: Column, line: Column, group: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), F.concat_ws("-", file, line.cast("string"), group))


def slug(text: Column, limit: int = 40) -> Column:
    own = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.rtrim(F.substring(own, 1, limit), F.lit("-")), F.lit("")), F.lit("unit"))


def ordered_distinct(values: Column, limit: int | None = None) -> Column:
    """First occurrences in order, without empty ones."""
    own = F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))
    return own if limit is None else F.slice(own, 1, limit)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def count_of(text: Column, needle: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.length(F.left(text, offset)) - F.length(F.replace(F.left(text, offset), F.lit("\n"), F.lit(""))) + 1


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    """One alternation of literals, so that a long list stays a small expression."""
    return text.rlike("|".join(re.escape(n) for n in needles)) if needles else F.lit(False)


def first_of(text: Column, choices: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first needle, in their order, that the text holds."""
    return _first(choices, lambda needle: F.contains(text, needle), default)


def first_end(text: Column, choices: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first ending, in their order, that the text has."""
    return _first(choices, lambda needle: F.endswith(text, needle), default)


def _first(choices: Sequence[tuple[str, str]], test: Callable[[Column], Column], default: str | None) -> Column:
    pairs = F.array(*[F.struct(F.lit(n).alias("needle"), F.lit(v).alias("value")) for n, v in choices])
    return F.coalesce(F.get(F.filter(pairs, lambda p: test(p["needle"])), F.lit(0))["value"], F.lit(default))


def short_sha(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(text), 1, n)


def without_bom(content: Column) -> Column:
    """Binary content without a leading UTF-8 byte order mark."""
    return F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 2147483647)).otherwise(content)


# ---------------------------------------------------------------- signals of requirement texts

ENDPOINT = r"(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)[ \t]+(/[A-Za-z0-9_./{}~:-]+)"
BARE_API = r"(?<![A-Za-z])(/api/[A-Za-z0-9_./{}~:-]+)"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,}"
FILE_MENTION = r"[A-Za-z0-9_./@-]+\.(?:java|kt|py|ts|tsx|js|jsx|go|rb|php|cs|rs|cpp|cc|c|hpp|h|scala|sql|xml|yml|yaml|properties)"


def endpoints(text: Column) -> Column:
    """"METHOD /path" as written, then bare /api paths that no method names."""
    named = F.zip_with(found(text, ENDPOINT, 1), found(text, ENDPOINT, 2), lambda m, p: F.concat(m, F.lit(" "), p))
    bare = F.array_except(found(text, BARE_API, 1), found(text, ENDPOINT, 2))
    return F.array_distinct(F.concat(named, bare))


def sensitive_names(text: Column) -> Column:
    return F.array_distinct(F.filter(found(text, IDENTIFIER), lambda w: F.exists(F.array(*[F.lit(s) for s in R.SENSITIVE_SUBSTRINGS]), lambda s: F.contains(F.lower(w), s))))


def role_hints(text: Column) -> Column:
    words = F.transform(found(text, "[A-Za-z]+"), lambda w: F.lower(w))
    named = found(text, r"hasRoles?\([ ]*['\"]([A-Za-z_][A-Za-z0-9_-]*)['\"][ ]*\)", 1)
    return F.array_distinct(F.concat(F.filter(words, lambda w: w.isin(*R.ROLES)), named))


def file_mentions(text: Column) -> Column:
    return F.array_distinct(F.filter(found(text, FILE_MENTION), lambda f: F.contains(f, F.lit("/")) | (F.regexp_count(f, F.lit("[.]")) >= 2)))


# ---------------------------------------------------------------- statistics

#: Ideographs, their punctuation and full-width forms; and ideographs alone.
DENSE = r"[\x{3000}-\x{303F}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{2A6DF}]"
CJK = r"[\x{4E00}-\x{9FFF}]"
#: Characters per token, of ASCII and of everything else.
ASCII_RATIO, DENSE_RATIOS = 4.0, {"tokens_low": 2.0, "tokens_mid": 1.5, "tokens_high": 1.2}


def text_stats(text: Column) -> dict[str, Column]:
    chars, ascii_, cjk = F.length(text), F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")), F.regexp_count(text, F.lit(DENSE))
    return {
        "n_lines": count_of(text, "\n") + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0),
        "n_chars": chars,
        "n_cjk": cjk,
        "n_ascii": ascii_,
        "n_other": chars - cjk - ascii_,
        "n_bytes": F.octet_length(text),
    }


def token_range(cjk: Column, ascii_: Column, other: Column) -> dict[str, Column]:
    """Token estimates: low, mid and high, half-even."""
    return {k: F.bround(ascii_ / ASCII_RATIO + (cjk + other) / ratio).cast("long") for k, ratio in DENSE_RATIOS.items()}


def ascii_atom_share(line: Column) -> Column:
    """Share of English words in a line of Chinese prose, among its ideographs and words.

    Null for lines that are no such prose: headings, quotes, table rows, lines
    without ideographs or with known words, labels and single letters only.
    Inline code is left out.
    """
    bare = F.regexp_replace(line, "`[^`]*`", " ")
    words = found(bare, "[A-Za-z][A-Za-z0-9'-]*")
    atoms = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*R.KNOWN_WORDS) & ~w.rlike("^[A-Za-z][0-9]$|^[stST][0-9]{1,2}$"))
    ideographs = F.regexp_count(bare, F.lit(CJK))
    prose = ~line.rlike(r"^\s*([>#|]|$)") & (ideographs > 0) & (F.size(atoms) > 0)
    return F.when(prose, F.size(atoms) / (ideographs + F.size(words)))
