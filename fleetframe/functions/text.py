"""Text expressions: comments, paths, requirements, globs, log lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in the Unicode sense, with the four ASCII separators.
_BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203),
                            8232, 8233, 8239, 8287, 12288]))
_COLOUR = r"\x1b\[\d+m"
_LOCAL = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def strip_comments(text: Column) -> Column:
    """Cut every line at its first '#', strip it, drop empty lines, join again.

    A '#' inside a string literal cuts too.
    """
    lines = F.transform(
        F.split(text, "\n"), lambda line: strip(F.substring_index(line, "#", 1))
    )
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


# Fixed value: the default pattern of paths, which results depend on.
def find_paths(text: Column, pattern: str = "/store/mc.*?root") -> Column:
    """All non-overlapping matches of `pattern`, in text order. A dot stops at line ends."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def dataset_scenario(key: Column) -> Column:
    """Part of a dataset key before its first dot."""
    return F.get(F.split(key, r"\.", 2), 0)


def dataset_name(key: Column) -> Column:
    """Part of a dataset key after its first dot; null without a dot."""
    return F.get(F.split(key, r"\.", 2), 1)


def submitted_pairs(output: Column) -> Column:
    """array<struct<njobs, cluster_id>> reported in the output of a submit command."""
    # Fixed value: the report of a submit command.
    pattern = F.lit(r"(\d+) job\(s\) submitted to cluster (\d+)")
    counts = F.regexp_extract_all(output, pattern, F.lit(1))
    clusters = F.regexp_extract_all(output, pattern, F.lit(2))
    return F.zip_with(
        counts,
        clusters,
        lambda n, c: F.struct(
            n.try_cast("bigint").alias("njobs"), c.try_cast("bigint").alias("cluster_id")
        ),
    )


def addresses(text: Column) -> Column:
    """Host addresses in a free-form list."""
    # Fixed value: the characters of an address.
    return F.regexp_extract_all(text, F.lit(r"[\w/:.\-]+"), F.lit(0))


def requirement_name(requirement: Column) -> Column:
    """Package name before the first of < = >, without a trailing ~ or !.

    A sign in the first place does not count as a version.
    """
    name = F.regexp_extract(requirement, r"^([^<=>]+)", 1)
    return F.when(name == "", requirement).otherwise(F.rtrim(F.regexp_replace(name, r"[~!]$", "")))


def requirement_version(requirement: Column) -> Column:
    """Version part of a requirement from its first sign on; empty without one."""
    return F.regexp_extract(requirement, r"^[^<=>]+?([~!]?[<=>].*)$", 1)


def has_version(requirement: Column) -> Column:
    return requirement.rlike("[<=>]")


def is_local_path(path: Column) -> Column:
    """No protocol in front, so the file has to be transferred."""
    return ~path.rlike(_LOCAL)


# A shell pattern falls into sets in brackets (a bracket right after the opening or after its !
# is a member) and single characters; a set into ranges and single members.
_GLOB_TOKEN = r"(?s)\[!?\]?[^\]]*\]|."
_SET_PART = r"(?s).-.|."
_NOTHING = "(?!)"


def _escape(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z_])", r"\\\1", text)


def _set_regex(token: str) -> str:
    negated = token[1] == "!"
    parts = []
    for part in re.findall(_SET_PART, token[2 if negated else 1 : -1]):
        if len(part) == 1:
            parts.append(_escape(part))
        elif part[0] <= part[2]:  # a range that runs backwards holds nothing
            parts.append(f"{_escape(part[0])}-{_escape(part[2])}")
    if not parts:
        return "." if negated else _NOTHING
    return f"[{'^' * negated}{''.join(parts)}]"


def _token_regex(token: str) -> str:
    if len(token) > 1:
        return _set_regex(token)
    return {"*": ".*", "?": "."}.get(token) or _escape(token)


def glob_regex(pattern: str) -> str:
    """Regular expression of a shell pattern: * ? [x] [!x], whole string."""
    return "(?s)^(?:" + "".join(map(_token_regex, re.findall(_GLOB_TOKEN, pattern))) + r")\z"


def matches_any(text: Column, patterns: list[str]) -> Column:
    """True where at least one shell pattern matches; one scan, no join.

    The patterns are arguments of the call, so there are as many as a caller names.
    """
    if not patterns:
        return F.lit(False)
    bodies = [glob_regex(p).removeprefix("(?s)^").removesuffix(r"\z") for p in patterns]
    return text.rlike("(?s)^(?:" + "|".join(bodies) + r")\z")


def glob_regex_column(pattern: Column) -> Column:
    """`glob_regex` for patterns that come as a column."""

    def escape(text: Column) -> Column:
        return F.regexp_replace(text, "([^0-9A-Za-z_])", r"\\$1")

    def part_regex(part: Column) -> Column:
        low, high = F.substring(part, 1, 1), F.substring(part, 3, 1)
        backwards = F.when(low > high, "").otherwise(F.concat(escape(low), F.lit("-"), escape(high)))
        return F.when(F.length(part) == 1, escape(part)).otherwise(backwards)

    def set_regex(token: Column) -> Column:
        negated = F.substring(token, 2, 1) == "!"
        start = F.when(negated, 3).otherwise(2)
        body = F.substring(token, start, F.length(token) - start)
        parts = F.regexp_extract_all(body, F.lit(_SET_PART), F.lit(0))
        members = F.array_join(F.transform(parts, part_regex), "")
        empty = F.when(negated, ".").otherwise(_NOTHING)
        full = F.concat(F.when(negated, "[^").otherwise("["), members, F.lit("]"))
        return F.when(members == "", empty).otherwise(full)

    def token_regex(token: Column) -> Column:
        return (
            F.when(F.length(token) > 1, set_regex(token))
            .when(token == "*", ".*").when(token == "?", ".").otherwise(escape(token))
        )

    tokens = F.regexp_extract_all(pattern, F.lit(_GLOB_TOKEN), F.lit(0))
    return F.concat(F.lit("(?s)^(?:"), F.array_join(F.transform(tokens, token_regex), ""), F.lit(r")\z"))


# What stands before and behind a text whose fragments are looked up, and in place of wildcards.
_START, _END, _GAP = "\x02", "\x03", "\x00"
FRAGMENTS = (1, 2, 3, 4, 6, 8)  # lengths of fragments; one of eight tells most texts apart, of three few


def _pieces(text: Column, size: int) -> Column:
    """All stretches of `size` characters; single anchors say nothing and are left out."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    found = F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(size)))
    return F.filter(found, lambda p: ~p.isin(_START, _END)) if size == 1 else found


def marked_ends(text: Column) -> Column:
    return F.concat(F.lit(_START), text, F.lit(_END))


def fragments_at(marked: Column, at: Column) -> Column:
    """The fragments that start at a place of a text with marked ends, of all lengths in FRAGMENTS;
    null for those that it is too short for."""
    fits = [at + F.lit(n - 1) <= F.length(marked) for n in FRAGMENTS]
    return F.array(*[F.when(fit, F.substring(marked, at, F.lit(n))) for fit, n in zip(fits, FRAGMENTS)])


def text_fragments(text: Column) -> Column:
    """The distinct fragments of a text, its ends marked."""
    marked = marked_ends(text)
    places = F.sequence(F.lit(1), F.length(marked))
    return F.array_distinct(F.array_compact(F.flatten(F.transform(places, lambda at: fragments_at(marked, at)))))


def glob_fragments(pattern: Column) -> Column:
    """The fragments that every match of a shell pattern holds, the longest of each stretch between
    its wildcards and sets; empty for a pattern of wildcards and sets only."""
    tokens = F.regexp_extract_all(pattern, F.lit(_GLOB_TOKEN), F.lit(0))
    open_ = F.transform(tokens, lambda t: F.when((F.length(t) > 1) | t.isin("*", "?"), F.lit(_GAP)).otherwise(t))
    runs = F.split(F.concat(F.lit(_START), F.array_join(open_, ""), F.lit(_END)), _GAP)

    def longest(run: Column) -> Column:
        found = _pieces(run, FRAGMENTS[0])
        for n in FRAGMENTS[1:]:
            found = F.when(F.length(run) >= n, _pieces(run, n)).otherwise(found)
        return found

    return F.array_distinct(F.flatten(F.transform(runs, longest)))


def log_fields(line: Column) -> Column:
    """Fields of a log line in either of the two formats, null where a field is absent.

    `[name|   LEVEL|time|module]: message` for the tool, `[time]: message` for a child process.
    """
    plain = F.regexp_replace(line, _COLOUR, "")
    # The two layouts of a line.
    full = r"^\[([^|\]]+)\|\s*(\w+)\|(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\|([^\]]+)\]: (.*)$"
    short = r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\]: (.*)$"
    is_full, is_short = plain.rlike(full), plain.rlike(short)
    time = F.when(is_full, F.regexp_extract(plain, full, 3)).when(
        is_short, F.regexp_extract(plain, short, 1)
    )
    message = (
        F.when(is_full, F.regexp_extract(plain, full, 5))
        .when(is_short, F.regexp_extract(plain, short, 2))
        .otherwise(plain)
    )
    return F.struct(
        F.when(is_full, F.regexp_extract(plain, full, 1)).alias("logger"),
        F.when(is_full, F.regexp_extract(plain, full, 2)).alias("level"),
        F.try_to_timestamp(time, F.lit("yyyy-MM-dd HH:mm:ss")).alias("logged_at"),
        F.when(is_full, F.regexp_extract(plain, full, 4)).alias("module"),
        message.alias("message"),
    )
