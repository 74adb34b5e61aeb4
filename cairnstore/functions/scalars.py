"""Scalar column functions of the archive engine; all are Catalyst expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1 << 20
# The five modes with code, codec, level and whether groups are compressed apart.
MODES = {
    "fast": (0, "zstd", 3, False),
    "best": (1, "zstd", 19, False),
    "max": (2, "lzma2", 9, True),
    "ultra": (3, "lzma2", 9, False),
    "text": (4, "cm", 0, False),
}
# Transform codes.
TRANSFORMS = {"none": 0, "delta1": 1, "delta2": 2, "bcj_x86": 3, "delta3": 4, "delta4": 5, "med": 6, "rct_med": 7, "med_rows": 8, "rct_med_rows": 9}


def content_hash(content: Column) -> Column:
    """First 16 bytes of SHA-256, as lowercase hex."""
    return F.substring(F.sha2(content, 256), 1, 32)


def human_size(n: Column) -> Column:
    """`512 B`, `1.2 KB` and on up to PB; ties round to even."""
    x = n.cast("double")
    out = F.format_string("%.1f PB", F.bround(x / 1024.0**5, 1))
    for power, unit in reversed(list(enumerate(("KB", "MB", "GB", "TB"), 1))):
        out = F.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(x / 1024.0**power, 1))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def mode_string(mode: Column, kind: Column) -> Column:
    """`-rwxr-xr-x`, with d for directories and l for symbolic links."""
    head = F.when(kind == "dir", "d").when(kind == "symlink", "l").otherwise("-")
    bits = [F.when(mode.bitwiseAND(1 << (8 - i)) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)]
    return F.concat(head, *bits)


def mode_name(code: Column) -> Column:
    return reduce(lambda out, m: F.when(code == MODES[m][0], m).otherwise(out), MODES, F.lit("?"))


def safe_name(name: Column) -> Column:
    """False for empty and absolute names and for names with a `..` segment under either slash."""
    return (name != "") & ~name.startswith("/") & ~F.exists(F.split(name, r"[/\\]"), lambda s: s == "..")


def normalise_ask(ask: Column) -> Column:
    """Without leading `./`s, one leading `/` and trailing `/`s; at least one character stays."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(ask, r"^(\./)+", ""), "^/", ""), "(?<=.)/+$", "")


def base_name(name: Column) -> Column:
    return F.regexp_extract(name, "([^/]*)$", 1)


def match_entry(name: Column, ask: Column) -> Column:
    """Equal, equal base name, or below the directory that is asked for."""
    return (name == ask) | (base_name(name) == ask) | name.startswith(F.concat(ask, F.lit("/")))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def size_bucket(n: Column, unit: int = MIB) -> Column:
    """How many halvings bring ``n`` down to ``unit``, 40 at most."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(39)), lambda k: F.call_function("shiftright", n, k) > unit))


def dict_tier(n: Column) -> Column:
    return F.when(n < 4 * MIB, "2MiB").when(n < 16 * MIB, "4MiB").otherwise("16MiB")


def entry_nano(nano: Column, seconds: Column) -> Column:
    return F.coalesce(F.nullif(nano, F.lit(0)), F.nullif(seconds, F.lit(0)) * 1_000_000_000, F.lit(0))


def fits_old_time(nano: Column) -> Column:
    """Zero, or whole seconds within 32 unsigned bits."""
    seconds = F.floor(nano / 1_000_000_000)
    return (nano == 0) | ((nano % 1_000_000_000 == 0) & (seconds >= 0) & (seconds <= (1 << 32) - 1))


def ratio(part: Column, whole: Column) -> Column:
    """Per cent, null for an empty whole."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 2))


def stored_name(path: Column, root: str) -> Column:
    """Path under ``root``; the base name for paths elsewhere."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix) & (F.length(path) > len(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(base_name(path))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob: `*` and `?` stop at `/`; classes and escapes as in shells.

    A pattern that is not well formed matches nothing.
    """
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return "(?!)"
            out += re.escape(pattern[i])
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return "(?!)"
            body = pattern[i + 1 : end]
            body = "^" + body[1:] if body[0] in "^!" else body
            out += "[" + body.replace("[", "\\[").replace("&&", "&\\&") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^(?:{out})$"


def excluded(path: Column, globs: list[str], relative: Column | None = None) -> Column:
    """True if a glob matches the path, the relative path, any ancestor, or any single segment."""
    rules = [glob_regex(g) for g in globs if g]
    if not rules:
        return F.lit(False)
    rule = "|".join(rules)
    segments = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, 1, n), "/"))
    hit = F.exists(segments, lambda s: s.rlike(rule)) | F.exists(ancestors, lambda a: a.rlike(rule))
    return hit if relative is None else hit | relative.rlike(rule)


def overwrite_note(n: Column) -> Column:
    return F.when(n == 0, "").otherwise(F.concat(F.lit(" ("), n.cast("string"), F.lit(" overwritten)")))
