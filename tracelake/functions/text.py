"""Text, path, GUID, command-line and encoding functions, all as column expressions.

``fold`` is Spark's ``lower``, for patterns in texts of any length; it differs from full Unicode folding only for
letters that fold to several or to another letter's lower case, such as the German sharp s. ``casefold`` is full folding, for
names and other short values that are compared as a whole.
"""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of a missing identity.
MISSING_IDENTITY = ("", "-", "unknown")
#: Addresses that name no remote source.
LOCAL_ADDRESSES = ("0.0.0.0", "::", "127.0.0.1", "::1")
#: Start of a remote or inline-script argument.
SCRIPT_SCHEMES = ("http://", "https://", "javascript:", "vbscript:")

_BACKSLASH = "\\"


@functools.cache
def _foldings() -> tuple[str, str, dict[str, str]]:
    """(letters that fold to one, what they fold to, those that fold to several), of all of Unicode but surrogates."""
    folded = {chr(i): chr(i).casefold() for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and chr(i).casefold() != chr(i)}
    one = {a: b for a, b in folded.items() if len(b) == 1}
    return "".join(one), "".join(one.values()), {a: b for a, b in folded.items() if len(b) > 1}


def fold(c: Column) -> Column:
    return F.lower(c)


def casefold(c: Column) -> Column:
    """c as it is compared without case."""
    letters, to, growing = _foldings()
    pairs = F.split(F.lit(" ".join(a + b for a, b in growing.items())), " ")
    grown = F.aggregate(pairs, c, lambda t, x: F.replace(t, F.substring(x, 1, 1), F.substring(x, 2, 3)))
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(grown, letters, to))  # ASCII alone is lowered


def basename(path: Column) -> Column:
    """The last component of a path with slashes of either kind."""
    return F.substring_index(F.translate(path, "/", _BACKSLASH), _BACKSLASH, -1)


def qualified_user(domain: Column, user: Column) -> Column:
    return F.concat(domain, F.lit(_BACKSLASH), user)


def user_part(name: Column) -> Column:
    """A name without its domain."""
    return F.substring_index(name, _BACKSLASH, -1)


def guid(c: Column) -> Column:
    """A GUID in lower case with hyphens and no braces; null if malformed or all zero."""
    digits = F.lower(F.regexp_replace(F.trim(c), r"[{}\-]", ""))
    spelled = F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(digits.rlike("^[0-9a-f]{32}$") & ~digits.rlike("^0{32}$"), spelled)


def tokens(command: Column) -> Column:
    """A command line split at blanks outside quotes, quotes kept; null if a quote is left open."""
    pattern = r"""("[^"]*"|'[^']*'|[^ \t\r\n"'][^ \t\r\n]*)"""
    rest = F.regexp_replace(command, pattern, "")
    return F.when(~rest.rlike("[\"']"), F.regexp_extract_all(command, F.lit(pattern), F.lit(1)))


def risk_marker(image: Column, command: Column) -> Column:
    """Why a process start deserves review, or null: mshta with a remote or inline script, PowerShell with an encoded command."""
    name, parts = fold(basename(image)), F.transform(tokens(command), fold)
    bare = F.transform(parts, lambda t: F.regexp_replace(t, "^[\"']+|[\"']+$", ""))
    remote = F.exists(bare, lambda t: F.array_contains(F.array(*[F.lit(True) & t.startswith(s) for s in SCRIPT_SCHEMES]), True))
    place = lambda words: F.array_min(F.filter(F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.array_position(parts, w)), lambda p: p > 0))
    encoded, script = place(["-enc", "-encodedcommand"]), place(["-file", "-f", "-command", "-c"])
    return F.when((name == "mshta.exe") & remote, F.lit("mshta remote or inline script")).when(
        name.isin("powershell.exe", "pwsh.exe") & encoded.isNotNull() & (script.isNull() | (encoded < script)), F.lit("powershell encoded command")
    )


def creates_task(image: Column, command: Column) -> Column:
    """Whether a process start is schtasks with /create and /tr."""
    parts = F.transform(tokens(command), fold)
    return F.coalesce((fold(basename(image)) == "schtasks.exe") & F.array_contains(parts, "/create") & F.array_contains(parts, "/tr"), F.lit(False))


def strict_base64(c: Column) -> Column:
    """The decoded bytes, or null if the text isn't Base64."""
    return F.try_to_binary(c, F.lit("base64"))


def utf16le(b: Column) -> Column:
    """UTF-16LE text, or null for an odd number of bytes or unpaired surrogates."""
    units = F.hex(b)
    even = F.octet_length(b) % 2 == 0
    # In little-endian hex, the second byte of a surrogate is D8-DB (high) or DC-DF (low).
    paired = F.regexp_replace(F.regexp_replace(units, "(....)", "$1 "), "..D[89AB] ..D[C-F] ", "")
    return F.when(even & ~paired.rlike("..D[89A-F] "), F.decode(F.when(even & ~paired.rlike("..D[89A-F] "), b), "UTF-16LE"))


def encoded_command(command: Column, most: int = 262144) -> Column:
    """struct(script, sha256, error) of a PowerShell command line with an encoded argument. Nothing is run."""
    parts = tokens(command)
    low = F.transform(parts, fold)
    at = lambda words: F.array_min(F.filter(F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.array_position(low, w)), lambda p: p > 1))
    encoded, script = at(["-enc", "-encodedcommand"]), at(["-file", "-f", "-command", "-c"])
    argument = F.regexp_replace(F.get(parts, F.coalesce(encoded, F.lit(0)).cast("int")), '^"+|"+$', "")
    raw = strict_base64(argument)
    text = utf16le(raw)
    program = fold(basename(F.regexp_replace(F.get(parts, F.lit(0)), '^"+|"+$', "")))
    error = (
        F.when(parts.isNull(), F.lit("unbalanced command quoting"))
        .when(program.isNull() | ~program.isin("powershell.exe", "pwsh.exe"), F.lit("expected a PowerShell executable"))
        .when(encoded.isNull() | (F.coalesce(script, F.lit(1 << 30)) < encoded), F.lit("no supported encoded host argument"))
        .when(argument.isNull(), F.lit("missing encoded argument"))
        .when(F.length(argument) > 4 * ((most + 2) // 3), F.lit("encoded input exceeds limit"))
        .when(raw.isNull() | text.isNull(), F.lit("invalid Base64 / UTF-16LE argument"))
    )
    return F.struct(F.when(error.isNull(), text).alias("script"), F.when(error.isNull(), F.sha2(raw, 256)).alias("sha256"), error.alias("error"))


def csv_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def html_text(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def longest_label(host: Column) -> Column:
    """The longest label of a host name, the first of equally long ones."""
    labels = F.split(host, r"\.")
    return F.aggregate(labels, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def entropy(c: Column) -> Column:
    """Bits a character, from the counts of distinct characters."""
    chars = F.split(c, "")
    n = F.size(chars).cast("double")
    share = lambda x: F.size(F.filter(chars, lambda y: y == x)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda sum_, x: sum_ - share(x) * F.log2(share(x)))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))
