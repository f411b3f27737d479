"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terminal escape sequences, shell failure marks, error words, tools whose output is scanned for them.
ANSI = "\\x1b\\[[0-9;]*[A-Za-z]|\\x1b[A-Z]"
BASH_FAILURE = (r"(?i)<bash-stderr>", r"(?i)\bexit code:\s*([1-9]\d*)\b", r"(?i)\bexit status\s*([1-9]\d*)\b")
ERROR_WORDS = ("traceback", "error:", "enoent", "permission denied", "failed:", "fatal:", "command not found")
SCANNED_TOOLS = ("Bash", "WebFetch", "WebSearch")
#: Languages by file extension.
LANGUAGES = {
    "python": (".py",),
    "javascript": (".js", ".mjs", ".cjs", ".jsx"),
    "typescript": (".ts", ".tsx"),
    "go": (".go",),
    "rust": (".rs",),
    "java": (".java",),
    "ruby": (".rb",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"),
    "csharp": (".cs",),
    "swift": (".swift",),
}
#: Stop reasons of the chat format and their names in the block format.
STOP_REASONS = {"stop": "end_turn", "length": "max_tokens", "tool_calls": "tool_use", "content_filter": "end_turn"}


def mapped(key: Column, values: dict[str, str]) -> Column:
    """``values[key]``, null for other keys."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def strip(text: Column) -> Column:
    """Without whitespace at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def head_tail(text: Column, most: int, head: int, tail: int) -> Column:
    """A text of more than ``most`` lines becomes its first ``head`` and last ``tail`` lines with a marker between.

    The marker's count is lines - head - tail, also where that is not positive.
    """
    lines = F.split(text, "\n")
    n = F.size(lines)
    marker = F.concat(F.lit("\n... ["), (n - head - tail).cast("string"), F.lit(" lines omitted] ...\n"))
    last = F.slice(lines, F.greatest(n - tail + 1, F.lit(1)), F.lit(tail)) if tail else lines
    return F.when(n > most, F.concat(F.array_join(F.slice(lines, 1, head), "\n"), marker, F.array_join(last, "\n"))).otherwise(text)


def has_bash_failure(text: Column) -> Column:
    out = F.lit(False)
    for pattern in BASH_FAILURE:
        out = out | text.rlike(pattern)
    return out


def is_error(flag: Column, text: Column, tool: Column) -> Column:
    """Whether a tool result failed: its flag, a shell failure mark (Bash only), or an error word (some tools only)."""
    words = F.lit(False)
    for word in ERROR_WORDS:
        words = words | F.lower(text).contains(word)
    judged = ((tool == "Bash") & has_bash_failure(text)) | (tool.isin(*SCANNED_TOOLS) & words)
    return F.coalesce(flag, F.lit(False)) | F.coalesce(judged, F.lit(False))


def cap_bytes(text: Column, most: int) -> Column:
    """The first ``most`` bytes of UTF-8 with a marker, if there are more; a split character becomes U+FFFD."""
    raw = F.encode(text, "UTF-8")
    cut = F.make_valid_utf8(F.substring(raw, 1, most).cast("string"))
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit(f"\n... [truncated after {most} bytes]"))).otherwise(text)


def between_last(text: Column, opening: str, closing: str) -> Column:
    """What stands between the last ``opening`` and the first ``closing`` after it, stripped; null if either is missing."""
    rest = F.substring_index(text, opening, -1)
    found = text.contains(opening) & rest.contains(closing)
    return F.when(found, strip(F.substring_index(rest, closing, 1)))


def digest_tag(text: Column) -> Column:
    """The stripped content of the first digest tag; null if there is none or it is empty."""
    return F.nullif(strip(F.regexp_extract(text, r"(?s)<digest>\s*(.*?)\s*</digest>", 1)), F.lit(""))


def include_list(text: Column, most: int) -> Column:
    """The sorted distinct numbers 1 to ``most`` of a line ``INCLUDE: 1, 2``; NONE is empty; null if there is no such line or a part is no number."""
    body = strip(F.regexp_extract(text, r"(?im)^\s*INCLUDE:\s*(.*)$", 1))
    parts = F.filter(F.transform(F.split(body, ","), strip), lambda p: p != "")
    numbers = F.transform(parts, lambda p: p.try_cast("int"))
    bad = F.exists(numbers, lambda n: n.isNull())
    kept = F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= most))))
    return F.when(~text.rlike(r"(?im)^\s*INCLUDE:"), None).when(F.upper(body) == "NONE", F.array().cast("array<int>")).when(~bad, kept)


def preview(text: Column, n: int) -> Column:
    """The first ``n`` characters, with a count of those cut."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("... [+"), (F.length(text) - n).cast("string"), F.lit(" chars]"))).otherwise(text)


def language_of(path: Column) -> Column:
    """Language by the path's extension; null for others."""
    ends = {e: language for language, extensions in LANGUAGES.items() for e in extensions}
    return mapped(F.lower(F.regexp_extract(path, r"[^/.](\.[^./]*)$", 1)), ends)


def stop_reason(reason: Column) -> Column:
    return F.coalesce(mapped(reason, STOP_REASONS), F.lit("end_turn"))


def edge_multiplier(name: Column, definers: Column) -> Column:
    """Weight of an identifier: 10 for long snake, kebab or camel case, 0.1 for private, 0.1 for more than five definers."""
    letters = name.rlike(r"\p{L}")
    cased = (name.contains("_") & letters) | (name.contains("-") & letters) | (name.rlike(r"\p{Lu}") & name.rlike(r"\p{Ll}"))
    long = F.when(cased & (F.length(name) >= 8), F.lit(10.0)).otherwise(1.0)
    return long * F.when(name.startswith("_"), F.lit(0.1)).otherwise(1.0) * F.when(definers > 5, F.lit(0.1)).otherwise(1.0)


def gateway_parts(model: Column, prefix: str, no_thinking_prefix: str) -> Column:
    """struct(provider, model, force_thinking) of an advertised model id; null for other ids."""
    parts = F.split(model, "/", 3)
    head, provider, rest = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    force = F.when(head == no_thinking_prefix, F.lit(False))
    return F.when(head.isin(prefix, no_thinking_prefix) & (F.coalesce(rest, F.lit("")) != ""), F.struct(provider.alias("provider"), rest.alias("model"), force.alias("force_thinking")))


def tier_model(name: Column, opus: Column, haiku: Column, sonnet: Column, default: Column) -> Column:
    """The configured model of the tier in ``name``; the first configured tier in this order wins."""
    lower = F.lower(name)
    return F.coalesce(F.when(lower.contains("opus"), opus), F.when(lower.contains("haiku"), haiku), F.when(lower.contains("sonnet"), sonnet), default)


def error_kind(status: Column) -> Column:
    """Kind of an upstream HTTP error."""
    return (
        F.when(status.isin(401, 403), "authentication")
        .when(status == 429, "rate_limit")
        .when(status == 400, "invalid_request")
        .when(status.isin(502, 503, 504), "overloaded")
        .otherwise("api")
    )


def retryable(status: Column) -> Column:
    return (status == 429) | status.between(500, 599)


#: Where secrets stand in log lines, a bot's token in an address and a bearer token in a header.
BOT_TOKEN = r"(?i)(?<=https?://api\.telegram\.org/bot)[0-9]+:[A-Za-z0-9_-]+"
BEARER = r"""(?i)(\bAuthorization\s*:\s*Bearer\s+)[^\s'"]+"""


def redact(text: Column) -> Column:
    """Without bot tokens in addresses and bearer tokens in headers."""
    return F.regexp_replace(F.regexp_replace(text, BOT_TOKEN, "<redacted>"), BEARER, "$1<redacted>")


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def search_terms(query: Column) -> Column:
    """Quoted words of a query without operator characters, joined by spaces; \"\" if none is left."""
    words = F.filter(F.transform(F.split(strip(query), r"\s+"), lambda w: F.regexp_replace(w, r'["()*+\-:^]', "")), lambda w: w != "")
    return F.when(F.size(words) == 0, F.lit('""')).otherwise(F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " "))


def first_url(text: Column) -> Column:
    """The first URL, without closing punctuation."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"https?://\S+", 0), r"[).,\]]+$", ""), F.lit(""))


def query_text(text: Column) -> Column:
    """What follows ``query:``, else the whole text; stripped."""
    found = F.regexp_extract(text, r"(?is)query:\s*(.+)", 1)
    return strip(F.when(found != "", found).otherwise(text))


def escape_markdown(text: Column, characters: str) -> Column:
    """A backslash before each of ``characters``."""
    inside = "".join("\\" + c for c in characters)
    return F.regexp_replace(text, f"([{inside}])", r"\\$1")


def continuation(existing: Column, candidate: Column, most: int = 200) -> Column:
    """``candidate`` without the longest prefix (of at most ``most`` characters) that ends ``existing``."""
    sizes = F.sequence(F.lit(0), F.least(F.length(existing), F.length(candidate), F.lit(most)))
    overlap = F.array_max(F.filter(sizes, lambda n: existing.endswith(F.left(candidate, n))))
    return F.substring(candidate, overlap + 1, F.length(candidate))


def compact_json(text: Column) -> Column:
    """JSON rendered compactly; other text stripped."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), strip(text))
