"""Parsers of tool output: linters, compilers, test runners, commands, pages."""

from __future__ import annotations

import ast
import re
import shlex
from collections import Counter
from collections.abc import Iterator
from html import unescape
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "linter, rule_id, file, line, column, message"
RUFF = "array<struct<code:string,filename:string,message:string,location:struct<row:int,column:int>>>"
ESLINT = "array<struct<filePath:string,messages:array<struct<ruleId:string,line:int,column:int,message:string>>>>"
CARGO = "struct<reason:string,message:struct<level:string,message:string,rendered:string,code:struct<code:string>,spans:array<struct<is_primary:boolean,file_name:string,line_start:int>>>>"


def _lines(reports: DataFrame) -> DataFrame:
    return reports.select("report_id", F.posexplode(F.split("text", "\r?\n")).alias("n", "value"))


def ruff(reports: DataFrame) -> DataFrame:
    """(report_id, rule_id, file, line, column, message) of ``reports(report_id, text)`` with a JSON array; other text gives nothing."""
    items = reports.select("report_id", F.posexplode(F.from_json("text", RUFF)).alias("n", "x"))
    return items.select("report_id", F.coalesce("x.code", F.lit("")).alias("rule_id"), F.coalesce("x.filename", F.lit("")).alias("file"), F.col("x.location.row").alias("line"), F.col("x.location.column").alias("column"), F.coalesce("x.message", F.lit("")).alias("message"))


def eslint(reports: DataFrame) -> DataFrame:
    """Like ``ruff``, for an array of files with messages; a missing rule is ``unknown``."""
    files = reports.select("report_id", F.explode(F.from_json("text", ESLINT)).alias("f"))
    items = files.select("report_id", F.coalesce("f.filePath", F.lit("")).alias("file"), F.explode("f.messages").alias("x"))
    return items.select("report_id", F.coalesce(F.nullif("x.ruleId", F.lit("")), F.lit("unknown")).alias("rule_id"), "file", "x.line", "x.column", F.coalesce("x.message", F.lit("")).alias("message"))


def _split_at(mark: str) -> tuple[Column, Column]:
    """What a line has before and after the first ``mark``; the latter is null where there is none."""
    parts = F.split("value", re.escape(mark), 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def tsc(reports: DataFrame) -> DataFrame:
    """(report_id, n, file, line, code, summary) of lines ``file(line,column): error TSn: message``."""
    place, said = _split_at("): error ")
    spot = F.split(F.substring_index(place, "(", -1), ",")
    file, code = F.left(place, F.length(place) - F.length(F.array_join(spot, ",")) - 1), F.substring_index(said, ":", 1)
    number = lambda i: F.get(spot, F.lit(i)).try_cast("int")
    sound = said.isNotNull() & (F.size(spot) == 2) & number(0).isNotNull() & number(1).isNotNull() & code.rlike("^TS[0-9]+$") & file.rlike("^[^ \t(]")
    return _lines(reports).where(sound).select("report_id", "n", file.alias("file"), number(0).alias("line"), code.alias("code"), F.trim(F.right(said, F.length(said) - F.length(code) - 1)).alias("summary"))


def mypy(reports: DataFrame) -> DataFrame:
    """(report_id, n, file, line, code, summary) of lines ``file:line[:column]: error: message  [code]``; notes are dropped, a missing code is null."""
    place, said = _split_at(": error: ")
    spot, tail = F.split(place, ":"), r"\s*\[([A-Za-z0-9_-]+)\]\s*$"
    numbers = F.slice(spot, 2, 2)
    sound = said.isNotNull() & F.size(spot).between(2, 3) & (spot[0] != "") & F.forall(numbers, lambda x: x.rlike("^[0-9]+$"))
    return _lines(reports).where(sound).select("report_id", "n", spot[0].alias("file"), F.get(spot, F.lit(1)).try_cast("int").alias("line"), F.nullif(F.regexp_extract(said, tail, 1), F.lit("")).alias("code"), F.trim(F.regexp_replace(said, tail, "")).alias("summary"))


def cargo(reports: DataFrame) -> DataFrame:
    """(report_id, n, file, line, code, summary) of compiler errors in JSON lines, placed at their first primary span."""
    rows = _lines(reports).where(F.trim("value").startswith("{")).select("report_id", "n", F.from_json(F.trim("value"), CARGO).alias("x"))
    rows = rows.where((F.col("x.reason") == "compiler-message") & (F.col("x.message.level") == "error"))
    span = F.get(F.filter(F.coalesce("x.message.spans", F.array().cast("array<struct<is_primary:boolean,file_name:string,line_start:int>>")), lambda s: s["is_primary"]), F.lit(0))
    return rows.select("report_id", "n", span["file_name"].alias("file"), span["line_start"].alias("line"), F.col("x.message.code.code").alias("code"), F.trim(F.coalesce("x.message.message", F.lit(""))).alias("summary"))


def _count(text: Column, word: str) -> Column:
    return F.regexp_extract(text, rf"=+ .*?(\d+) {word}.* in [\d.]+s", 1).try_cast("int")


def test_summary(reports: DataFrame) -> DataFrame:
    """(report_id, passed, failed, skipped, duration) from a test run's last line; null where it does not tell, but no failures if only passes are told."""
    passed, failed = _count(F.col("text"), "passed"), _count(F.col("text"), "failed")
    return reports.select(
        "report_id",
        passed.alias("passed"),
        F.coalesce(failed, F.when(passed.isNotNull(), 0)).alias("failed"),
        _count(F.col("text"), "skipped").alias("skipped"),
        F.regexp_extract("text", r"=+ .* in ([\d.]+)s", 1).try_cast("double").alias("duration"),
    )


def test_failures(reports: DataFrame) -> DataFrame:
    """(report_id, test_id, file, line, summary) of the blocks between the failures and summary marks.

    A test's summary is that of its FAILED line, else the last line of its block.
    """
    begin, end = "= FAILURES =", "= short test summary info ="
    has = F.col("text").contains(begin) & F.col("text").contains(end)
    section = F.substring_index(F.expr(f"substring(text, instr(text, '{begin}'))"), end, 1)
    parts = reports.where(has).select("report_id", "text", F.posexplode(F.slice(F.split(section, r"(?m)^_+ (?=[\w.\-:\[\]]+ _+$)"), 2, 1 << 30)).alias("n", "part"))
    name = F.regexp_extract("part", r"^([\w.\-:\[\]]+) _+", 1)
    body = F.regexp_replace(F.expr("substring(part, instr(part, '\n') + 1)"), r"^\s+|\s+$|\s*\n=+$", "")
    rows = parts.select("report_id", "text", "n", name.alias("test_id"), F.regexp_replace(body, r"\s*\n?=+\s*$", "").alias("body"))
    failed = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^FAILED (\S+)(?:\s+-\s+.*)?$"), F.lit(0)), lambda s: F.struct(F.regexp_extract(s, r"^FAILED (\S+)", 1).alias("id"), F.regexp_extract(s, r"^FAILED \S+\s+-\s+(.*)$", 1).alias("summary")))
    told = F.element_at(F.filter(failed, lambda s: s["id"] == F.col("test_id")), -1)
    place = r"(?m)^([^\s:]+):(\d+):"
    last = F.element_at(F.split("body", "\n"), -1)
    return rows.withColumn("told", F.when(F.exists(failed, lambda s: s["id"] == F.col("test_id")), told["summary"])).select(
        "report_id", "test_id", F.nullif(F.regexp_extract("body", place, 1), F.lit("")).alias("file"), F.regexp_extract("body", place, 2).try_cast("int").alias("line"), F.coalesce(F.trim("told"), last).alias("summary")
    )


#: Comments, declarations, and tags with their attributes.
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL)
#: Elements whose inside holds no tags but their own end.
_RAW = ("script", "style")
HIDDEN = ("script", "style", "noscript")


def page_texts(html: str) -> Iterator[tuple[str, Counter]]:
    """The texts between a page's tags, blanks collapsed, each with the number of open elements by tag."""
    around: Counter = Counter()
    at = 0
    while at <= len(html):
        found = _MARKUP.search(html, at)
        text = " ".join(unescape(html[at : found.start() if found else len(html)]).split())
        if text:
            yield text, around
        if not found:
            return
        at, tag = found.end(), (found["tag"] or "").lower()
        if found["end"]:
            around[tag] = max(0, around[tag] - 1)
        elif tag:
            around[tag] += 1
            if tag in _RAW:
                close = re.compile(rf"</{tag}\b", re.IGNORECASE).search(html, at)
                at = close.start() if close else len(html)


def page_text(html: str, most: int = 24_000) -> tuple[str, str]:
    """(title, visible text) of a page: a line for each text outside scripts, styles and noscript parts, at most ``most`` characters."""
    shown: dict[bool, list[str]] = {True: [], False: []}
    for text, around in page_texts(html):
        titled = around["title"] > 0
        if titled or not any(around[tag] for tag in HIDDEN):
            shown[titled].append(text)
    return " ".join(shown[True]), "\n".join(shown[False])[:most]


#: An anchor's attributes and what stands up to its end or the next anchor; and the address among the attributes.
_ANCHOR = re.compile(r"""<a\b((?:[^>"']|"[^"]*"|'[^']*')*)>(.*?)(?=</a\b|<a\b|\Z)""", re.DOTALL | re.IGNORECASE)
_ADDRESS = re.compile(r"""\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)


def result_links(html: str, most: int = 10) -> list[tuple[str, str]]:
    """The first ``most`` (url, title) of links whose address carries its target as ``uddg``; of a URL's titles the first that is not blank."""
    titles: dict[str, str] = {}
    for attributes, inside in _ANCHOR.findall(html):
        address = _ADDRESS.search(attributes)
        query = parse_qs(urlsplit(unescape(address[1].strip("\"'"))).query) if address else {}
        title = " ".join(unescape(_MARKUP.sub("", inside)).split())
        if title and query.get("uddg"):
            titles.setdefault(unquote(query["uddg"][0]), title)
    return list(titles.items())[:most]


#: Commands whose second word belongs to the prefix; commands that list files, and that read them; options of grep with an argument, and those of them that give the pattern.
TWO_WORDS = ("git", "npm", "docker", "kubectl", "cargo", "go", "pip", "yarn")
LISTING = ("ls", "dir", "find", "tree", "pwd", "cd", "mkdir", "rmdir", "rm")
READING = ("cat", "head", "tail", "less", "more", "bat", "type")
GREP_ARGUMENT, GREP_PATTERN = ("-e", "-f", "-m", "-A", "-B", "-C"), ("-e", "-f")
_ASSIGNMENT = re.compile(r"[A-Za-z_]\w*=", re.ASCII)


def _command(command: str) -> tuple[list[str], list[str], bool]:
    """(leading assignments, words behind them, whether its quotes are closed); words keep their quotes."""
    try:
        words, closed = shlex.split(command, posix=False), True
    except ValueError:
        words, closed = command.split(), False
    n = next((i for i, w in enumerate(words) if not _ASSIGNMENT.match(w)), len(words))
    return words[:n], words[n:], closed


def command_prefix(command: str) -> str:
    """What a shell command runs: a word, or two of some tools; ``command_injection_detected`` for substitutions, ``none`` for nothing.

    Assignments stand before it unless the tool is one of ``TWO_WORDS`` with a second word.
    """
    if "`" in command or "$(" in command:
        return "command_injection_detected"
    assigned, words, closed = _command(command)
    if not words:
        return "none"
    if closed and words[0] in TWO_WORDS and len(words) > 1:
        return words[0] if words[1].startswith("-") else " ".join(words[:2])
    return " ".join([*assigned, words[0]] if closed else words[:1])


def command_paths(command: str) -> list[str]:
    """Files that a command reads, as written: the arguments of reading commands, and of grep those that are no pattern; none of others, or if a quote is not closed."""
    _, words, closed = _command(command)
    name = re.split(r"[/\\]", words[0])[-1].lower() if words and closed else ""
    if name in READING:
        return [w for w in words[1:] if not w.startswith("-")]
    if name != "grep":
        return []
    taken = [before in GREP_ARGUMENT for before in words[:-1]]
    # An option's argument is no option itself, so the one behind it is free again.
    for i in range(1, len(taken)):
        taken[i] = taken[i] and not taken[i - 1]
    rest = [(w, t) for w, t in zip(words[1:], taken)]
    plain = [w for w, t in rest if not t and not w.startswith("-")]
    given = any(w in GREP_PATTERN and not t for w, t in rest)
    return plain if given else plain[1:]


def python_imports(source: str) -> list[tuple[str, int, bool]]:
    """(module or name, line, relative) of each imported name; none for what does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(a.name, node.lineno, False) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            out += [(base if a.name == "*" else f"{base}{'' if base.endswith('.') or not base else '.'}{a.name}", node.lineno, node.level > 0) for a in node.names]
    return sorted(out, key=lambda r: r[1])


def python_tags(source: str) -> list[tuple[str, str, int]]:
    """(name, def or ref, line from 0): classes, functions and module constants; called names."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in tree.body:
        if isinstance(node, ast.Assign):
            out += [(t.id, "def", node.lineno - 1) for t in node.targets if isinstance(t, ast.Name)]
    for node in ast.walk(tree):
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((node.name, "def", node.lineno - 1))
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                out.append((name, "ref", node.lineno - 1))
    return sorted(out, key=lambda r: (r[2], r[0], r[1]))
