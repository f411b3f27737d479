"""Predicates over requests ``(max_tokens, n_messages, has_tools, system_text, user_text)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import strip


def _lower(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def is_quota_check() -> Column:
    return (F.col("max_tokens") == 1) & (F.col("n_messages") == 1) & _lower("user_text").contains("quota")


def is_prefix_detection() -> Column:
    return (F.col("n_messages") == 1) & F.col("user_text").contains("<policy_spec>") & F.col("user_text").contains("Command:")


def is_title_generation() -> Column:
    s = _lower("system_text")
    asked = s.contains("sentence-case title") | (s.contains("return json") & s.contains("field") & (s.contains("coding session") | s.contains("this session")))
    return (s != "") & ~F.col("has_tools") & s.contains("title") & asked


def is_suggestion_mode() -> Column:
    return F.col("user_text").contains("[SUGGESTION MODE:")


def is_filepath_extraction() -> Column:
    text, s = F.col("user_text"), _lower("system_text")
    asked = _lower("user_text").contains("filepaths") | s.contains("extract any file paths") | s.contains("file paths that this command")
    after = F.substring(text, F.locate("Command:", text) + 8, F.length(text))
    return (F.col("n_messages") == 1) & ~F.col("has_tools") & text.contains("Command:") & after.contains("Output:") & asked


def last_command() -> Column:
    """What follows the last ``Command:``."""
    return strip(F.substring_index("user_text", "Command:", -1))


def command_and_output() -> Column:
    """struct(command, output) around the first ``Output:`` after the first ``Command:``; output ends at ``<`` or a blank line."""
    text = F.col("user_text")
    after = F.substring(text, F.locate("Command:", text) + 8, F.length(text))
    rest = strip(F.substring(after, F.locate("Output:", after) + 7, F.length(after)))
    output = strip(F.substring_index(strip(F.substring_index(rest, "<", 1)), "\n\n", 1))
    return F.struct(strip(F.substring_index(after, "Output:", 1)).alias("command"), output.alias("output"))


#: Rules in order; the first that holds wins.
RULES = {
    "quota": is_quota_check,
    "prefix": is_prefix_detection,
    "title": is_title_generation,
    "suggestion": is_suggestion_mode,
    "filepaths": is_filepath_extraction,
}


def route(requests: DataFrame) -> DataFrame:
    """``requests`` with ``rule`` (null: none), and ``command`` and ``output`` of the rules that have them."""
    rule = F.coalesce(*[F.when(test(), F.lit(name)) for name, test in RULES.items()])
    out = requests.withColumn("rule", rule).withColumn("__parts", command_and_output())
    is_paths = F.col("rule") == "filepaths"
    command = F.when(F.col("rule") == "prefix", last_command()).when(is_paths, F.col("__parts.command"))
    return out.withColumn("command", command).withColumn("output", F.when(is_paths, F.col("__parts.output"))).drop("__parts")
