"""JSON: completeness, repair, schemas, redaction."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of key names whose values are secret.
SECRET_KEYS = ("api_key", "apikey", "authorization", "token", "secret", "password", "cookie")


def complete_object(text: Column) -> Column:
    """The text if it is one JSON object, else null."""
    return F.when(F.try_parse_json(text).isNotNull() & F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)


def repaired(prefix: Column, candidates: Column) -> Column:
    """The first of ``candidates`` that completes ``prefix`` to a JSON object; null if none does."""
    return F.get(F.filter(candidates, lambda c: complete_object(F.concat(prefix, c)).isNotNull()), F.lit(0))


def session_id(event: Column) -> Column:
    """The session id of an event, under the first key that has one."""
    paths = ("$.session_id", "$.sessionId", "$.init.session_id", "$.system.session_id", "$.result.session_id", "$.metadata.session_id", "$.conversation.id")
    return F.coalesce(*[F.get_json_object(event, p) for p in paths])


def judge(text: Column) -> Column:
    """struct(faithfulness, conciseness, risk_callout, note, error) of a judge's answer: the first to the last brace as JSON, notes cut at 120 characters."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, "faithfulness string, conciseness string, risk_callout string, note string")
    axes = [parsed[a].try_cast("int") for a in ("faithfulness", "conciseness", "risk_callout")]
    bad = axes[0].isNull() | axes[1].isNull() | axes[2].isNull()
    error = F.when(body == "", "no_json").when(F.try_parse_json(body).isNull(), "bad_json").when(bad, "bad_axes")
    return F.struct(*[F.when(error.isNull(), a).alias(n) for a, n in zip(axes, ("faithfulness", "conciseness", "risk_callout"))], F.left(F.coalesce(parsed["note"], F.lit("")), F.lit(120)).alias("note"), error.alias("error"))


def redact(value: object) -> object:
    """``value`` with values of secret keys replaced, at any depth."""
    if isinstance(value, dict):
        return {k: "<redacted>" if any(s in k.lower() for s in SECRET_KEYS) else redact(v) for k, v in value.items()}
    return [redact(v) for v in value] if isinstance(value, list) else value


def redact_json(text: str | None) -> str | None:
    """A JSON text redacted, compact, keys in order; other text as it is."""
    try:
        return json.dumps(redact(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False) if text is not None else None
    except ValueError:
        return text


def without_boolean_schemas(schema: object) -> object:
    """A JSON schema without boolean subschemas."""
    if isinstance(schema, dict):
        return {k: without_boolean_schemas(v) for k, v in schema.items() if not isinstance(v, bool) or k in ("default", "const", "nullable", "deprecated", "uniqueItems")}
    return [without_boolean_schemas(v) for v in schema if not isinstance(v, bool)] if isinstance(schema, list) else schema


def fits_schema(schema: dict | None, value: object) -> bool:
    """Whether an object has the required keys, and its values the types, of a schema; an unknown schema accepts anything."""
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
    if not isinstance(schema, dict) or not isinstance(value, dict):
        return not isinstance(schema, dict)
    if any(k not in value for k in schema.get("required", ())):
        return False
    for key, sub in (schema.get("properties") or {}).items():
        kind = sub.get("type") if isinstance(sub, dict) else None
        if key in value and kind in kinds and (not isinstance(value[key], kinds[kind]) or kind in ("integer", "number") and isinstance(value[key], bool)):
            return False
    return True


def alias_parameters(names: list[str], reserved: tuple[str, ...] = ()) -> dict[str, str]:
    """A distinct alias for each of ``names`` that is reserved; aliases collide with no name."""
    taken, out = set(names), {}
    for name in names:
        if name in reserved:
            alias, n = f"{name}_arg", 1
            while alias in taken:
                n += 1
                alias = f"{name}_arg{n}"
            taken.add(alias)
            out[name] = alias
    return out


def deep_merge(base: dict, override: dict) -> dict:
    """``base`` with ``override``; objects are merged at every depth, other values replaced."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in override.items()}
