"""Calls of a language-model endpoint through a client that the caller gives, with bounded retries.

A client is a function (model, messages, timeout) -> (content, usage dict) that raises
ModelError, TimeoutError or OSError. No request is made by this library itself.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes, attempts and time limit.
CODES = ("AUTH", "MODEL_NOT_FOUND", "RATE_LIMITED", "PROVIDER_ERROR", "NETWORK", "EMPTY_RESPONSE", "INVALID_OUTPUT", "MISSING_ENV", "UNKNOWN")
TRANSIENT = ("NETWORK", "PROVIDER_ERROR")
RETRIES, TIMEOUT_MS = 2, 180_000
DEEPEST_CAUSE = 8


class ModelError(Exception):
    def __init__(self, code: str, message: str = "", retry_after: float | None = None):
        super().__init__(message or code)
        self.code, self.retry_after = code, retry_after


@dataclass(frozen=True)
class Settings:
    base_url: str
    api_key: str
    text_model: str
    vision_model: str
    timeout_ms: int = TIMEOUT_MS

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env

        def need(name: str) -> str:
            if not env.get(name):
                raise ModelError("MISSING_ENV", f"{name} is not set")
            return env[name]

        raw = env.get("LLM_REQUEST_TIMEOUT_MS", "")
        return cls(need("LLM_BASE_URL"), need("LLM_API_KEY"), need("LLM_MODEL"), need("LLM_VISION_MODEL"), int(raw) if raw.isdigit() and int(raw) > 0 else TIMEOUT_MS)


def code_of_status(status: Column) -> Column:
    """The error code of an HTTP status; null is a failure of the network."""
    return F.when(status.isNull(), "NETWORK").when(status.isin(401, 403), "AUTH").when(status == 404, "MODEL_NOT_FOUND").when(status == 429, "RATE_LIMITED").when(status.between(500, 599), "PROVIDER_ERROR").otherwise("UNKNOWN")


def error_code(error: BaseException | None) -> str | None:
    """The code of the nearest ModelError among an error and its causes."""
    for _ in range(DEEPEST_CAUSE):
        if error is None:
            return None
        if isinstance(error, ModelError):
            return error.code
        error = error.__cause__
    return None


def user_content(prompt: str, image: str | None = None, mime: str | None = None):
    if not image:
        return prompt
    return [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": f"data:{mime or 'image/jpeg'};base64,{image}"}}]


def _unfenced(raw: str) -> str:
    body = raw.strip()
    if body.startswith("```") and body.endswith("```") and len(body) >= 6:
        body = body[3:-3].removeprefix("json").lstrip()
        return body.removesuffix("\n")
    return raw


# Names of types in a schema.
_TYPES = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}


def violations(value, schema: Mapping, at: str = "$") -> list[str]:
    """Where parsed JSON departs from a schema (type, enum, required, properties, items, minimum, maximum, minLength), as path: what."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    fits = lambda kind: isinstance(value, _TYPES[kind]) and (kind == "boolean" or not isinstance(value, bool))
    if kinds and not any(map(fits, kinds)):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = [f"{at}: not one of {schema['enum']}"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        out += [f"{at}.{name}: missing" for name in schema.get("required", ()) if name not in value]
        for name, inner in schema.get("properties", {}).items():
            out += violations(value[name], inner, f"{at}.{name}") if name in value else []
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: shorter than {schema['minLength']}")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: beyond {name} {schema[name]}" for name, bad in (("minimum", lambda b: value < b), ("maximum", lambda b: value > b)) if name in schema and bad(schema[name])]
    return out


def checker(check: Callable | Mapping | None) -> Callable | None:
    """A predicate on parsed JSON out of a schema; a predicate as it is."""
    return (lambda value: not violations(value, check)) if isinstance(check, Mapping) else check


def ask(client: Callable, model: str, prompt: str, image: str | None, mime: str | None, check: Callable | Mapping | None, retries: int = RETRIES, timeout_ms: int = TIMEOUT_MS) -> dict:
    """One answer: content, code, attempts, and usage summed over attempts (of the last one where nothing is checked)."""
    check = checker(check)
    total = {"prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0}
    code, content, attempts = "UNKNOWN", None, 0
    for attempts in range(1, retries + 2):
        try:
            content, usage = client(model, [{"role": "user", "content": user_content(prompt, image, mime)}], timeout_ms / 1000)
        except ModelError as error:
            code, content = error.code, None
        except (TimeoutError, OSError):
            code, content = "NETWORK", None
        else:
            total = {k: int((usage or {}).get(k, 0)) + (total[k] if check else 0) for k in total}
            if not content:
                code, content = "EMPTY_RESPONSE", None
                continue
            if check is None:
                code = None
                break
            try:
                value = json.loads(_unfenced(content))
            except ValueError:
                value = None
            if value is not None and check(value):
                code, content = None, json.dumps(value, ensure_ascii=False)
                break
            code, content = "INVALID_OUTPUT", None
            continue
        if code not in TRANSIENT:
            break
    return {"content": content, "error_code": code, "attempts": attempts} | total


SCHEMA = "id long, model string, content string, error_code string, attempts int, prompt_tokens long, completion_tokens long, total_tokens long"


def complete(rows: DataFrame, make_client: Callable[[], Callable], text_model: str, vision_model: str, check: Callable | Mapping | None = None, **options) -> DataFrame:
    """Rows (id, prompt, image, mime) to their answers. ``check`` (a schema, or a predicate on parsed JSON) makes it an extraction.

    One client a task; a task that is run again asks again, so ids serve as idempotency keys.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            out = []
            for r in batch.itertuples():
                image = r.image if isinstance(r.image, str) and r.image else None
                model = vision_model if image else text_model
                out.append({"id": r.id, "model": model} | ask(client, model, r.prompt, image, r.mime if isinstance(r.mime, str) else None, check, **options))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return rows.select("id", "prompt", "image", "mime").mapInPandas(run, SCHEMA)
