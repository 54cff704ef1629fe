"""Which captured requests are read-only queries that hold no one's data."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import policy
from .walks import each_text, loaded, policy_key

BODY_CHARS, QUERY_CHARS, DEPTH, NODES, MEMBERS, VALUE_CHARS = 64 * 1024, 48 * 1024, 8, 200, 50, 160
# The parts of a query's body, and what its arguments and variables may be.
PARTS = frozenset(("query", "variables", "operationName"))
NAME = re.compile(r"[_A-Za-z][_0-9A-Za-z]{0,127}")
HEAD = re.compile(r"query(?:\s+[_A-Za-z][_0-9A-Za-z]*)?\s*(?:\([^)]*\)\s*)?\{")
OTHERS = re.compile(r"\b(?:mutation|subscription)\b", re.I)
ARGUMENT = re.compile(r"(?<![$\w])[_A-Za-z][_0-9A-Za-z]*\s*:\s*([^\s,){]*)", re.A)
ARGUMENT_VALUE = re.compile(r"\$[_A-Za-z][_0-9A-Za-z]*|[0-9]{1,4}|true|false|null|[A-Za-z_][A-Za-z_]{0,31}")
CURSOR_NAME = re.compile("after|before|cursor|page_token|next_cursor")
FLAG_NAME = re.compile("include_(?:archived|deleted|inactive)|with_[a-z_]+")
COUNT_NAME = re.compile("first|last|limit|offset|page|page_size")
CHOICE_NAME, CHOICE = re.compile("status|type|sort|order|state|interval|period|currency"), re.compile("[a-z][a-z0-9_-]{0,31}", re.I)
TEMPLATE = re.compile(r"\{[A-Za-z_][A-Za-z0-9_]*\}")
SECRET = [re.compile(p) for p in (policy.SECRET_KEY, policy.SECRET_NAME)]
TENANT_NAME, TENANT_ID = re.compile(policy.TENANT_NAME.removesuffix("$")), re.compile(policy.TENANT_ID.removesuffix("$"))


def _is_open_text(name: str, value: str) -> bool:
    """Whether a text variable is a template, a tenant's id under a tenant's name, or a plain choice."""
    return len(value) <= VALUE_CHARS and bool(
        TEMPLATE.fullmatch(value) or TENANT_NAME.fullmatch(name) and TENANT_ID.fullmatch(value) or CHOICE_NAME.fullmatch(name) and CHOICE.fullmatch(value)
    )


def are_open(variables) -> bool:
    """Whether variables hold paging, choices and templates only; lists are never looked into. DEPTH levels and NODES values at most."""
    waiting, seen = [("", variables, 0)], 0
    while waiting:
        key, value, depth = waiting.pop()
        seen += 1
        name = policy_key(key)
        if depth > DEPTH or seen > NODES or key and any(p.search(name) for p in SECRET):
            return False
        if isinstance(value, dict):
            if len(value) > MEMBERS or not all(NAME.fullmatch(k) for k in value):
                return False
            waiting += [(k, x, depth + 1) for k, x in value.items()]
            continue
        good = (
            CURSOR_NAME.fullmatch(name) if value is None else FLAG_NAME.fullmatch(name) if isinstance(value, bool)
            else COUNT_NAME.fullmatch(name) and isinstance(value, int) and 0 <= value <= 500 if isinstance(value, (int, float)) else isinstance(value, str) and _is_open_text(name, value)
        )
        if not good:
            return False
    return True


def is_read_only(body: str) -> bool:
    """Whether a JSON body is one GraphQL query without literals, with open variables."""
    parts = loaded(body)
    if not isinstance(parts, dict) or not PARTS.issuperset(parts) or not isinstance(text := parts.get("query"), str) or len(text) > QUERY_CHARS:
        return False
    text = re.sub(r"#[^\r\n]*", " ", text).strip()
    if not HEAD.match(text) or OTHERS.search(text) or re.search("[\"']", text) or not all(ARGUMENT_VALUE.fullmatch(v) for v in ARGUMENT.findall(text)):
        return False
    name = parts.get("operationName", "q")
    return isinstance(name, str) and bool(NAME.fullmatch(name)) and ("variables" not in parts or are_open(parts["variables"]))


def read_only(method: Column, headers: Column, body: Column) -> Column:
    """Whether a request may be kept to be sent again: a POST with a JSON content type as its only header (array<struct<name,value>>) and a body
    that `is_read_only`. All else, null and what is no JSON is not."""
    only = F.get(headers, F.lit(0))
    plain = (method == "POST") & (F.size(headers) == 1) & (F.lower(only["name"]) == "content-type") & (
        F.lower(only["value"]) == "application/json"
    ) & (F.length(body) <= BODY_CHARS)
    return F.coalesce(each_text(is_read_only, pa.bool_(), "boolean")(F.when(plain, body)), F.lit(False))
