"""JSON documents changed by pointer patches, with a gate that checks a patch before it is applied."""

from __future__ import annotations

import copy
import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F


class PatchError(ValueError):
    """A pointer or operation that does not fit the document."""


def _parts(pointer: str) -> list[str]:
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise PatchError(f"pointer must start with a slash: {pointer}")
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer[1:].split("/")]


def get(document, pointer: str):
    """The value at a pointer."""
    for part in _parts(pointer):
        if isinstance(document, list):
            if not part.isdigit() or int(part) >= len(document):
                raise PatchError(f"no such item: {part}")
            document = document[int(part)]
        elif isinstance(document, dict) and part in document:
            document = document[part]
        else:
            raise PatchError(f"no such member: {part}")
    return document


def apply(document, operations: list[dict]):
    """A changed copy of the document; ``add``, ``replace`` and ``remove``."""
    out = copy.deepcopy(document)
    for op in operations:
        parts = _parts(op["path"])
        if not parts:
            if op["op"] == "remove":
                raise PatchError("the whole document cannot be removed")
            out = copy.deepcopy(op["value"])
            continue
        parent, last = get(out, "/" + "/".join(p.replace("~", "~0").replace("/", "~1") for p in parts[:-1]) if parts[:-1] else ""), parts[-1]
        if isinstance(parent, list):
            end = last == "-" and op["op"] == "add"
            if not end and not last.isdigit():
                raise PatchError(f"no index: {last}")
            at = len(parent) if end else int(last)
            if at > len(parent) or op["op"] != "add" and at >= len(parent):
                raise PatchError(f"index out of range: {last}")
            if op["op"] == "add":
                parent.insert(at, copy.deepcopy(op["value"]))
            elif op["op"] == "replace":
                parent[at] = copy.deepcopy(op["value"])
            elif op["op"] == "remove":
                del parent[at]
            else:
                raise PatchError(f"unknown operation: {op['op']}")
        elif isinstance(parent, dict):
            if op["op"] in ("replace", "remove") and last not in parent:
                raise PatchError(f"no such member: {last}")
            if op["op"] == "remove":
                del parent[last]
            elif op["op"] in ("add", "replace"):
                parent[last] = copy.deepcopy(op["value"])
            else:
                raise PatchError(f"unknown operation: {op['op']}")
        else:
            raise PatchError("the pointer's parent holds nothing")
    return out


def check(document, operations) -> list[str]:
    """Codes of what is wrong with a patch; an ill-formed one is not looked at further."""
    if not isinstance(operations, list) or not all(isinstance(o, dict) and isinstance(o.get("path"), str) and o.get("op") in ("add", "replace", "remove") and ("value" in o or o["op"] == "remove") for o in operations):
        return ["FORM"]
    out = []
    known = {e.get("id") for e in document.get("evidence", [])} if isinstance(document, dict) else set()
    for o in operations:
        try:
            apply(document, [o])
        except PatchError:
            out.append("POINTER")
        value = o.get("value")
        if isinstance(value, dict) and value.get("evidence_id") is not None and value["evidence_id"] not in known:
            out.append("EVIDENCE")
        if isinstance(value, dict) and not value.get("source_ref") and o["op"] == "add":
            out.append("SOURCE")
    return sorted(set(out))


def apply_patches(df: DataFrame, document: str = "document", patch: str = "patch") -> DataFrame:
    """Adds ``patched`` (null where the patch fails) and ``findings`` to JSON texts and their patches."""

    @F.pandas_udf("patched string, findings array<string>")
    def run(docs: pd.Series, patches: pd.Series) -> pd.DataFrame:
        rows = []
        for d, p in zip(docs, patches):
            try:
                doc, ops = json.loads(d), json.loads(p)
            except (TypeError, ValueError):
                rows.append((None, ["JSON"]))
                continue
            found = check(doc, ops)
            rows.append((None if found else json.dumps(apply(doc, ops), sort_keys=True, ensure_ascii=False), found))
        return pd.DataFrame(rows, columns=["patched", "findings"])

    return df.withColumn("__r", run(document, patch)).select("*", "__r.*").drop("__r")
