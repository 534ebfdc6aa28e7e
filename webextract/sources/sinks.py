"""Where results go: records as JSON, single properties, Markdown."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webextract.operators.markdown import to_markdown
from webextract.plans.extract import CONTRACT, to_contract_json

#: Property names, in lower case, and the columns that they are.
PROPERTIES = {CONTRACT.get(c, c).lower(): c for c in ("title", "description", "domain", "favicon", "image", "published", "author", "site", "word_count", "content", "content_markdown", "extractor_type", "meta_tags", "schema_org_data")} | {"parsetime": "parse_time"}


class PropertyNotFound(KeyError):
    pass


def property_of(record: dict, name: str) -> str:
    """One property of a record as text; lists as JSON, an absent schema.org payload as null."""
    column = PROPERTIES.get(name.lower())
    if column is None:
        raise PropertyNotFound(name)
    value = record.get(column)
    if column == "schema_org_data":
        return value or "null"
    if column == "meta_tags":
        return json.dumps(value, ensure_ascii=False)
    if value in (None, ""):
        raise PropertyNotFound(name)
    return str(value)


def property_column(name: str) -> Column:
    """The same of a table of results; null where a page lacks it."""
    column = PROPERTIES.get(name.lower())
    if column is None or column == "parse_time":
        raise PropertyNotFound(name)
    if column == "schema_org_data":
        return F.coalesce(column, F.lit("null"))
    if column == "meta_tags":
        return F.to_json(column)
    return F.when(F.col(column).cast("string") != "", F.col(column).cast("string"))


def contract(record: dict) -> str:
    """A record as JSON in the public field names, without what is absent."""
    out = {CONTRACT.get(k, k): v for k, v in record.items() if k != "error" and v is not None}
    if "schemaOrgData" in out:
        out["schemaOrgData"] = json.loads(out["schemaOrgData"])
    if "parse_time" in out:
        out["parseTime"] = out.pop("parse_time")
    return json.dumps(out, ensure_ascii=False, indent=2)


def markdown_of(record: dict) -> str:
    """The record's Markdown, else made from its content, else the content."""
    if record.get("content_markdown"):
        return record["content_markdown"]
    return to_markdown(record["content"]) or record["content"]


def write_text(text: str, path: str = "") -> None:
    """To a file that only its owner can read and write, or to standard output."""
    if not path:
        print(text)
        return
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        f.write(text)


def write_json(results: DataFrame, path: str) -> None:
    to_contract_json(results).select("json").write.text(path)
