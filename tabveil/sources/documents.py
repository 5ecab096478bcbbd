"""JSON, YAML, XML and text documents: flattened into fields, and rewritten with the fields' released values."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabveil.operators import spans as S

#: Limits of a pasted document.
MOST_FIELDS, MOST_BYTES, MOST_SPANS = 512, 5 * 1024 * 1024, 10_000
Field = tuple[str, str, int, str, str]  # path, label, place in the path, value, kind
Rewrite = Callable[[str, str], str]  # (path, value) -> value


def escaped(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def _text(v: object) -> tuple[str, str]:
    if v is None:
        return "null", "null"
    if isinstance(v, bool):
        return ("true" if v else "false"), "boolean"
    return (v, "string") if isinstance(v, str) else (json.dumps(v), "number")


def value_fields(value: object, root: str = "json") -> list[Field]:
    """Depth first in document order; array places are left out of paths."""
    out: list[Field] = []
    seen: dict[str, int] = {}

    def walk(v: object, path: str, label: str) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                part = k if re.fullmatch(r"[\w-]+", k) else json.dumps(k, ensure_ascii=False)
                walk(x, f"{path}/k:{escaped(k)}", f"{label}.{part}" if label else part)
        elif isinstance(v, list):
            for x in v:
                walk(x, f"{path}/a", f"{label}[]")
        else:
            text, kind = _text(v)
            if path not in seen and len(seen) >= MOST_FIELDS:
                raise ValueError(f"more than {MOST_FIELDS} fields")
            out.append((path, label or "value", seen.setdefault(path, 0), text, kind))
            seen[path] += 1

    walk(value, root, "")
    return out


def retyped(old: object, text: str) -> object:
    """The released text as the scalar that it replaces, if it still reads as one."""
    if old is None:
        return None
    if isinstance(old, bool):
        return {"true": True, "false": False}.get(text, text)
    if isinstance(old, int):
        return int(text) if re.fullmatch(r"-?(?:0|[1-9][0-9]{0,18})", text) else text
    if isinstance(old, float):
        return float(text) if re.fullmatch(r"-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?", text) else text
    return text


def rewritten_value(value: object, rewrite: Rewrite, root: str = "json") -> object:
    def walk(v: object, path: str) -> object:
        if isinstance(v, dict):
            return {k: walk(x, f"{path}/k:{escaped(k)}") for k, x in v.items()}
        if isinstance(v, list):
            return [walk(x, f"{path}/a") for x in v]
        return None if v is None else retyped(v, rewrite(path, _text(v)[0]))

    return walk(value, root)


def json_fields(content: str) -> list[Field]:
    return value_fields(json.loads(content))


def yaml_fields(content: str) -> list[Field]:
    import yaml

    return value_fields(yaml.safe_load(content), "yaml")


def rewritten_json(content: str, rewrite: Rewrite) -> str:
    return json.dumps(rewritten_value(json.loads(content), rewrite), indent=2, ensure_ascii=False)


def rewritten_yaml(content: str, rewrite: Rewrite) -> str:
    import yaml

    return yaml.safe_dump(rewritten_value(yaml.safe_load(content), rewrite, "yaml"), allow_unicode=True, sort_keys=False)


class _Xml:
    """Walks events; with a rewrite, writes them again with released text and attribute values."""

    def __init__(self, rewrite: Rewrite | None = None):
        self.rewrite, self.path, self.fields, self.out, self.seen, self.text, self.cdata = rewrite, [], [], [], {}, "", False

    def field(self, path: str, label: str, value: str) -> str:
        if not value.strip():
            return value
        self.fields.append((path, label, self.seen.setdefault(path, 0), value.strip(), "string"))
        self.seen[path] += 1
        return self.rewrite(path, value.strip()) if self.rewrite else value

    def flush(self) -> None:
        if self.text:
            path = "xml/" + "/".join(f"e:{escaped(p)}" for p in self.path) + "/text"
            text = self.field(path, ".".join(self.path), self.text)
            self.out.append(f"<![CDATA[{text}]]>" if self.cdata else escape(text))
        self.text = ""

    def start(self, name: str, attributes: list[str]) -> None:
        self.flush()
        self.path.append(name)
        base = "xml/" + "/".join(f"e:{escaped(p)}" for p in self.path)
        pairs = [(k, self.field(f"{base}/@:{escaped(k)}", ".".join(self.path) + f".@{k}", v)) for k, v in zip(attributes[::2], attributes[1::2], strict=True)]
        self.out.append(f"<{name}" + "".join(f" {k}={quoteattr(v)}" for k, v in pairs) + ">")

    def end(self, name: str) -> None:
        self.flush()
        self.path.pop()
        self.out.append(f"</{name}>")

    def run(self, content: str) -> _Xml:
        p = expat.ParserCreate()
        p.ordered_attributes, p.buffer_text = True, True
        p.StartElementHandler, p.EndElementHandler = self.start, self.end
        p.CharacterDataHandler = lambda d: setattr(self, "text", self.text + d)
        p.StartCdataSectionHandler = lambda: (self.flush(), setattr(self, "cdata", True))
        p.EndCdataSectionHandler = lambda: (self.flush(), setattr(self, "cdata", False))
        p.CommentHandler = lambda d: (self.flush(), self.out.append(f"<!--{d}-->"))
        p.ProcessingInstructionHandler = lambda t, d: (self.flush(), self.out.append(f"<?{t} {d}?>"))
        p.XmlDeclHandler = lambda v, e, s: self.out.append(f'<?xml version="{v}"' + (f' encoding="{e}"' if e else "") + "?>")
        p.Parse(content, True)
        return self


def xml_fields(content: str) -> list[Field]:
    return _Xml().run(content).fields


def rewritten_xml(content: str, rewrite: Rewrite) -> str:
    return "".join(_Xml(rewrite).run(content).out)


def text_fields(content: str) -> list[Field]:
    found = S.find(content)
    if len(found) > MOST_SPANS:
        raise ValueError(f"more than {MOST_SPANS} spans")
    seen: dict[str, int] = {}
    out = []
    for s in found:
        out.append((f"text/{s[4]}", s[4], seen.setdefault(s[4], 0), s[8], "string"))
        seen[s[4]] += 1
    return out


def rewritten_text(content: str, rewrite: Rewrite) -> str:
    out, at = [], 0
    for s in S.find(content):
        out += [content[at : s[0]], rewrite(f"text/{s[4]}", s[8])]
        at = s[1]
    return "".join([*out, content[at:]])


def replayed(content: str, confirmed: list[tuple[int, int, str, str]], rewrite: Rewrite) -> str:
    """A text rewritten at its own spans and at confirmed ones (start, end, type, value), which must still be where they were.

    A confirmed span whose text differs, or that meets another span, is an error: the analysis is then of another text.
    """
    spans = [(s[0], s[1], s[4], s[8]) for s in S.find(content)]
    for start, end, kind, value in confirmed:
        if content[start:end] != value:
            raise ValueError(f"{kind} is not at {start}")
        if any(start < e and s < end for s, e, _, _ in spans):
            raise ValueError(f"{kind} at {start} meets another span")
        spans.append((start, end, kind, value))
    out, at = [], 0
    for start, end, kind, value in sorted(spans):
        out += [content[at:start], rewrite(f"text/{kind}", value)]
        at = end
    return "".join([*out, content[at:]])


FIELDS = {"json": json_fields, "yaml": yaml_fields, "xml": xml_fields, "text": text_fields, "logs": text_fields}
REWRITES = {"json": rewritten_json, "yaml": rewritten_yaml, "xml": rewritten_xml, "text": rewritten_text, "logs": rewritten_text}

_LOG = re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|\b(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b| request_id=| trace_id=")


def sniffed(content: str) -> str:
    """The format of a pasted document: empty text, JSON, XML, CSV, YAML, logs, else text."""
    if not content.strip():
        return "text"
    try:
        json.loads(content)
        return "json"
    except ValueError:
        pass
    if content.lstrip().startswith("<"):
        try:
            xml_fields(content)
            return "xml"
        except expat.ExpatError:
            pass
    lines = [x for x in content.splitlines() if x.strip()]
    if "," in lines[0] and len(next(csv.reader(io.StringIO(lines[0])))) > 1 and not _LOG.search(lines[0]):
        return "csv"
    if re.search(r"(?m)^\s*(?:- |[\w\"'-]+:(?:\s|$))", content):
        try:
            import yaml

            if not isinstance(yaml.safe_load(content), str):
                return "yaml"
        except Exception:  # noqa: BLE001
            pass
    return "logs" if any(_LOG.search(x) for x in lines[:20]) else "text"


def checked_size(content: str) -> str:
    if not content.strip():
        raise ValueError("there is nothing to read")
    if len(content.encode()) > MOST_BYTES:
        raise ValueError("more than 5 MiB")
    return content


def flattened(df: DataFrame, key: str, column: str, kind: str) -> DataFrame:
    """(key, path, label, ord, value, kind): the fields of every document, in Arrow batches."""
    names = [key, "path", "label", "ord", "value", "kind"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(k, *f) for k, t in zip(p[key], p[column], strict=True) if t for f in FIELDS[kind](t)], columns=names)

    return df.select(key, column).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, path string, label string, ord long, value string, kind string")


def rewritten(df: DataFrame, key: str, column: str, kind: str, released: DataFrame) -> DataFrame:
    """(key, content): documents with values replaced by released (key, path, value, output); joined by document, not collected."""
    pairs = released.groupBy(key).agg(F.collect_list(F.struct("path", "value", "output")).alias("_new"))
    rows = df.select(key, column).join(pairs, key, "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for t, new in zip(p[column], p["_new"], strict=True):
                known = {(x["path"], x["value"]): x["output"] for x in (new if new is not None else [])}
                out.append(REWRITES[kind](t, lambda path, v, known=known: known.get((path, v), v)) if t else t)
            yield pd.DataFrame({key: p[key], "content": out})

    return rows.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, content string")


def as_rows(fields: DataFrame, key: str) -> DataFrame:
    """Ragged fields as rows (key, ord) with a column for each path, padded with ""."""
    wide = fields.groupBy(key, "ord").pivot("path").agg(F.first("value"))
    return wide.select(key, "ord", *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in wide.columns if c not in (key, "ord")])


def placed(fields: DataFrame, by: list[str], order: str) -> DataFrame:
    """Running 0-based place within each group of `by` (a path of a document)."""
    return fields.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)


def row_count(value: object) -> int:
    """How many rows a parsed JSON or YAML value holds: the items of a list, none of null, else one."""
    return len(value) if isinstance(value, list) else 0 if value is None else 1


def row_counts(fields: DataFrame, key: str) -> DataFrame:
    """(key, rows): how many rows each XML document holds: the most values that one of its paths has."""
    return fields.groupBy(key, "path").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("rows"))
