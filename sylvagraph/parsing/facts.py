"""Facts of source files: imports, entities, exports, variables, calls and comments.

Python is read by its own parser; JavaScript and TypeScript by a walk over their tokens; the other languages by
patterns of their declarations over text without comments and strings, which is an approximation. Any failure gives no facts. Runs as an Arrow function,
one file a row.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvagraph.operators.stats import language_of
from sylvagraph.parsing.lexer import masked
from sylvagraph.parsing.scripts import Walk

SCHEMA = "path string, language string, size_exceeded boolean, imports array<struct<path:string,imported_entities:array<string>>>, entities array<struct<type:string,name:string>>, exports array<struct<exported_name:string,local_name:string,is_default:boolean>>, variables array<string>, calls array<string>, comments array<string>, adr string, is_markdown_adr boolean"

# How languages declare things: imports, classes, functions.
_C = r"(?m)^\s*(?:[\w:<>,*&\[\] ]+\s+)?"
PATTERNS = {
    "go": (r'(?m)^\s*(?:import\s+)?(?:\w+\s+)?"([^"\n]+)"\s*$', r"(?m)^\s*type\s+(\w+)", r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)"),
    "rust": (r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"),
    "java": (r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)", r"(?:class|interface|enum)\s+(\w+)", r"(?m)^\s*(?:public|private|protected|static|final|\s)+[\w<>\[\], ]+\s+(\w+)\s*\([^;]*\)\s*(?:throws [\w, ]+)?\{"),
    "cpp": (r'(?m)^\s*#\s*include\s*[<"]([^>"]+)', r"(?:class|struct)\s+(\w+)", _C + r"(\w+)\s*\([^;{}]*\)\s*(?:const)?\s*\{"),
    "c_sharp": (r"(?m)^\s*using\s+([\w.]+)\s*;", r"(?:class|interface|struct|enum|record)\s+(\w+)", r"(?m)^\s*(?:public|private|protected|internal|static|async|override|virtual|\s)+[\w<>\[\], ]+\s+(\w+)\s*\([^;]*\)\s*\{"),
    "php": (r"(?m)^\s*use\s+([\w\\]+)", r"(?:class|interface|trait)\s+(\w+)", r"function\s+(\w+)"),
    "ruby": (r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"]+)", r"(?m)^\s*(?:class|module)\s+(\w+)", r"(?m)^\s*def\s+(?:self\.)?(\w+[?!]?)"),
    "zig": (r'@import\(\s*"([^"]+)"', r"const\s+(\w+)\s*=\s*(?:packed |extern )?(?:struct|enum|union)", r"fn\s+(\w+)"),
    "swift": (r"(?m)^\s*import\s+(\w+)", r"(?:class|struct|enum|protocol)\s+(\w+)", r"func\s+(\w+)"),
    "kotlin": (r"(?m)^\s*import\s+([\w.*]+)", r"(?:class|interface|object)\s+(\w+)", r"fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)"),
    "bash": (r"(?m)^\s*(?:source|\.)\s+(\S+)", r"(?!)", r"(?m)^\s*(?:function\s+)?(\w+)\s*\(\)"),
    "html": (r"(?:src|href)\s*=\s*['\"]([^'\"]+)", r"<([a-zA-Z][\w-]*)", r"(?!)"),
    "css": (r"@import\s+(?:url\()?['\"]([^'\"]+)", r"\.([A-Za-z_][\w-]*)(?=[^{}]*\{)", r"(?!)"),
    "vue": (r"from\s+['\"]([^'\"]+)", r"<([a-zA-Z][\w-]*)", r"function\s+(\w+)"),
    "yaml": (r"(?!)", r"(?!)", r"(?!)"),
    "json": (r"(?!)", r"(?!)", r"(?!)"),
}
_ADR = [re.compile(r"(?im)^\s*(?://\s*|#\s*|/\*\s*|\*\s*)@adr\s+(.+)$"), re.compile(r"(?im)^\s*(?://\s*|#\s*|/\*\s*|\*\s*)ADR:\s*(.+)$")]


def distinct(values) -> list:
    return list(dict.fromkeys(v for v in values if v))


def grouped(pairs) -> list[dict]:
    out: dict[str, list[str]] = {}
    for path, names in pairs:
        found = out.setdefault(path, [])
        found += [n for n in names if n not in found]
    return [{"path": p, "imported_entities": n} for p, n in out.items()]


def python_facts(text: str) -> dict:
    tree = ast.parse(text)
    imports, entities, variables, calls = [], [], [], []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [(a.name, []) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append(("." * node.level + (node.module or ""), [a.name for a in node.names]))
        elif isinstance(node, ast.ClassDef):
            entities.append(("class", node.name))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            entities.append(("function", node.name))
        elif isinstance(node, ast.Assign):
            variables += [t.id for t in node.targets if isinstance(t, ast.Name)]
        elif isinstance(node, ast.Call):
            calls.append(getattr(node.func, "id", getattr(node.func, "attr", "")))
    return {"imports": grouped(imports), "entities": entities, "exports": [], "variables": variables, "calls": calls, "comments": re.findall(r"(?m)#.*$", text)}


def script_facts(text: str, markup: bool = False) -> dict:
    walk = Walk(text, markup)
    comments = [c.strip() for c in re.findall(r"//.*|/\*[\s\S]*?\*/", text)]
    imports = grouped((path.strip(), names) for path, names in walk.imports if path.strip())
    return {"imports": imports, "entities": walk.entities, "exports": walk.exports, "variables": walk.variables, "calls": walk.calls, "comments": comments}


def pattern_facts(text: str, language: str) -> dict:
    imports, classes, functions = PATTERNS[language]
    code, plain = (text, text) if language in ("html", "css", "vue", "yaml", "json") else masked(text, language)
    found = re.findall(imports, code)
    entities = [("class", n) for n in re.findall(classes, plain)] + [("function", n) for n in re.findall(functions, plain)]
    names = [re.split(r"[.:]", p)[-1] if language not in ("cpp", "html", "css", "vue", "bash", "ruby", "go", "zig") else None for p in found]
    comments = re.findall(r"(?m)//.*$|/\*[\s\S]*?\*/|^\s*#.*$", text)
    return {"imports": grouped((p, [n] if n else []) for p, n in zip(found, names, strict=True)), "entities": entities, "exports": [], "variables": [], "calls": re.findall(r"(\w+)\s*\(", plain), "comments": comments}


def facts(path: str, language: str | None, text: str | None, too_large: bool) -> dict:
    out = {"path": path, "language": language, "size_exceeded": too_large, "imports": [], "entities": [], "exports": [], "variables": [], "calls": [], "comments": [], "adr": None, "is_markdown_adr": False}
    if language is None or text is None:
        return out
    try:
        if language == "markdown":
            lower = text.lower()
            if "status:" in lower and "context" in lower:
                title = re.search(r"(?m)^#\s+(.+)", text)
                return out | {"adr": title[1].strip() if title else path.rsplit("/", 1)[-1], "is_markdown_adr": True}
            return out
        adr = next((m[1].strip() for p in _ADR if (m := p.search(text))), None)
        found = python_facts(text) if language == "python" else script_facts(text, language != "typescript") if language in ("javascript", "typescript", "tsx") else pattern_facts(text, language)
    except (SyntaxError, ValueError, RecursionError, KeyError):
        return out
    return out | {
        "imports": found["imports"], "entities": [{"type": t, "name": n} for t, n in distinct(found["entities"])],
        "exports": [{"exported_name": e, "local_name": n, "is_default": d} for e, n, d in distinct(found["exports"])],
        "variables": distinct(found["variables"]), "calls": distinct(found["calls"]), "comments": distinct(c.strip() for c in found["comments"]), "adr": adr,
    }


def _parsed(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [facts(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content", "too_large")), strict=True)]
        found = pa.RecordBatch.from_pylist(rows, schema=ARROW)
        yield pa.RecordBatch.from_arrays([*found.columns, *(batch.column(c) for c in keep)], names=[*ARROW.names, *keep])


_TEXTS = pa.list_(pa.string())
ARROW = pa.schema([
    ("path", pa.string()), ("language", pa.string()), ("size_exceeded", pa.bool_()),
    ("imports", pa.list_(pa.struct([("path", pa.string()), ("imported_entities", _TEXTS)]))), ("entities", pa.list_(pa.struct([("type", pa.string()), ("name", pa.string())]))),
    ("exports", pa.list_(pa.struct([("exported_name", pa.string()), ("local_name", pa.string()), ("is_default", pa.bool_())]))),
    ("variables", _TEXTS), ("calls", _TEXTS), ("comments", _TEXTS), ("adr", pa.string()), ("is_markdown_adr", pa.bool_()),
])


def parsed(files: DataFrame, active: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The facts of each file (path, length, content), and the columns ``keep`` as they are. Languages that aren't active, if given, give none."""
    language: Column = language_of(F.col("path"))
    if active is not None:
        language = F.when(language.isin(active), language)
    keep = keep or []
    rows = files.select("path", language.alias("language"), "content", (F.col("content").isNull() & (F.col("length") > 0)).alias("too_large"), *keep)
    kinds = "".join(f", {c} {files.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(partial(_parsed, keep=keep), SCHEMA + kinds)
