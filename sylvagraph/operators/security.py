"""Security findings by file names and contents, one for each rule and file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the rules. A word border is that of ASCII words.
SKIPPED = r"(dist|dist-electron|dist-renderer|node_modules|build|out|coverage)/"
SECRET_FILE = r"(?i)\.(env|pem|key|p12|pfx|crt|cert)\z"
SENSITIVE_NAME = r"(?i)(secret|token|password|passwd|credential|private[-_]?key|access[-_]?key)"
INFRA_FILE = r"(?i)(dockerfile|docker-compose|compose\.ya?ml|k8s|helm|terraform|\.tf\z)"
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
HARDCODED_SECRET = rf"(?i){_B}(?:api[_-]?key|secret|token|password){_E}\s*[:=]\s*['\"`][^'\"`\s]{{8,}}['\"`]"
SANITIZED_RULES = [
    ("browser_storage_auth", "critical", rf"{_B}(?:window\.)?(?:localStorage|sessionStorage)\s*(?:\.|\[)"),
    ("dynamic_code_execution", "high", rf"{_B}(?:eval\s*\(|new Function\s*\()"),
    ("child_process_shell", "high", rf"{_B}(?:exec|execSync|spawn|spawnSync)\s*\("),
]
SEVERITIES = ["critical", "high", "medium", "low"]


def sanitized(text: Column) -> Column:
    """Without block comments, line comments and the insides of strings."""
    text = F.regexp_replace(text, r"/\*[\s\S]*?\*/", " ")
    text = F.regexp_replace(text, r"(?m)//.*$", " ")
    return F.regexp_replace(text, r"""'(?:\\.|[^'\\])*+'|"(?:\\.|[^"\\])*+"|`(?:\\.|[^`\\])*+`""", '""')


def has_plain_http(text: Column) -> Column:
    """Whether a line has a plain http address that isn't local, a template or a namespace."""
    return F.exists(F.split(text, r"\r?\n"), lambda line: line.rlike(r"(?i)http://") & ~line.rlike(r"(?i)localhost|127\.0\.0\.1") & ~line.contains("${") & ~line.rlike(r"(?i)xmlns\s*=|www\.w3\.org"))


def _finding(rule: str, severity: Column | str, holds: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), holds.alias("holds"))


def _found(df: DataFrame, rules: list[Column]) -> DataFrame:
    return df.select(F.col("id").alias("node_id"), F.inline(F.array(*rules))).filter("holds").select("rule_id", "severity", "node_id")


def scanned(nodes: DataFrame) -> DataFrame:
    """Files outside folders of built code. The pattern isn't anchored: ``layout/`` counts as one."""
    return nodes.filter((F.col("type") == "file") & ~F.col("id").rlike(SKIPPED))


def name_findings(nodes: DataFrame) -> DataFrame:
    path, label = F.lower("id"), F.lower("label")
    return _found(
        scanned(nodes),
        [
            _finding("sensitive_file_name", F.when(label == ".env", "high").otherwise("medium"), path.rlike(SECRET_FILE) | label.rlike(SENSITIVE_NAME)),
            _finding("public_secret_exposure", "critical", path.contains("/public/") & path.rlike(SECRET_FILE)),
            _finding("infra_in_source_tree", "low", path.contains("/src/") & path.rlike(INFRA_FILE)),
        ],
    )


def content_findings(texts: DataFrame) -> DataFrame:
    """``texts``: id and text of files."""
    clean = texts.withColumn("clean", sanitized(F.col("text")))
    rules = [_finding(rule, severity, F.col("clean").rlike(pattern)) for rule, severity, pattern in SANITIZED_RULES]
    return _found(clean, [*rules, _finding("hardcoded_secret", "high", F.col("text").rlike(HARDCODED_SECRET)), _finding("insecure_http_url", "medium", has_plain_http(F.col("text")))])


def findings(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Name and content findings. Files without a text have the former only."""
    files = scanned(nodes).select("id")
    return name_findings(nodes).unionByName(content_findings(texts.join(files, "id", "left_semi")))


def severity_summary(found: DataFrame) -> DataFrame:
    """One row: total and a count for each severity."""
    return found.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))


def texts_of(lines: DataFrame) -> DataFrame:
    """id and text of files given by lines (file_id, line_no, line)."""
    return lines.groupBy(F.col("file_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n").alias("text"))
