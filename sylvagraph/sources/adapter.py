"""A code graph made of the relational test tables, so that graph operators can be held against SQL.

The rules are plain arithmetic on keys; ``plans/oracle.py`` states them again in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagraph.functions.paths import ancestors, basename, dirname
from sylvagraph.lineage import cut
from sylvagraph.operators.resolve import resolve_links
from sylvagraph.schema import CodeGraph
from sylvagraph.sources.tables import read_table
from sylvagraph.sources.versions import Memo

ROOT = "/proj"
DIRS = ["src/components", "src/store", "src/services", "src/domain", "src/api", "src/utils", "src/analysis", "src/parsing", "src/oracle", "scripts", "lib/a/b/c/misc", "src/layout"]
EXTENSIONS = [".ts", ".tsx", ".py", ".md"]
#: Files are this far apart in store order; their symbols stand between.
STEP = 1_000_000


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, type, ext, brand, partkey, parent_id, ord."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    pick = lambda values, at: F.array(*map(F.lit, values))[at.cast("int")]
    folder = F.when(F.col("p_partkey") % 10 == 7, ROOT).otherwise(F.concat(F.lit(f"{ROOT}/"), pick(DIRS, F.col("p_partkey") % len(DIRS))))
    ext = pick(EXTENSIONS, F.col("p_size") % 4)
    name = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/part_"), F.col("p_partkey").cast("string"), ext)
    ident = F.concat(folder, F.lit("/"), name)
    kind = F.when((ext == ".md") & (F.col("p_partkey") % 8 == 3), "adr").otherwise("file")
    return part.select(ident.alias("id"), basename(ident).alias("label"), kind.alias("type"), ext.alias("ext"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("partkey"), dirname(ident).alias("parent_id"), (F.col("p_partkey") * STEP).cast("bigint").alias("ord"))


def directories(found: DataFrame) -> DataFrame:
    """id, label, parent_id and ord of every folder above a file."""
    ids = found.select(F.explode(ancestors(F.col("id"), ROOT)).alias("id")).distinct()
    parent = F.when(dirname(F.col("id")) != ROOT, dirname(F.col("id")))
    # Folders come before files, in an order that needs no global sort.
    order = F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 12), 16, 10).cast("bigint")
    return ids.select("id", basename(F.col("id")).alias("label"), parent.alias("parent_id"), (-order - 1).alias("ord"))


def symbols(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """id, label, type, parent_id, partkey, suppkey, ord."""
    lines = read_table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F' and l_quantity >= 45").select(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey")).distinct()
    label = F.concat(F.lit("sym_"), F.col("suppkey").cast("string"))
    kind = F.when(F.col("suppkey") % 2 == 0, "class").otherwise("function")
    return lines.join(found.filter("type = 'file'").select("partkey", F.col("id").alias("file"), "ord"), "partkey").select(
        F.concat("file", F.lit("#"), label).alias("id"), label.alias("label"), kind.alias("type"), F.col("file").alias("parent_id"), "partkey", "suppkey", (F.col("ord") + F.col("suppkey") + 1).alias("ord")
    )


def raw_links(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """source, target, value, type and ord; targets may lack an extension or name a symbol."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    one = lines.filter("l_returnflag = 'R' and l_quantity >= 30").select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("a"))
    two = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("b"), "l_suppkey")
    pairs = one.join(two, ["l_orderkey", "l_linenumber"]).filter("a != b").groupBy("a", "b").agg(F.min("l_suppkey").alias("k"))
    source = found.select(F.col("partkey").alias("a"), F.col("id").alias("source"), F.col("type").alias("source_type"))
    target = found.select(F.col("partkey").alias("b"), F.col("id").alias("file"))
    both = pairs.join(source, "a").join(target, "b").filter("source_type = 'file'")
    plain = F.when((F.col("a") + F.col("b")) % 3 == 0, F.regexp_replace("file", r"\.[^./]+$", "")).otherwise(F.col("file"))
    named = (F.col("a") + F.col("b")) % 5 == 0
    imports = both.select(
        "source",
        F.when(named, F.concat(plain, F.lit("#sym_"), F.col("k").cast("string"))).otherwise(plain).alias("target"),
        F.when(named, 2).otherwise(1).alias("value"),
        F.lit("import").alias("type"),
        (F.col("a") * 100_000_000 + F.col("b")).cast("bigint").alias("ord"),
    )
    first = found.filter("type = 'adr'").groupBy("brand").agg(F.min_by("id", "partkey").alias("target"))
    adrs = found.filter("type = 'file' and partkey % 10 = 0").join(first, "brand")
    return imports.unionByName(adrs.select(F.col("id").alias("source"), "target", F.lit(3).alias("value"), F.lit("adr").alias("type"), (F.col("partkey") * 100_000_000 + 99_999_999).cast("bigint").alias("ord")))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, author, ts, file_path, additions, deletions: one row for each event."""
    parts = read_table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    placed = events.withColumn("n", parts.scalar()).withColumn("partkey", (F.col("user_id") * 31 + F.coalesce("k", F.lit(0))) % F.col("n"))
    lines = F.floor(F.abs("value")).cast("bigint")
    return placed.join(files(spark, sf_dir).select("partkey", F.col("id").alias("file_path")), "partkey").select(
        F.col("event_id").cast("string").alias("hash"), F.col("user_id").cast("string").alias("author"), "ts", "file_path", lines.alias("additions"), (lines % 7).alias("deletions")
    )


def raw_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The graph before links are resolved."""
    found = files(spark, sf_dir)
    churn = commits(spark, sf_dir).groupBy(F.col("file_path").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None)
    parent = F.when(F.col("parent_id") != ROOT, F.col("parent_id"))
    in_files = found.join(churn, "id", "left").withColumn("churn", F.coalesce("n", F.lit(1)))
    shape = lambda df, group, kind, churn, adr: df.select("id", "label", F.lit(group).cast("int").alias("group") if isinstance(group, int) else group.cast("int").alias("group"), kind.alias("type"), churn.cast("bigint").alias("churn"), adr.cast("string").alias("adr"), "parent_id", none.cast("array<struct<exported_name:string,local_name:string,is_default:boolean>>").alias("exports"), "ord")
    file_rows = in_files.withColumn("parent_id", parent).withColumn("label", F.when(F.col("type") == "adr", F.concat(F.lit("ADR: "), "label")).otherwise(F.col("label")))
    nodes = (
        shape(directories(found), 0, F.lit("directory"), F.lit(0), none)
        .unionByName(shape(file_rows, F.when(F.col("type") == "adr", 4).otherwise(1), F.col("type"), F.col("churn"), F.when(F.col("type") == "adr", F.col("id"))))
        .unionByName(shape(symbols(spark, sf_dir, found).join(in_files.select(F.col("id").alias("parent_id"), "churn"), "parent_id"), F.when(F.col("type") == "class", 2).otherwise(3), F.col("type"), F.col("churn"), none))
    )
    return CodeGraph(nodes, raw_links(spark, sf_dir, found), ROOT)


_GRAPHS = Memo()


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The graph with resolved links, checkpointed, since every analysis reads it several times. It is made once a session for one state of its input files."""

    def made() -> CodeGraph:
        raw = raw_graph(spark, sf_dir)
        nodes = cut(raw.nodes)
        return CodeGraph(nodes, cut(resolve_links(nodes, cut(raw.links))), raw.root)

    return _GRAPHS.get(spark, [f"{sf_dir}/{name}.parquet" for name in ("part", "lineitem", "events")], made)


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, line_no (from 1) and line of invented sources: declarations of the symbols, then lines that rules look for."""
    found = files(spark, sf_dir)
    declared = symbols(spark, sf_dir, found).select(F.col("parent_id").alias("file_id"), (F.col("suppkey") + 1).cast("bigint").alias("line_no"), F.when(F.col("type") == "class", F.concat(F.lit("export class "), "label", F.lit(" {"))).otherwise(F.concat(F.lit("export function "), "label", F.lit("() {"))).alias("line"))
    base = 10_000_000
    extra = [
        (F.col("partkey") % 97 == 0, "  eval(x);"),
        (F.col("partkey") % 89 == 0, "  localStorage.getItem(k);"),
        (F.col("partkey") % 83 == 0, "  execSync(cmd);"),
        (F.col("partkey") % 79 == 0, "  // eval(x) localStorage.a execSync(c)"),
        (F.col("partkey") % 73 == 0, "  log('eval(x)');"),
        (F.col("partkey") % 71 == 0, "  const password = 'hunter2hunter2';"),
        (F.col("partkey") % 67 == 0, "  fetch('http://example.org/x');"),
        (F.col("partkey") % 61 == 0, "  fetch('http://localhost/x');"),
        (F.lit(True), "const value = (a, b) => a;"),
    ]
    rows = F.filter(F.array(*(F.struct(F.lit(base + i).cast("bigint").alias("line_no"), F.when(test, F.lit(line)).alias("line")) for i, (test, line) in enumerate(extra))), lambda r: r.line.isNotNull())
    added = found.filter("type = 'file'").select(F.col("id").alias("file_id"), F.inline(rows))
    return declared.unionByName(added)


def code_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, partkey, declared and content of the invented sources: the declarations alone, and the whole text."""
    lines = code_lines(spark, sf_dir).withColumn("line", F.concat("line", F.when(F.col("line").endswith("{"), "}").otherwise("")))
    text = lambda some: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(some, F.struct("line_no", "line")))), lambda r: r.line), "\n")
    texts = lines.groupBy(F.col("file_id").alias("path")).agg(text(F.col("line_no") < 10_000_000).alias("declared"), text(F.lit(True)).alias("content"))
    return files(spark, sf_dir).filter("type = 'file'").select(F.col("id").alias("path"), "partkey").join(texts, "path")
