"""Import specifiers to files, with the base folder and aliases of the nearest tsconfig.json or jsconfig.json.

Options are tables: a configuration's own, then those of what it extends. A specifier becomes ranked candidate paths, which meet the
files in an equi-join; the first that exists wins. Packages and what lies outside the root have no file here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvagraph.functions.paths import ancestors, basename, dirname
from sylvagraph.operators.build import is_local, joined
from sylvagraph.operators.traverse import levels

# Names of configurations, the first before the second, and endings in the order in which they are tried.
CONFIGS = ["tsconfig.json", "jsconfig.json"]
ENDINGS = ["", ".ts", ".tsx", ".d.ts", ".js", ".jsx"]
#: What a written ending may stand for.
STANDS_FOR = {".js": [".ts", ".tsx", ".d.ts"], ".jsx": [".tsx", ".ts", ".d.ts"], ".mjs": [".mts", ".d.mts"], ".cjs": [".cts", ".d.cts"]}
OPTIONS = "extends string, compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>"
CONFIGURATIONS = "config string, folder string, base string, aliases_from string, aliases array<struct<pattern: string, targets: array<string>>>"
#: Later ways to a file are this far behind earlier ones.
STEP = 1000


def configurations(files: DataFrame) -> DataFrame:
    """config, folder, base (null: none) and aliases (pattern, targets) of every ``*.json`` that a configuration is or extends.

    ``files``: path, content. Comments are allowed; what isn't JSON has no options. Only relative ``extends`` are followed; the
    nearest definition of each option counts, seen from the folder of its file.
    """
    # A comma may stand before a closing bracket, with comments between.
    tidy = F.regexp_replace("content", r",(?=(?:\s|//[^\n]*\n|/\*(?s:.*?)\*/)*[}\]])", "")
    parsed = F.from_json(tidy, OPTIONS, {"allowComments": "true"})
    own = files.filter(F.col("path").endswith(".json")).select("path", dirname(F.col("path")).alias("folder"), parsed.alias("o"))
    base = F.when(F.col("o.compilerOptions.baseUrl").isNotNull(), joined(F.col("folder"), F.col("o.compilerOptions.baseUrl")))
    aliases = F.when(F.col("o.compilerOptions.paths").isNotNull(), F.transform(F.map_entries("o.compilerOptions.paths"), lambda e: F.struct(e.key.alias("pattern"), e.value.alias("targets"))))
    own = own.select("path", "folder", "o.extends", base.alias("base"), aliases.alias("aliases"))
    parent = joined(F.col("folder"), F.col("extends"))
    edges = own.filter(F.col("extends").startswith(".")).select(F.col("path").alias("a"), F.when(parent.endswith(".json"), parent).otherwise(F.concat(parent, F.lit(".json"))).alias("b"))
    asked = own.filter(basename(F.col("path")).isin(CONFIGS)).select(F.col("path").alias("seed_id"), F.col("path").alias("id"))
    each = levels(edges, asked).join(own.withColumnRenamed("path", "id"), "id")
    nearest = lambda value, given: F.min_by(F.when(F.col(given).isNotNull(), value), F.when(F.col(given).isNotNull(), F.col("depth")))
    found = each.groupBy(F.col("seed_id").alias("config")).agg(nearest(F.col("base"), "base").alias("base"), nearest(F.struct("aliases", "folder"), "aliases").alias("a"))
    return found.select("config", dirname(F.col("config")).alias("folder"), "base", F.coalesce("base", "a.folder").alias("aliases_from"), "a.aliases")


def nearest_configuration(paths: DataFrame, configs: DataFrame, root: str) -> DataFrame:
    """path and config (null: none) of the nearest folder from the file's own up to the root. Looked up once a folder."""
    folders = paths.select(dirname(F.col("path")).alias("of")).distinct()
    up = folders.select("of", F.explode(F.array_append(ancestors(F.concat("of", F.lit("/x")), root), F.lit(root))).alias("folder"))
    order = F.struct(F.length("folder").alias("depth"), (basename(F.col("config")) == CONFIGS[0]).alias("first"))
    best = up.join(configs.select("folder", "config"), "folder").groupBy("of").agg(F.max_by("config", order).alias("config"))
    return paths.select("path", dirname(F.col("path")).alias("of")).join(best, "of", "left").select("path", "config")


def _alias_targets(specifier: Column, aliases: Column, base: Column) -> Column:
    """The places that the best pattern gives: an exact one, else that of the longest text before its star."""
    before, after = (lambda a: F.substring_index(a.pattern, "*", 1)), (lambda a: F.substring_index(a.pattern, "*", -1))
    starred = lambda a: a.pattern.contains("*")
    fits = lambda a: F.when(starred(a), specifier.startswith(before(a)) & specifier.endswith(after(a)) & (F.length(specifier) >= F.length(a.pattern) - 1)).otherwise(specifier == a.pattern)
    ranked = F.transform(F.filter(aliases, fits), lambda a: F.struct(F.when(starred(a), F.length(before(a))).otherwise(F.lit(1 << 30)).alias("fit"), a.pattern.alias("pattern"), a.targets.alias("targets")))
    best = F.array_max(ranked)
    star = F.when(starred(best), F.substring(specifier, F.length(before(best)) + 1, F.length(specifier) - F.length(best.pattern) + 1)).otherwise("")
    return F.coalesce(F.transform(best.targets, lambda t: joined(base, F.replace(t, F.lit("*"), star))), F.array().cast("array<string>"))


def _files_for(place: Column, way: Column) -> Column:
    """rank and candidate of the files that a place without or with an ending may mean."""
    out = []
    for ending, others in STANDS_FOR.items():
        out += [F.when(place.endswith(ending), F.concat(F.substring(place, F.lit(1), F.length(place) - len(ending)), F.lit(o))) for o in others]
    out += [F.when(place.rlike(r"\.[A-Za-z]+\z"), place)] + [F.concat(place, F.lit(e)) for e in ENDINGS[1:]] + [F.concat(place, F.lit(f"/index{e}")) for e in ENDINGS[1:]]
    return F.array(*(F.struct((way * STEP + i).alias("rank"), c.alias("candidate")) for i, c in enumerate(out)))


def tried_modules(imports: DataFrame, configs: DataFrame, root: str) -> DataFrame:
    """path, specifier, rank and candidate: the files that could answer each distinct import (path, specifier), the lowest rank first."""
    asked = imports.select("path", "specifier").filter("path is not null and specifier is not null").distinct()
    options = nearest_configuration(asked.select("path").distinct(), configs, root).join(configs.drop("folder"), "config", "left")
    spec, none = F.col("specifier"), F.array().cast("array<string>")
    aliased = F.when(F.col("aliases").isNotNull(), _alias_targets(spec, F.coalesce("aliases", F.array().cast("array<struct<pattern:string,targets:array<string>>>")), F.col("aliases_from"))).otherwise(none)
    based = F.when(F.col("base").isNotNull(), F.array(joined(F.col("base"), spec))).otherwise(none)
    places = F.when(is_local(spec), F.array(joined(dirname(F.col("path")), spec))).otherwise(F.concat(aliased, based))
    rows = asked.join(options, "path", "left").select("path", "specifier", F.posexplode(places).alias("way", "place"))
    return rows.select("path", "specifier", F.inline(_files_for(F.col("place"), F.col("way")))).filter(F.col("candidate").startswith(f"{root}/"))


def answered(tried: DataFrame, files: DataFrame) -> DataFrame:
    """path, specifier and resolved: the first candidate that is a file (path)."""
    known = files.select(F.col("path").alias("candidate")).distinct()
    return tried.join(known, "candidate", "left_semi").groupBy("path", "specifier").agg(F.min_by("candidate", "rank").alias("resolved"))


def resolved_modules(imports: DataFrame, files: DataFrame, configs: DataFrame, root: str) -> DataFrame:
    """path, specifier and resolved for every distinct import (path, specifier) that a file (path) of the tree answers."""
    return answered(tried_modules(imports, configs, root), files)
