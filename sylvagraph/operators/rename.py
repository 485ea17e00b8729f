"""Renaming a file or folder: which specifiers of which files lead there, and what they must say afterwards.

Module resolution is turned round: every import that a file of the tree answers is known with its answer, so those whose file or whose answer moves are looked at and no text is searched. A relative
specifier is written anew from the new places; an alias keeps its beginning as long as the new place is below the same folder. What was left out (an ending, an index file) stays out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvagraph.functions.paths import dirname
from sylvagraph.operators.modules import STANDS_FOR
from sylvagraph.parsing.lexer import tokens


def moved(path: Column, old: str, new: str) -> Column:
    here = (path == old) | path.startswith(f"{old}/")
    return F.when(here, F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def relative(folder: Column, place: Column) -> Column:
    """``place`` as seen from ``folder``, beginning with a dot. Both are absolute."""
    a, b = F.split(folder, "/"), F.split(place, "/")
    shared = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda n: F.slice(a, 1, n) == F.slice(b, 1, n)))
    up = F.repeat(F.lit("../"), F.size(a) - shared)
    return F.concat(F.when(F.size(a) == shared, "./").otherwise(up), F.array_join(F.slice(b, shared + 1, F.greatest(F.size(b) - shared, F.lit(0))), "/"))


def written(specifier: Column, answer: Column, target: Column) -> Column:
    """``target`` without what the specifier leaves out of its ``answer``, an index file or an ending, or with the ending that it writes instead of the answer's own."""
    index, ending = r"/index(\.d)?\.[^./]+$", r"(\.d)?\.[^./]+$"
    bare = F.regexp_replace(target, ending, "")
    said = F.when(specifier.rlike(r"(^|/)\.{1,2}/?$"), "").otherwise(F.regexp_extract(specifier, r"(\.[A-Za-z]+)$", 1))
    out = F.when(answer.rlike(index) & ~specifier.rlike(r"(^|/)index(\.[A-Za-z]+)?$") & target.rlike(index), F.regexp_replace(target, index, "")).when((said != "") & answer.endswith(said), target).otherwise(bare)
    for other in STANDS_FOR:
        # "./a.js" may stand for a.ts.
        out = F.when((said == other) & ~answer.endswith(other), F.concat(bare, F.lit(other))).otherwise(out)
    return out


def rewrites(answers: DataFrame, old: str, new: str) -> DataFrame:
    """path, specifier and replacement for the imports (path, specifier, resolved) that say something else once ``old`` is ``new``. Paths are those before."""
    near = answers.select("path", "specifier", F.col("resolved").alias("answer"), moved(F.col("path"), old, new).alias("to"), moved(F.col("resolved"), old, new).alias("target"))
    some = near.filter((F.col("to") != F.col("path")) | (F.col("target") != F.col("answer")))
    spec = F.col("specifier")
    place, was = written(spec, F.col("answer"), F.col("target")), written(spec, F.col("answer"), F.col("answer"))
    # An alias: what its end shares with the old place is replaced, if the rest names a folder that the new place is below, too.
    parts = F.split(spec, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))
    longest = F.reduce(F.filter(tails, lambda tail: F.endswith(F.col("was"), F.concat(F.lit("/"), tail))), F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))
    some = some.withColumn("place", place).withColumn("was", was).withColumn("tail", longest)
    folder = F.substr(F.col("was"), F.lit(1), F.length("was") - F.length("tail"))
    alias = F.when((F.col("tail") != "") & F.col("place").startswith(folder), F.concat(F.substr(spec, F.lit(1), F.length(spec) - F.length("tail")), F.substr(F.col("place"), F.length(folder) + 1, F.lit(1 << 30))))
    seen = relative(dirname(F.col("to")), F.col("place"))
    found = F.when(spec.startswith("."), seen).otherwise(F.coalesce(F.when(F.col("target") == F.col("answer"), spec), alias, seen))
    trimmed = F.when(spec.rlike(r"^\.{1,2}(/\.\.)*$"), F.regexp_replace(found, r"(?<=.)/$", "")).otherwise(found)
    return some.select("path", "specifier", trimmed.alias("replacement")).filter("replacement != specifier")


def replaced(text: str, changes: dict[str, str]) -> str:
    """A script with the specifiers of its imports changed, and nothing else."""
    toks, out, at = tokens(text, True), [], 0
    for i, t in enumerate(toks):
        if t.kind != "string" or t.text[1:-1] not in changes or i == 0:
            continue
        before = toks[i - 1]
        called = before.text == "(" and i > 1 and toks[i - 2].text in ("import", "require")
        if called or (before.kind == "name" and before.text in ("from", "import")):
            out += [text[at : t.start], t.text[0], changes[t.text[1:-1]], t.text[0]]
            at = t.end
    return "".join([*out, text[at:]])


def renamed_files(files: DataFrame, answers: DataFrame, old: str, new: str) -> DataFrame:
    """path, new_path and content of the files (path, content) whose place or text changes."""
    changes = rewrites(answers, old, new).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("specifier", "replacement"))).alias("changes"))
    rows = files.select("path", moved(F.col("path"), old, new).alias("new_path"), "content").join(changes, "path", "left")
    some = rows.filter((F.col("path") != F.col("new_path")) | F.col("changes").isNotNull()).select("path", "new_path", "content", F.map_entries("changes").alias("changes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, to, texts, changed = (batch.column(c).to_pylist() for c in ("path", "new_path", "content", "changes"))
            out = [replaced(x, {c["key"]: c["value"] for c in cs}) if cs and x else x for x, cs in zip(texts, changed, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(to, pa.string()), pa.array(out, pa.string())], names=["path", "new_path", "content"])

    return some.mapInArrow(run, "path string, new_path string, content string")


def rename(files: DataFrame, answers: DataFrame, old: str, new: str) -> list[str]:
    """Renames in the files' own store and writes the changed texts; returns the paths of rewritten files. They come one by one."""
    spark = files.sparkSession
    context = spark.sparkContext
    path = lambda p: context._jvm.org.apache.hadoop.fs.Path(p)
    fs = path(old).getFileSystem(context._jsc.hadoopConfiguration())
    changed = renamed_files(files, answers, old, new).join(rewrites(answers, old, new).select("path").distinct(), "path", "left_semi")
    texts = changed.checkpoint(eager=True) if context._jsc.sc().getCheckpointDir().isDefined() else changed.persist()
    texts.count()
    if not fs.rename(path(old), path(new)):
        raise FileExistsError(f"{old} can't become {new}")
    out = []
    for row in texts.toLocalIterator():
        stream = fs.create(path(row.new_path), True)
        try:
            stream.write(bytearray(row.content.encode()))
        finally:
            stream.close()
        out.append(row.new_path)
    return sorted(out)
