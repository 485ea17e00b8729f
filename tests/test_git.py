"""The version-control source against what git itself says."""

import os
import subprocess
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from sylvagraph.sources import git


def run(folder, *args, at=None):
    env = os.environ | {"GIT_AUTHOR_NAME": "An | Author", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "c", "GIT_COMMITTER_EMAIL": "c@d", "GIT_CONFIG_GLOBAL": "/dev/null"}
    if at is not None:
        env |= {"GIT_AUTHOR_DATE": f"{at - 50} +0000", "GIT_COMMITTER_DATE": f"{at} +0000"}
    return subprocess.run(["git", "-C", str(folder), *args], env=env, check=True, capture_output=True, text=True).stdout


def repository(folder):
    run(folder, "init", "-q", "-b", "main")
    for i in range(25):
        (folder / f"f{i % 4}.ts").write_text("\n".join(str(j * (i + 1)) for j in range(i + 2)))
        if i % 5 == 0:
            (folder / "bin").write_bytes(bytes([0, i, 255]))
            (folder / "a folder").mkdir(exist_ok=True)
            (folder / "a folder" / "ünï\tcode.md").write_text(str(i))
        run(folder, "add", "-A")
        run(folder, "commit", "-q", "-m", f"c{i}\n\nCOMMIT:no|no|1\n1\t2\tno", at=1_700_000_000 + 1000 * i)
    run(folder, "checkout", "-q", "-b", "side", "HEAD~3")
    (folder / "f0.ts").unlink()
    (folder / "new.ts").write_text("x\ny\n")
    (folder / "f1.ts").write_text("changed\n")
    run(folder, "add", "-A")
    run(folder, "commit", "-q", "-m", "side", at=1_700_100_000)


def test_history_is_what_git_log_says(spark, tmp_path):
    repository(tmp_path)
    folder = str(tmp_path)
    expected = []
    for block in run(tmp_path, "-c", "core.quotepath=off", "log", "--numstat", "--format=%x01%H|%ct", "main").split("\x01")[1:]:
        head, *lines = block.splitlines()
        expected += [(*head.split("|"), *line.split("\t", 2)) for line in lines if line]
    number = lambda x: int(x) if x.isdigit() else 0
    expected = Counter((h, int(t), number(a), number(d), p) for h, t, a, d, p in expected)
    log = git.history(spark, folder, head="main", commits="4")
    assert log.rdd.getNumPartitions() == 7
    rows = log.select("hash", F.unix_seconds("committed").alias("t"), "additions", "deletions", "file_path", F.unix_seconds("ts").alias("at"), "author").collect()
    assert Counter(tuple(r)[:5] for r in rows) == expected and len(rows) == sum(expected.values())
    assert {r.t - r["at"] for r in rows} == {50} and {r.author for r in rows} == {"An | Author"}
    churned = {r.path: r.n for r in git.churn(spark, folder).collect()}
    names = Counter(x for x in run(tmp_path, "-c", "core.quotepath=off", "log", "--name-only", "--pretty=format:").splitlines() if x)
    assert churned == {f"{folder}/{p}": n for p, n in names.items()}


def test_bounds_and_filters_reach_git(spark, tmp_path):
    repository(tmp_path)
    folder = str(tmp_path)
    whole = {r.hash for r in git.history(spark, folder, head="main").select("hash").collect()}
    some = {r.hash for r in git.history(spark, folder, head="main", since="@1700005000", until="@1700009000").select("hash").collect()}
    assert some == set(run(tmp_path, "log", "--format=%H", "--since=@1700005000", "--until=@1700009000", "main").split()) and len(some) == 5
    log = git.history(spark, folder, head="main", commits="3")
    picked = log.filter((F.col("committed") >= F.timestamp_seconds(F.lit(1_700_005_000))) & (F.col("committed") < F.timestamp_seconds(F.lit(1_700_009_000)))).select("hash").distinct()
    assert {r.hash for r in picked.collect()} == {h for h in whole if 1_700_005_000 <= int(run(tmp_path, "log", "-1", "--format=%ct", h)) < 1_700_009_000}
    reader = git.GitReader("log", {"path": folder, "head": "main"})
    left = list(reader.pushFilters([git.GreaterThanOrEqual(("committed",), datetime.fromtimestamp(1_700_005_000)), git.LessThan(("committed",), datetime.fromtimestamp(1_700_009_000)), git.EqualTo(("author",), "x")]))
    assert len(left) == 3 and sum(p.count for p in reader.partitions()) <= 7


def test_differences_of_branches(spark, tmp_path):
    repository(tmp_path)
    got = {r.path: (r.status, r.additions, r.deletions) for r in git.changed_files(spark, str(tmp_path), "main", "side").collect()}
    lines = [x.split("\t") for x in run(tmp_path, "diff", "--numstat", "main...side").splitlines()]
    assert {p: v[1:] for p, v in got.items()} == {p: (int(a), int(d)) for a, d, p in lines}
    assert {p: v[0] for p, v in got.items()} == {"f0.ts": "deleted", "new.ts": "added", "f1.ts": "modified"}


def test_no_repository_has_no_rows(spark, tmp_path):
    assert git.history(spark, str(tmp_path)).count() == 0 and git.churn(spark, str(tmp_path)).count() == 0
    run(tmp_path, "init", "-q")
    assert git.history(spark, str(tmp_path)).count() == 0 and git.history(spark, str(tmp_path), "diff", base="a", head="b").count() == 0
