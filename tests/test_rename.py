"""Renames: afterwards every import leads where it led before."""

import pytest
from sylvagraph.operators import build, rename
from sylvagraph.parsing.facts import parsed
from sylvagraph.sources.files import discover

TREE = {
    "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}',
    "src/a.ts": "import { b } from './ui/b'; import x from './ui'; const s = './ui/b'; // from './ui/b'\nexport * from \"./lib/c.js\";\nconst l = import('@/ui/b'); require('./ui/index')",
    "src/ui/b.tsx": "import a from '../a'; import { c } from '../lib/c'; import '.';\nexport const t = <p>from './x' it's</p>;",
    "src/ui/index.ts": "export { b } from './b'; import './deep/d.ts'; import react from 'react'",
    "src/ui/deep/d.ts": "import '..'; import '../b'; import '../../a'; import 'src/lib/c'",
    "src/lib/c.ts": "import '@/ui'; import '@/ui/deep/d'",
}


def links(spark, root):
    # As sets, since two specifiers that come to say the same are one import.
    return sorted({(r.source, r.target) for r in build.analyze(spark, root).links.select("source", "target").collect()})


@pytest.mark.parametrize(
    ("old", "new"),
    [("src/ui/b.tsx", "src/ui/bb.tsx"), ("src/ui", "src/widgets"), ("src/ui", "packages/ui/x"), ("src/lib/c.ts", "src/ui/deep/c.ts"), ("src/a.ts", "src/lib/sub/a.ts"), ("src/ui/index.ts", "src/ui/all.ts")],
)
def test_imports_lead_where_they_led(spark, tmp_path, old, new):
    root = str(tmp_path)
    for name, text in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    before, old, new = links(spark, root), f"{root}/{old}", f"{root}/{new}"
    (tmp_path / new).parent.mkdir(parents=True, exist_ok=True)
    files = discover(spark, root)
    answers = build.script_modules(parsed(files), files, root)
    rename.rename(files, answers, old, new)
    to = lambda p: new + p[len(old) :] if p.split("#")[0] == old or p.startswith(f"{old}/") else p
    assert links(spark, root) == sorted({(to(s), to(t)) for s, t in before})
    text = (tmp_path / to(f"{root}/src/a.ts")).read_text()
    assert "const s = './ui/b'; // from './ui/b'" in text and "react" in (tmp_path / to(f"{root}/src/ui/index.ts")).read_text()


def test_new_texts_of_specifiers(spark):
    rows = [
        ("/p/src/a.ts", "./ui/b", "/p/src/ui/b.tsx"), ("/p/src/a.ts", "@/ui/b", "/p/src/ui/b.tsx"), ("/p/src/ui/b.tsx", "../a", "/p/src/a.ts"), ("/p/src/ui/b.tsx", "./c.js", "/p/src/ui/c.ts"),
        ("/p/src/x.ts", "./ui/c.js", "/p/src/ui/c.ts"), ("/p/src/x.ts", "./ui", "/p/src/ui/index.ts"), ("/p/src/x.ts", "./y", "/p/src/y.ts"), ("/p/src/ui/z.ts", "@/y", "/p/src/y.ts"),
    ]
    answers = spark.createDataFrame(rows, "path string, specifier string, resolved string")
    found = {(r.path, r.specifier): r.replacement for r in rename.rewrites(answers, "/p/src/ui", "/p/src/view/parts").collect()}
    assert found == {("/p/src/a.ts", "./ui/b"): "./view/parts/b", ("/p/src/a.ts", "@/ui/b"): "@/view/parts/b", ("/p/src/ui/b.tsx", "../a"): "../../a", ("/p/src/x.ts", "./ui/c.js"): "./view/parts/c.js", ("/p/src/x.ts", "./ui"): "./view/parts"}
    assert rename.rewrites(answers.limit(0), "/p/src/ui", "/q").count() == 0
