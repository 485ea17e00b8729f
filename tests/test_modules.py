"""Resolution of import specifiers."""

from sylvagraph.operators import build, modules


def test_aliases_and_endings(spark):
    base = '{ // shared\n "compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["*"], "@ui/*": ["ui/*", "old/*"], "exact": ["lib/exact",],}, /* end */ // of all\n }, }'
    files = [
        ("/p/tsconfig.json", '{"extends": "./base"}'), ("/p/base.json", base), ("/p/sub/jsconfig.json", '{"compilerOptions": {"paths": {"~/*": ["./x/*"]}}}'), ("/p/bad/tsconfig.json", "{nonsense"),
        ("/p/src/a.ts", ""), ("/p/src/ui/button.tsx", ""), ("/p/src/old/list.ts", ""), ("/p/src/lib/exact.ts", ""), ("/p/src/lib/index.ts", ""), ("/p/sub/x/k.js", ""), ("/p/sub/m.ts", ""), ("/p/bad/n.ts", ""),
    ]
    asked = {
        ("/p/src/a.ts", "@/lib"): "/p/src/lib/index.ts", ("/p/src/a.ts", "@ui/button"): "/p/src/ui/button.tsx", ("/p/src/a.ts", "@ui/list"): "/p/src/old/list.ts", ("/p/src/a.ts", "exact"): "/p/src/lib/exact.ts",
        ("/p/src/a.ts", "ui/button"): "/p/src/ui/button.tsx", ("/p/src/a.ts", "./ui/button.js"): "/p/src/ui/button.tsx", ("/p/src/a.ts", "react"): None, ("/p/src/a.ts", "../../../etc"): None, ("/p/sub/m.ts", "~/k"): "/p/sub/x/k.js",
        ("/p/sub/m.ts", "@/lib"): None, ("/p/bad/n.ts", "@/lib"): None, ("/p/bad/n.ts", "../src/a"): "/p/src/a.ts",
    }
    df = spark.createDataFrame(files, "path string, content string")
    imports = spark.createDataFrame([*asked, *asked, (None, "x")], "path string, specifier string")
    found = {(r.path, r.specifier): r.resolved for r in modules.resolved_modules(imports, df, modules.configurations(df), "/p").collect()}
    assert found == {k: v for k, v in asked.items() if v}


def test_circular_extends_and_no_configuration(spark):
    files = spark.createDataFrame([("/p/tsconfig.json", '{"extends": "./b.json"}'), ("/p/b.json", '{"extends": "./tsconfig.json", "compilerOptions": {"baseUrl": "."}}')], "path string, content string")
    assert [(r.config, r.base) for r in modules.configurations(files).collect()] == [("/p/tsconfig.json", "/p")]
    none = modules.nearest_configuration(spark.createDataFrame([("/q/a.ts",)], "path string"), modules.configurations(files), "/q").collect()
    assert [(r.path, r.config) for r in none] == [("/q/a.ts", None)]


def test_alias_links_of_a_project(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, text in {"tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}', "src/a.ts": "import { b } from '@/b';", "src/b.ts": "export function b() {}"}.items():
        (tmp_path / name).write_text(text)
    g = build.analyze(spark, str(tmp_path))
    assert [(r.source, r.target) for r in g.links.collect()] == [(f"{tmp_path}/src/a.ts", f"{tmp_path}/src/b.ts#b")]
