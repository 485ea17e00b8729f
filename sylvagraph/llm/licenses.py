"""License scans (operator 11), in DataFrame functions alone.

A text is lower-cased (A-Z), cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` and written again with a space on both sides of each word, so a rule's
regex holds whole words and two matches side by side share no space. A rule is a regex behind a keyword: only texts that hold the keyword meet
the regex. Detections of a text are ordered by first word, then longest, highest priority and first rule; one is dropped when an earlier one of no less
priority covers all its words. The phrases of the base rules are counted apart, wherever they stand, and their labels stay.

Nothing leaves a row until its detections are found; then small rows, without texts, are dealt by row for the suppression.
Null and empty texts have no words and no labels. Repeated rows are scanned each by itself, null ids too. The work grows with the texts' lengths times the rules whose keywords they hold.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Priorities: an identifier or a whole notice, a grant by name, a name, a hint.
NOTICE, GRANT, NAME, HINT = 4, 3, 2, 1
RELEVANCE = {NOTICE: 1.0, GRANT: 0.95, NAME: 0.7, HINT: 0.3}


class Rule(NamedTuple):
    label: str
    keyword: str  #: words that any match holds
    pattern: str  #: a regex over words with one space between; ``[^ ]+`` is any word
    priority: int
    base: bool = False


#: Phrases that every scan must count, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, keyword, name, identifier, whether the name says by itself that a license is meant.
NAMES = (
    ("mit", " mit ", r"mit(?: x11| expat)?", "mit", False),
    ("mit-0", " mit ", r"mit (?:no attribution|0)", "mit 0", True),
    ("apache-1.1", " apache ", r"apache(?: software)?(?: licen[sc]e)?(?: version| v)? (?:1 1|v1 1)", "apache 1 1", True),
    ("apache-2.0", " apache ", r"apache(?: software)?(?: licen[sc]e)?(?: version)? (?:2 0|2|v2 0|v2)", "apache 2 0", True),
    ("bsd-2-clause", " bsd ", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", "bsd 2 clause", True),
    ("bsd-3-clause", " bsd ", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd 3 clause", True),
    ("bsd-4-clause", " bsd ", r"(?:original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd)", "bsd 4 clause", True),
    ("0bsd", " bsd ", r"(?:zero|0) clause bsd", "0bsd", True),
    ("bsd", " bsd ", r"(?:bsd|berkeley software distribution|bsd style)", "bsd", False),
    ("isc", " isc ", r"(?:isc|internet systems consortium)", "isc", False),
    ("gpl-1.0", " general  public ", r"gnu general public licen[sc]e(?: version| v)? (?:1 0|1)", "gpl 1 0(?: only| or later)?", True),
    ("gpl-2.0", " general  public ", r"(?:gnu )?general public licen[sc]e(?: version| v)? (?:2 0|2|v2 0|v2)", "gpl 2 0(?: only| or later)?", True),
    ("gpl-3.0", " general  public ", r"(?:gnu )?general public licen[sc]e(?: version| v)? (?:3 0|3|v3 0|v3)", "gpl 3 0(?: only| or later)?", True),
    ("gpl", " general  public ", r"gnu general public licen[sc]e", "gpl", True),
    ("gpl-2.0", " gplv2 ", r"(?:gnu )?gplv2", "gplv2", True),
    ("gpl-3.0", " gplv3 ", r"(?:gnu )?gplv3", "gplv3", True),
    ("gpl", " gpl ", r"(?:gnu )?gpl(?: version)?(?: [23])?", "gnu gpl", False),
    ("lgpl-2.0", " public ", r"(?:gnu )?library general public licen[sc]e(?: version| v)?(?: 2 0| 2)?", "lgpl 2 0(?: only| or later)?", True),
    ("lgpl-2.1", " lesser  general ", r"(?:gnu )?lesser general public licen[sc]e(?: version| v)? (?:2 1|v2 1)", "lgpl 2 1(?: only| or later)?", True),
    ("lgpl-3.0", " lesser  general ", r"(?:gnu )?lesser general public licen[sc]e(?: version| v)? (?:3 0|3|v3)", "lgpl 3 0(?: only| or later)?", True),
    ("lgpl", " lesser  general ", r"(?:gnu )?lesser general public licen[sc]e", "lgpl", True),
    ("lgpl", " lgpl ", r"(?:gnu )?lgpl(?: version)?(?: 2 1| 3)?", "gnu lgpl", False),
    ("agpl-3.0", " affero ", r"(?:gnu )?affero general public licen[sc]e(?: version| v)? (?:3 0|3|v3)", "agpl 3 0(?: only| or later)?", True),
    ("agpl", " affero ", r"(?:gnu )?affero general public licen[sc]e", "agpl", True),
    ("gfdl", " documentation ", r"(?:gnu )?free documentation licen[sc]e(?: version| v)?(?: 1 [123])?", "gfdl 1 [123](?: only| or later)?", True),
    ("mpl-1.1", " mozilla ", r"mozilla public licen[sc]e(?: version| v)? 1 1", "mpl 1 1", True),
    ("mpl-2.0", " mozilla ", r"mozilla public licen[sc]e(?: version| v)? 2 0", "mpl 2 0", True),
    ("mpl", " mozilla ", r"mozilla public licen[sc]e", "mpl", True),
    ("epl-1.0", " eclipse ", r"eclipse public licen[sc]e(?: version| v)? 1 0", "epl 1 0", True),
    ("epl-2.0", " eclipse ", r"eclipse public licen[sc]e(?: version| v)? 2 0", "epl 2 0", True),
    ("epl", " eclipse ", r"eclipse public licen[sc]e", "epl", True),
    ("edl-1.0", " eclipse ", r"eclipse distribution licen[sc]e(?: version| v)? 1 0", "edl 1 0", True),
    ("cddl-1.0", " common  development ", r"common development and distribution licen[sc]e(?: version| v)?(?: 1 [01])?", "cddl 1 [01]", True),
    ("cpl-1.0", " common  public ", r"common public licen[sc]e(?: version| v)?(?: 1 0)?", "cpl 1 0", True),
    ("eupl", " european  union ", r"european union public licen[sc]e(?: version| v)?(?: 1 [012])?", "eupl 1 [012]", True),
    ("bsl-1.0", " boost ", r"boost software licen[sc]e(?: version| v)?(?: 1 0)?", "bsl 1 0", True),
    ("zlib", " zlib ", r"(?:zlib|zlib libpng)", "zlib", False),
    ("unlicense", " unlicense ", r"(?:the )?unlicense", "unlicense", True),
    ("wtfpl", " wtfpl ", r"wtfpl(?: version 2)?", "wtfpl", True),
    ("artistic-2.0", " artistic ", r"artistic licen[sc]e(?: version| v)? 2 0", "artistic 2 0", True),
    ("artistic", " artistic ", r"(?:perl )?artistic licen[sc]e", "artistic 1 0", True),
    ("psf-2.0", " python ", r"python software foundation licen[sc]e(?: version| v)?(?: 2)?", "psf 2 0", True),
    ("php-3.01", " php ", r"php licen[sc]e(?: version| v)?(?: 3 01?)?", "php 3 01", True),
    ("ofl-1.1", " open  font ", r"(?:sil )?open font licen[sc]e(?: version| v)?(?: 1 1)?", "ofl 1 1", True),
    ("ms-pl", " microsoft ", r"microsoft public licen[sc]e", "ms pl", True),
    ("ms-rl", " microsoft ", r"microsoft reciprocal licen[sc]e", "ms rl", True),
    ("odbl-1.0", " open  database ", r"(?:odc )?open database licen[sc]e(?: version| v)?(?: 1 0)?", "odbl 1 0", True),
    ("odc-by-1.0", " open  data ", r"open data commons attribution licen[sc]e(?: version| v)?(?: 1 0)?", "odc by 1 0", True),
    ("pddl-1.0", " public  domain ", r"public domain dedication and licen[sc]e(?: version| v)?(?: 1 0)?", "pddl 1 0", True),
    ("cc0-1.0", " cc0 ", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0", True),
    ("cc0-1.0", " creative  commons ", r"creative commons (?:zero|public domain dedication)(?: 1 0)?(?: universal)?", "cc zero", True),
    ("cc-by", " creative  commons ", r"creative commons attribution(?: [1234] [05])?(?: international| unported)?", "cc by [1234] [05]", True),
    ("cc-by-sa", " creative  commons ", r"creative commons attribution share(?: )?alike(?: [1234] [05])?(?: international| unported)?", "cc by sa [1234] [05]", True),
    ("cc-by-nd", " creative  commons ", r"creative commons attribution no(?: )?deriv(?:ative)?s?(?: [1234] [05])?", "cc by nd [1234] [05]", True),
    ("cc-by-nc", " creative  commons ", r"creative commons attribution non(?: )?commercial(?: [1234] [05])?(?: international| unported)?", "cc by nc [1234] [05]", True),
    ("cc-by-nc-sa", " creative  commons ", r"creative commons attribution non(?: )?commercial share(?: )?alike(?: [1234] [05])?", "cc by nc sa [1234] [05]", True),
    ("cc-by-nc-nd", " creative  commons ", r"creative commons attribution non(?: )?commercial no(?: )?deriv(?:ative)?s?(?: [1234] [05])?", "cc by nc nd [1234] [05]", True),
    ("cc-by-4.0", " cc  by ", r"cc by 4 0", "cc by 4", True),
    ("cc-by-3.0", " cc  by ", r"cc by 3 0", "cc by 3", True),
    ("cc-by-sa-4.0", " cc  by  sa ", r"cc by sa 4 0", "cc by sa 4", True),
    ("cc-by-sa-3.0", " cc  by  sa ", r"cc by sa 3 0", "cc by sa 3", True),
    ("cc-by-nd-4.0", " cc  by  nd ", r"cc by nd 4 0", "cc by nd 4", True),
    ("cc-by-nc-4.0", " cc  by  nc ", r"cc by nc 4 0", "cc by nc 4", True),
    ("cc-by-nc-3.0", " cc  by  nc ", r"cc by nc 3 0", "cc by nc 3", True),
    ("cc-by-nc-sa-4.0", " cc  by  nc  sa ", r"cc by nc sa 4 0", "cc by nc sa 4", True),
    ("cc-by-nc-nd-4.0", " cc  by  nc  nd ", r"cc by nc nd 4 0", "cc by nc nd 4", True),
    ("cc-by", " cc  by ", r"cc by", "cc by only", False),
    ("cc-by-sa", " cc  by  sa ", r"cc by sa", "cc by sa only", False),
)

#: Whole notices and hints that aren't of the form of the names'.
NOTICES = (
    ("mit", " permission ", r"permission is hereby granted free of charge to any person obtaining a copy", NOTICE),
    ("mit", " without  restriction ", r"to deal in the software without restriction including without limitation", NOTICE),
    ("isc", " permission ", r"permission to use copy modify and or distribute this software for any purpose with or without fee", NOTICE),
    ("bsd", " redistribution ", r"redistribution and use in source and binary forms with or without modification are permitted", NOTICE),
    ("bsd-3-clause", " endorse ", r"neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products", NOTICE),
    ("apache-2.0", " compliance ", r"you may not use this file except in compliance with the licen[sc]e", GRANT),
    ("gpl-2.0", " redistribute ", r"redistribute it and or modify it under the terms of the gnu general public licen[sc]e(?: [^ ]+){1,12} version 2", NOTICE),
    ("gpl-3.0", " redistribute ", r"redistribute it and or modify it under the terms of the gnu general public licen[sc]e(?: [^ ]+){1,12} version 3", NOTICE),
    ("mpl-2.0", " source  code  form ", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", NOTICE),
    ("unlicense", " public  domain ", r"free and unencumbered software released into the public domain", NOTICE),
    ("public-domain", " public  domain ", r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain", GRANT),
    ("public-domain", " public  domain ", r"(?:is|are) in the public domain", NAME),
    ("wtfpl", " want ", r"do what the [^ ]+ you want to public licen[sc]e", NOTICE),
    ("beerware", " beer ", r"buy me a beer in return", NOTICE),
    ("proprietary", " confidential ", r"(?:proprietary and confidential|confidential and proprietary)", GRANT),
    ("proprietary", " written ", r"(?:without (?:the )?(?:prior )?(?:express )?written (?:permission|consent) of)", NAME),
    ("proprietary", " unauthorized ", r"unauthorized (?:copying|reproduction|distribution|use) (?:[^ ]+ ){0,8}(?:is )?(?:strictly )?prohibited", GRANT),
    ("all-rights-reserved", " rights  reserved ", r"all rights reserved", NAME),
    ("some-rights-reserved", " rights  reserved ", r"some rights reserved", NAME),
    ("no-rights-reserved", " rights  reserved ", r"no rights reserved", NAME),
    ("free-restricted", " personal ", r"(?:free )?for personal(?: and)? non(?: )?commercial use only", GRANT),
    ("free-restricted", " research ", r"for (?:academic and )?research (?:use|purposes) only", GRANT),
    ("free-restricted", " academic ", r"for academic (?:use|purposes) only", GRANT),
    ("other-permissive", " warranty ", r"provided as is without (?:any )?warranty of any kind", HINT),
    ("unknown-license", " license ", r"(?:see|refer to) (?:the )?(?:[^ ]+ )?license (?:file|txt|md)", HINT),
    ("unknown-license", " license ", r"(?:dual|open source|free software|public|commercial|proprietary) license", HINT),
    ("copyright", " copyright ", r"copyright(?: c)?(?: [^ ]+)? (?:19|20)[0-9][0-9]", HINT),
)

GIVEN = "(?:licen[sc]ed|released|distributed|published|available|provided|offered|shared|redistributed|covered)"


def rules() -> tuple[Rule, ...]:
    """All rules in order: the base phrases, whole notices, and five forms of each name."""
    found = [Rule(label, f" {phrase} ".replace(" ", "  ")[1:-1], phrase, NAME, True) for phrase, label in BASE]
    found += [Rule(label, keyword, pattern, priority) for label, keyword, pattern, priority in NOTICES]
    for label, keyword, name, tag, certain in NAMES:
        found.append(Rule(label, " spdx ", f"spdx licen[sc]e identifier {tag}", NOTICE))
        found.append(Rule(label, keyword, f"{GIVEN} (?:[^ ]+ )?under (?:an? |the )?(?:terms of (?:the )?|conditions of (?:the )?)?{name}(?: licen[sc]e)?", GRANT))
        found.append(Rule(label, keyword, f"(?:subject to|governed by|in accordance with|use of) (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?", GRANT if certain else HINT))
        found.append(Rule(label, keyword, f"(?:the )?{name} licen[sc]e", NAME))
        if certain:
            found.append(Rule(label, keyword, name, NAME))
    return tuple(found)


RULES = rules()


def spaced(pattern: str) -> str:
    """A rule's pattern over words with spaces of their own."""
    return f" {pattern.replace(' ', '  ')} "


def _bare(text: Column) -> Column:
    """The words of a text with two spaces between."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLITS, "  "))


def _once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is worked out once: a lambda's variable is a value, not an expression to evaluate anew wherever it stands."""
    return F.transform(F.array(value), fn)[0]


def _table(rules: tuple[Rule, ...]) -> Column:
    """The rules by keyword, as a constant."""
    by: dict[str, list[dict]] = {}
    for k, r in enumerate(rules):
        by.setdefault(r.keyword.lstrip(), []).append({"rule": k, "pattern": spaced(r.pattern), "label": r.label, "priority": r.priority, "base": r.base})
    kind = "array<struct<keyword: string, rules: array<struct<rule: int, pattern: string, label: string, priority: int, base: boolean>>>>"
    return F.from_json(F.lit(json.dumps([{"keyword": keyword, "rules": rows} for keyword, rows in by.items()])), kind)


def detections(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All matches in words with a space on both sides of each: array<struct<first, last, rule, label, priority, base>>, words counted from 0."""

    def of_rule(text: Column, rule: Column) -> Column:
        inner = F.substr(rule["pattern"], F.lit(2), F.length(rule["pattern"]) - 2)
        marked = F.regexp_replace(text, F.concat(F.lit(" ("), inner, F.lit(") ")), F.lit(" \x01$1\x02 "))
        words = F.split(F.trim(marked), "  ")
        # Matches of one rule don't overlap, so first and last words come in pairs.
        firsts = F.filter(F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit("\x01")), i.cast("bigint"))), lambda i: i.isNotNull())
        lasts = F.filter(F.transform(words, lambda w, i: F.when(F.endswith(w, F.lit("\x02")), i.cast("bigint"))), lambda i: i.isNotNull())
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["base"].alias("base")))

    gated = F.flatten(F.transform(F.filter(_table(rules), lambda k: F.contains(text, k["keyword"])), lambda k: k["rules"]))
    met = F.filter(gated, lambda r: F.regexp_like(text, r["pattern"]))
    return F.flatten(F.transform(met, lambda r: of_rule(text, r)))


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns ``keep`` of every row, ``n_words``, and ``detections``: array<struct<first, last, rule, label, priority, base, kept>> in order.

    ``kept`` is false for what a wider detection of no less priority covers. Names of ``keep`` may hold dots; clashes with the new columns are the caller's to avoid.
    """
    names = [f"kept_{i}" for i in range(len(keep))]
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    n_words = lambda t: F.when(t == "", 0).otherwise((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit("")))) / 2 + 1).cast("bigint")
    seen = _once(_bare(quoted(text_col)), lambda t: F.struct(n_words(t).alias("n"), _once(F.concat(F.lit(" "), t, F.lit(" ")), lambda w: detections(w, rules)).alias("found")))
    found = docs.select(*(quoted(c).alias(n) for c, n in zip(keep, names, strict=True)), seen.alias("seen"), F.monotonically_increasing_id().alias("row"))
    flat = found.select(*names, F.col("seen.n").alias("n_words"), "row", F.explode_outer("seen.found").alias("d"))
    order = Window.partitionBy("row").orderBy("d.first", F.desc("d.last"), F.desc("d.priority"), "d.rule").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for p in sorted({r.priority for r in rules}):
        wider = F.max(F.when(F.col("d.priority") >= p, F.col("d.last"))).over(order)
        covered = covered | F.coalesce((F.col("d.priority") == p) & (wider >= F.col("d.last")), F.lit(False))
    judged = flat.withColumn("covered", covered)
    one = F.struct("d.first", F.negative("d.last").alias("back"), F.negative("d.priority").alias("low"), "d.rule", "d.last", "d.label", "d.priority", "d.base", (~F.col("covered")).alias("kept"))
    rows = judged.groupBy("row").agg(*(F.first(n).alias(n) for n in [*names, "n_words"]), F.array_sort(F.collect_list(F.when(F.col("d").isNotNull(), one))).alias("ds"))
    whole = F.transform("ds", lambda d: F.struct(*(d[c].alias(c) for c in ("first", "last", "rule", "label", "priority", "base", "kept"))))
    return rows.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "n_words", whole.alias("detections"))


def summary(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with n_words, n_base, first_word, last_word, base_labels, labels and score: the relevance of the strongest kept detection."""
    base = F.filter("detections", lambda d: d["base"])
    kept = F.filter("detections", lambda d: d["kept"])
    joined = lambda ds: F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda d: d["label"]))), ",")
    relevance = F.create_map(*(F.lit(x) for pair in RELEVANCE.items() for x in pair))
    return scanned.select(
        *(F.col(f"`{c.replace('`', '``')}`") for c in keep),
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["first"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.filter("detections", lambda d: d["base"] | d["kept"])).alias("labels"),
        F.coalesce(F.array_max(F.transform(kept, lambda d: F.element_at(relevance, d["priority"]))), F.lit(0.0)).alias("score"),
    )
