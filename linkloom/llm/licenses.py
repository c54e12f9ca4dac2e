"""Licence scans: lines and paragraphs against licence templates by the Dice coefficient over word bigrams.

DataFrame operations only, in one projection: no shuffle, no join. A segment (a line, or a paragraph between empty
lines) is lower-cased, everything but a-z and 0-9 is a blank, and its word bigrams are a multiset. Two bounds prune
exactly: with Dice >= t, bigram counts differ at most by the factor (2 - t) / t, and a segment shares at least
t / (2 - t) of a template's bigrams. So a segment that has none of a few words which together touch more than the rest
of a template's bigrams can't match it; one regular expression of those words for all templates goes over the text
first.

Defined cases: null and empty texts, and segments of fewer than two words, match nothing (0 segments, null licence,
null score); equal segments of a document count once; ties between templates go to the first; texts are whole, of any length;
repeated rows give repeated rows; input columns named like the new ones are replaced, all others stay whatever their
names; an empty table gives an empty table.

scan() sees a line or paragraph only as a whole. runs() compares every run of consecutive words of the text, so it also
finds notices inside a line of prose and headers whose lines begin with comment marks. A best run begins and ends with
a bigram of the template, so only these places are tried; a text without a few telling bigrams is passed over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import unused

#: Notices and short texts of public licences, by identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("BSD-2-Clause", "Licensed under the 2-Clause BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("Artistic-2.0", "This program is distributed under the terms of the Artistic License 2.0."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
)
#: Words that hardly occur outside of licences come first where a template's telling words are chosen.
COMMON = set("a all and any are as at by for free in is it no not of on or that the this to under use with without work you".split())


def plain(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    """Word bigrams, each with its number among equals, so that sets of these are multisets of bigrams."""
    seen: Counter = Counter()
    out = []
    for pair in zip(words, words[1:], strict=False):
        seen[pair] += 1
        out.append(f"{pair[0]} {pair[1]} {seen[pair]}")
    return out


def telling(words: list[str], least: float) -> list[str]:
    """Few words of a template, so that each text with Dice >= least has one of them: their bigrams are too many to miss."""
    pairs = list(zip(words, words[1:], strict=False))
    left, out = set(range(len(pairs))), []
    may_miss = len(pairs) * (1 - least / (2 - least))
    while len(pairs) - len(left) <= may_miss:
        gain = Counter(w for i in left for w in set(pairs[i]))
        best = max(gain, key=lambda w: (w not in COMMON, gain[w], w))
        out.append(best)
        left = {i for i in left if best not in pairs[i]}
    return out


def scan(df: DataFrame, text: str = "text", least: float = 0.8, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """df with n_segments long (distinct segments that match a template), license string and dice double of the best one."""
    words = [plain(t) for _, t in templates]
    sizes = [len(w) - 1 for w in words]
    low, high = min(sizes) * least / (2 - least), max(sizes) * (2 - least) / least
    trigger = r"(?<![a-z0-9])(?:" + "|".join(sorted({w for x in words for w in telling(x, least)})) + r")(?![a-z0-9])"

    def numbered(pairs: Column) -> Column:
        count = lambda p, i: F.size(F.filter(F.slice(pairs, 1, i + 1), lambda q: q == p))
        return F.transform(pairs, lambda p, i: F.concat(p, F.lit(" "), count(p, i).cast("string")))

    def paired(ws: Column) -> Column:
        return F.when(F.size(ws) > 1, F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.concat(F.element_at(ws, i), F.lit(" "), F.element_at(ws, i + 1)))).otherwise(F.array().cast("array<string>"))

    lines, blocks = F.split(F.col(text), "\n"), F.split(F.col(text), "\n[ \t\r]*\n")
    # the same words decide on the lower-cased text, a segment, and its words
    segments = F.array_distinct(F.transform(F.filter(F.concat(lines, blocks), lambda s: F.lower(s).rlike(trigger)), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))))
    fitting = F.filter(F.transform(segments, lambda s: F.split(s, " ")), lambda ws: F.size(ws).between(int(low) + 1, int(high) + 2))

    def best(ws: Column) -> Column:
        own = numbered(paired(ws))
        n = F.size(ws) - 1

        def of(k: int) -> Column:
            size = sizes[k]
            dice = 2.0 * F.size(F.array_intersect(own, F.array(*[F.lit(b) for b in bigrams(words[k])]))) / (n + size)
            fits = n.between(int(size * least / (2 - least)), int(size * (2 - least) / least) + 1)
            return F.when(fits & (dice >= least), F.struct(dice.alias("dice"), F.lit(-k).alias("order"), F.lit(templates[k][0]).alias("license")))

        return F.array_max(F.array(*[of(k) for k in range(len(templates))]))

    hits = F.when(F.lower(F.col(text)).rlike(trigger), F.filter(F.transform(fitting, best), lambda b: b.isNotNull()))
    names = {"n_segments", "license", "dice"}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    name = unused(df, "hits")
    found, top = df.withColumn(name, hits), F.array_max(name)
    return found.select(*kept, F.coalesce(F.size(name), F.lit(0)).cast("long").alias("n_segments"), top["license"].alias("license"), top["dice"].alias("dice"))


def telling_pairs(words: list[str], least: float) -> set[tuple[str, str]]:
    """Few bigrams of a template, so that each run with Dice >= least has one of them."""
    times = Counter(zip(words, words[1:], strict=False))
    may_miss = (len(words) - 1) * (1 - least / (2 - least))
    out: set[tuple[str, str]] = set()
    for p in sorted(times, key=lambda p: (sum(w in COMMON for w in p), -times[p], p)):
        if sum(times[q] for q in out) > may_miss:
            break
        out.add(p)
    return out


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def runs(df: DataFrame, text: str = "text", least: float = 0.8, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """df with n_licenses long (distinct licences that a run of words matches), license string and dice double of the best run."""
    words = [plain(t) for _, t in templates]
    times = [Counter(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)) for w in words]
    seconds: dict[str, set[str]] = {}
    for w in words:
        for a, b in telling_pairs(w, least):
            seconds.setdefault(a, set()).add(b)
    trigger = "(?<![a-z0-9])(?:" + "|".join(f"{a}[^a-z0-9]+(?:{'|'.join(sorted(bs))})" for a, bs in sorted(seconds.items())) + ")(?![a-z0-9])"
    every = sorted(set().union(*times))

    def best(k: int, hits: Column) -> Column:
        size = sum(times[k].values())
        far, need = int(size * (2 - least) / least) + 1, max(1, int(size * least / (2 - least)))
        often = lambda b: F.coalesce(*[F.when(b == p, F.lit(n)) for p, n in times[k].items() if n > 1], F.lit(1))

        def with_limit(h: Column) -> Column:
            """Each hit with the latest begin from before which it is one too many of its bigram, or 0."""
            earlier = lambda x, j: F.filter(F.slice(h, F.greatest(j - far, F.lit(0)) + 1, F.least(j, F.lit(far))), lambda y: y["b"] == x["b"])
            limit = lambda x, j: let(earlier(x, j), lambda e: F.when(F.size(e) >= often(x["b"]), F.element_at(e, -often(x["b"]))["i"]).otherwise(0))
            return F.transform(h, lambda x, j: F.struct(x["i"].alias("i"), limit(x, j).alias("limit")))

        def from_each(h: Column) -> Column:
            def step(a: Column) -> Callable[[Column, Column], Column]:
                def f(acc: Column, y: Column) -> Column:
                    both = acc["both"] + F.when(y["limit"] < a["i"], 1).otherwise(0)
                    return F.struct(both.alias("both"), F.greatest(acc["dice"], 2.0 * both / (y["i"] - a["i"] + 1 + size)).alias("dice"))

                return f

            start = F.struct(F.lit(0).alias("both"), F.lit(0.0).alias("dice"))
            dense = lambda a, j: F.get(h, j + need - 1)["i"] - a["i"] < far
            return F.array_max(F.transform(h, lambda a, j: F.when(dense(a, j), F.aggregate(F.slice(h, j + 1, far), start, step(a))["dice"])))

        mine = F.filter(hits, lambda x: x["b"].isin(*times[k]))
        dice = let(mine, lambda h: F.when(F.size(h) >= need, let(with_limit(h), from_each)))
        return let(dice, lambda d: F.when(d >= least, F.struct(d.alias("dice"), F.lit(-k).alias("order"), F.lit(templates[k][0]).alias("license"))))

    def hits_of(ws: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.struct(i.alias("i"), F.concat(F.element_at(ws, i), F.lit(" "), F.element_at(ws, i + 1)).alias("b")))
        return F.filter(pairs, lambda x: x["b"].isin(*every))

    ws = F.split(F.trim(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", " ")), " ")
    of_each = let(let(ws, hits_of), lambda h: F.array(*[best(k, h) for k in range(len(templates))]))
    names = {"n_licenses", "license", "dice"}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    name = unused(df, "hits")
    found = df.withColumn(name, F.when(F.lower(F.col(text)).rlike(trigger), F.filter(of_each, lambda b: b.isNotNull())))
    top = F.array_max(name)
    n = F.size(F.array_distinct(F.transform(name, lambda b: b["license"])))
    return found.select(*kept, F.when(F.col(name).isNull(), 0).otherwise(n).cast("long").alias("n_licenses"), top["license"].alias("license"), top["dice"].alias("dice"))


def runs_oracle(least: float = 0.8) -> str:
    """The rows of runs() by DuckDB: every run that begins and ends with a bigram of a template, without a choice of telling ones."""
    values = ", ".join(f"({k}, '{name}', '{' '.join(plain(t))}')" for k, (name, t) in enumerate(TEMPLATES))
    return f"""
        WITH t AS (SELECT * FROM (VALUES {values}) AS x(k, license, words)),
        tb AS (SELECT k, b, count(*) AS c FROM (SELECT k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM (SELECT k, string_split(words, ' ') AS w FROM t)) GROUP BY ALL),
        ts AS (SELECT k, sum(c)::BIGINT AS n FROM tb GROUP BY k),
        dw AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
        db AS (SELECT doc_id, unnest(range(1, len(w))) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM dw),
        h AS (SELECT doc_id, k, n, i, b, c FROM db JOIN tb USING (b) JOIN ts USING (k)),
        e AS (SELECT doc_id, k FROM h GROUP BY doc_id, k, n HAVING count(*) >= n * {least} / (2 - {least}) - 1e-6),
        g AS (SELECT h.* FROM h JOIN e USING (doc_id, k)),
        r AS (SELECT a.doc_id, a.k, a.n, a.i AS i, z.i AS j FROM g a JOIN g z ON a.doc_id = z.doc_id AND a.k = z.k AND z.i BETWEEN a.i AND a.i + a.n * (2 - {least}) / {least}),
        m AS (SELECT r.doc_id, r.k, r.n, r.i, r.j, g.b, least(count(*), g.c) AS c FROM r JOIN g ON g.doc_id = r.doc_id AND g.k = r.k AND g.i BETWEEN r.i AND r.j GROUP BY r.doc_id, r.k, r.n, r.i, r.j, g.b, g.c),
        d AS (SELECT doc_id, k, 2.0::DOUBLE * sum(c) / (j - i + 1 + n) AS dice FROM m GROUP BY doc_id, k, n, i, j),
        o AS (SELECT doc_id, k, max(dice) AS dice FROM d WHERE dice >= {least} GROUP BY ALL),
        f AS (SELECT o.*, t.license, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, k) AS r FROM o JOIN t USING (k)),
        c AS (SELECT doc_id, count(DISTINCT license) AS n FROM f GROUP BY 1)
        SELECT documents.doc_id, coalesce(c.n, 0) AS n_licenses, f.license, f.dice
        FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN f ON f.doc_id = documents.doc_id AND f.r = 1"""


def oracle(least: float = 0.8) -> str:
    """The same rows by DuckDB, every segment against every template of a fitting size."""
    values = ", ".join(f"({k}, '{name}', '{' '.join(plain(t))}')" for k, (name, t) in enumerate(TEMPLATES))
    return f"""
        WITH t AS (SELECT * FROM (VALUES {values}) AS x(k, license, words)),
        tb AS (SELECT k, b, count(*) AS c FROM (SELECT k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM (SELECT k, string_split(words, ' ') AS w FROM t)) GROUP BY ALL),
        ts AS (SELECT k, sum(c) AS n FROM tb GROUP BY k),
        s AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(seg), '[^a-z0-9]+', ' ', 'g')) AS seg FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS seg FROM documents
            UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) FROM documents)),
        sw AS (SELECT doc_id, seg, string_split(seg, ' ') AS w FROM s WHERE len(string_split(seg, ' ')) BETWEEN 2 AND 200),
        sb AS (SELECT doc_id, seg, b, count(*) AS c FROM (SELECT doc_id, seg, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM sw) GROUP BY ALL),
        p AS (SELECT sb.doc_id, sb.seg, tb.k, sum(least(sb.c, tb.c)) AS both FROM sb JOIN tb USING (b) GROUP BY ALL),
        d AS (SELECT p.doc_id, p.seg, p.k, 2.0::DOUBLE * p.both / (len(sw.w) - 1 + ts.n) AS dice FROM p JOIN sw USING (doc_id, seg) JOIN ts USING (k)),
        h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, k) AS r FROM d WHERE dice >= {least}),
        g AS (SELECT doc_id, count(DISTINCT seg) AS n FROM h GROUP BY doc_id)
        SELECT documents.doc_id, coalesce(g.n, 0) AS n_segments, t.license, h.dice
        FROM documents LEFT JOIN g USING (doc_id) LEFT JOIN h ON h.doc_id = documents.doc_id AND h.r = 1 LEFT JOIN t ON t.k = h.k"""
