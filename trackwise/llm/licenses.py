"""Licence scan by Dice coefficient over word bigrams, in DataFrame functions only.

Units of a document - its sentences (those of paragraphs, over line breaks, and those of lines), lines, paragraphs and the
whole text - are normalised (lower case, words of letters and digits) and compared with licence templates (notices, titles
and short licences whole): twice the shared bigrams over the sum of both numbers. Before any set is built, a size bound
drops templates that can't reach the threshold: with b bigrams in a template, a unit needs between b * d / (2 - d) and
b * (2 - d) / d of them. Near templates differ in few words that matter, so a unit must also hold the bigrams that tell a
licence and its version (``MUST``); of the templates left, the nearest counts. The templates are a fixed short list, so the
scan is one pass without a join. Long licences are found by their titles and by the notice that their appendix holds.

Defined results: null, empty or one-word units have no bigrams and match nothing; ties go to the shortest unit, then the
first by code point; a unit as near to several licences is reported for each; a text with BSD-3-Clause isn't reported as
BSD-2-Clause, whose words it holds; repeated rows are reported once per id, a null id as null; texts of any length are read
whole, memory being in proportion to the text; an empty table gives an empty result. Only id and text are read, so other
columns may have any names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let

# Licence notices, titles and short licences by identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]
# Bigrams without which a unit isn't that licence.
MUST = {
    "Apache-2.0": ["2 0"], "GPL-2.0": ["gnu general", "version 2"], "GPL-3.0": ["gnu general", "version 3"], "LGPL-2.1": ["gnu lesser", "2 1"], "LGPL-3.0": ["gnu lesser", "version 3"],
    "AGPL-3.0": ["gnu affero", "version 3"], "MPL-2.0": ["2 0"], "EPL-2.0": ["2 0"], "CC-BY-4.0": ["4 0"], "CC-BY-SA-4.0": ["by sa", "4 0"], "CC-BY-NC-4.0": ["by nc", "4 0"], "CC-BY-ND-4.0": ["by nd", "4 0"], "CC0-1.0": ["1 0"],
}
#: A licence that holds another one's words.
HOLDS = {"BSD-3-Clause": "BSD-2-Clause"}
DICE = 0.8


def _norm(text: str) -> list[str]:
    w = [x for x in re.split(r"[^\w]+|_", text.lower()) if x]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


#: Beginnings of words, so many of every template that a unit without any of them lacks too many bigrams to match it.
HINT = r"(?i)(?<![\p{L}\p{N}])(?:licen[sc]|releas|permi|reserved|distribut|redistribut|software|copyright|cop(?:y|ies)|notice|document|restrict|sublicen|publish|merge|modif|furnish|obtain|hereby|granted|condition|gnu|mozilla|mpl|cc|bsd|clause|unencumber|domain|apache|limitation|portions|foundation|version|source|purpose|compliance|charge|associated|persons|public|eclipse|accompany|materials|available|contribut|endors|promot|products|derived|holder)"


def _hinted(dice: float) -> bool:
    """Whether what HINT leaves out can't reach dice with any template."""
    hint = re.compile(HINT.replace(r"(?<![\p{L}\p{N}])", r"(?<![^\W_])"))
    return all(sum(not hint.search(x) for x in _norm(body)) < _bounds(len(_norm(body)), dice)[0] for _, body in TEMPLATES)


def _bigrams(unit: Column) -> Column:
    w = F.filter(F.split(F.lower(unit), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def _bounds(m: int, dice: float) -> tuple[int, int]:
    """The fewest and the most bigrams of a unit that can reach dice with m of a template, by the comparison of ``scan``."""
    fits = [n for n in range(1, int(m * (2 - dice) / dice) + 2) if 2.0 * min(n, m) / (n + m) >= dice]
    return (fits[0], fits[-1]) if fits else (1, 0)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", dice: float = DICE) -> DataFrame:
    """doc_id, license, dice, unit: the best unit of each document for each licence it reaches the threshold with."""
    t = docs[text]
    hint = HINT if _hinted(dice) else ""
    df = docs.select(docs[key].alias("doc_id"), F.when(t.rlike(hint), t).alias("t")).where(F.col("t").isNotNull())
    lines, paras, sents = F.split("t", r"\n"), F.split("t", rf"\n[{SPACE}]*\n"), F.split("t", rf"(?<=[.!?])[{SPACE}]+|\n")
    wrapped = F.split("t", rf"(?<=[.!?])[{SPACE}]+|\n[{SPACE}]*\n")
    spans = F.filter(F.array_distinct(F.concat(F.array("t"), paras, lines, sents, wrapped)), lambda u: u.rlike(hint))
    df = let(df, "u", units=F.transform(spans, lambda u: F.struct(u.alias("u"), _bigrams(u).alias("b"))))
    grams = [(name, _norm(body)) for name, body in TEMPLATES]

    def against(x: Column) -> Column:
        out = []
        for name, b in grams:
            fits = F.size(x.b).between(*_bounds(len(b), dice))
            for word in MUST.get(name, []):
                fits = fits & F.array_contains(x.b, word)
            both = F.size(F.array_intersect(x.b, F.array(*map(F.lit, b))))
            out.append(F.when(fits, F.struct(F.lit(name).alias("license"), (2.0 * both / (F.size(x.b) + len(b))).alias("dice"), x.u.alias("unit"))))
        near = F.filter(F.array(*out), lambda m: m.dice >= dice)
        # A unit is the licence that it is nearest to.
        return F.filter(near, lambda m: m.dice == F.array_max(F.transform(near, lambda o: o.dice)))

    df = let(df, "u", hits=F.flatten(F.transform("u__units", against)))
    for more, less in HOLDS.items():
        df = let(df, f"u_{less}", hits=F.filter("u__hits", lambda h: (h.license != less) | ~F.exists(F.col("u__hits"), lambda o: o.license == more))).withColumn("u__hits", F.col(f"u_{less}__hits"))  # noqa: B023
    hits = df.select("doc_id", F.inline("u__hits"))
    # The hits of one document and licence are few; repeated ids come together.
    top = hits.groupBy("doc_id", "license").agg(F.min(F.struct((-F.col("dice")).alias("d"), F.length("unit").alias("n"), F.col("unit").alias("u"))).alias("m"))
    return top.select("doc_id", "license", (-F.col("m.d")).alias("dice"), F.col("m.u").alias("unit"))


def oracle(dice: float = DICE) -> str:
    """The same in DuckDB: every unit against every template, without bounds or hints."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(map(quoted, xs)) + "]"
    rows = ", ".join(f"({quoted(name)}, {listed(_norm(body))}, {listed(MUST.get(name, [])) if name in MUST else '[]::varchar[]'})" for name, body in TEMPLATES)
    holds = " ".join(f"and not (license = {quoted(less)} and exists (select 1 from near o where o.doc_id is not distinct from near.doc_id and o.license = {quoted(more)}))" for more, less in HOLDS.items())
    return rf"""with templates(license, grams, must) as (values {rows}),
  marked as (select doc_id, text, regexp_replace(text, '([.!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g') as m from documents where text is not null),
  units as (select distinct doc_id, unnest(list_concat([text], regexp_split_to_array(text, '\n'), regexp_split_to_array(text, '\n[\x20\x09-\x0D]*\n'), regexp_split_to_array(m, '\x01|\n'), regexp_split_to_array(m, '\x01|\n[\x20\x09-\x0D]*\n'))) as unit from marked),
  w as (select doc_id, unit, list_filter(regexp_split_to_array(lower(unit), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from units),
  b as (select doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from w where len(w) > 1),
  scored as (select doc_id, unit, license, 2.0 * len(list_intersect(b, grams)) / (len(b) + len(grams)) as dice from b, templates where list_has_all(b, must) and 2.0 * least(len(b), len(grams)) / (len(b) + len(grams)) >= {dice}),
  near as (select * from scored where dice >= {dice} qualify dice = max(dice) over (partition by doc_id, unit)),
  fit as (select * from near where true {holds})
select doc_id, license, dice::double as dice, unit from fit qualify row_number() over (partition by doc_id, license order by dice desc, length(unit), unit) = 1"""
