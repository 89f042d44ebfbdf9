"""Licence recognition by known sentences and ordered rules over their sequence.

A text is cut into sentences; each is normalised (lower case, runs of other characters than letters and
digits to one space) and mapped to the identifier of a known licence sentence.  A sentence that is not known
is tried line by line.  The identifiers of a text, in order, form a string of one character each; the
rules are tried in their order at each place of it, from left to right, without overlap, so that a full licence
text wins over the single grants in it.

Only DataFrame functions are used.  Nulls: a NULL text has no sentences.  Rows are independent: equal rows get equal
results, no row is dropped.  An empty table gives an empty table.
"""
from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from seasonlens.llm.store import set_aside

# Ways to grant, and public licences by their usual names.
GRANTS = ("licensed under", "released under", "distributed under", "available under", "published under", "provided under")
SUBJECTS = ("", "this work is", "this software is", "this project is", "this file is", "this document is", "this code is",
            "the source code is", "this program is", "this dataset is", "this text is", "it is")
PLAIN = {
    "MIT": ("mit license", "mit licence"),
    "ISC": ("isc license",),
    "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "new bsd license", "modified bsd license"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license version 2 0 the license"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0"),
    "Unlicense": ("unlicense",),
}
GNU = {"GPL": "gnu general public license", "LGPL": "gnu lesser general public license", "AGPL": "gnu affero general public license"}
GNU_VERSIONS = ("2", "2 1", "3", "2 0", "3 0")
CREATIVE = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CREATIVE_VERSIONS = ("2 0", "2 5", "3 0", "4 0")

# The sentences of common licence texts and notices.
TEXTS = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-compliance": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "reserved": "All rights reserved.",
}
#: What every known sentence contains, so that texts without any of it need no sentences.
MARK = (r"(?i)licen[sc]e|(?:released|distributed|available|published|provided)[^a-z0-9]+under|permission|reserved|redistribution|"
        r"copyright|as[^a-z0-9]+is|copy[^a-z0-9]+of")

_SPLIT = "([.!?;:])[\\x20\\x09-\\x0D]+|\\n[\\x20\\x09-\\x0D]*\\n"


def normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).strip()


def _names() -> dict[str, list[str]]:
    out = {k: list(v) for k, v in PLAIN.items()}
    for (short, name), v in product(GNU.items(), GNU_VERSIONS):
        dotted = v.replace(" ", ".") if " " in v else v + ".0"
        out.setdefault(f"{short}-{dotted}", []).extend(n + later for n in (
            f"{name} version {v}", f"{name} v{v}", f"gnu {short.lower()} version {v}", f"gnu {short.lower()} v{v}", f"{short.lower()} v{v}")
            for later in ("", " or later", " or any later version"))
    for kind, v in product(CREATIVE, CREATIVE_VERSIONS):
        out[f"CC-{kind.upper().replace(' ', '-')}-{v.replace(' ', '.')}"] = [
            f"{cc} {kind} {v}{end}" for cc in ("cc", "creative commons") for end in ("", " license")]
    return out


#: The front of a sentence that grants a licence by its name, in normalised form.
_GRANT = f"^(?:(?:{'|'.join(x for x in SUBJECTS if x)}) )?(?:{'|'.join(GRANTS)}) (?:a |the )?"


def dictionary() -> tuple[dict[str, str], list[tuple[str, str]]]:
    """(normalised sentence -> identifier, ordered rules as (pattern over identifiers, licence))."""
    names = _names()
    code: dict[str, str] = {}
    sign = lambda key: code.setdefault(key, chr(0xE000 + len(code)))
    known = {normal(text): sign(key) for key, text in TEXTS.items()}
    for licence, forms in names.items():
        for form in forms:
            known.setdefault(f"grant of {form}", sign("grant:" + licence))
    known = {re.sub(_GRANT, "grant of ", k): v for k, v in known.items()}
    s = lambda *keys: "".join(sign(k.rstrip("?")) + ("?" if k.endswith("?") else "") for k in keys)
    rules = [
        (s("reserved?", "mit-grant", "mit-notice?", "mit-warranty?"), "MIT"),
        (s("grant:Apache-2.0", "apache-compliance?", "apache-copy?", "apache-warranty?"), "Apache-2.0"),
        (s("reserved?", "bsd-grant", "bsd-source", "bsd-binary"), "BSD"),
        (s("isc-grant"), "ISC"),
        *[(s("grant:" + licence), licence) for licence in names if licence != "Apache-2.0"],
        (s("reserved"), "All-Rights-Reserved"),
    ]
    return known, rules


ADDED = ("licence_ids", "licences")
NAMES = ADDED


def _normal(s: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_replace(F.trim(F.regexp_replace(F.translate(s, upper, lower), "[^a-z0-9]+", " ")), _GRANT, "grant of ")


def find_licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``licence_ids`` (the identifiers of their known sentences, in order) and ``licences`` (what
    the rules make of them, in order)."""
    docs = set_aside(docs, NAMES)
    known, rules = dictionary()
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    sentences = F.split(F.regexp_replace(F.col(text), _SPLIT, "$1\u0001"), "\u0001")
    whole = F.transform(sentences, lambda s: F.struct(s.alias("s"), F.try_element_at(table, _normal(s)).alias("id")))
    ids = F.flatten(F.transform(whole, lambda x: F.when(x["id"].isNotNull(), F.array(x["id"])).otherwise(
        F.transform(F.split(x["s"], "\n"), lambda l: F.try_element_at(table, _normal(l))))))
    ids = F.when(F.col(text).rlike(MARK), F.array_join(F.filter(ids, lambda i: i.isNotNull()), ""))
    found = F.regexp_extract_all("licence_ids", F.lit("|".join(p for p, _ in rules)), F.lit(0))
    # the first rule that matches the whole of what was found, in the same order
    named = F.transform(found, lambda m: F.coalesce(*[F.when(m.rlike(f"^(?:{p})$"), F.lit(name)) for p, name in rules]))
    out = docs.withColumn("licence_ids", F.coalesce(ids, F.lit("")))
    return out.withColumn("licences", F.when(F.col("licence_ids") == "", F.array().cast("array<string>")).otherwise(named))


def oracle_sql() -> str:
    """The same over ``documents``, with the dictionary as rows."""
    known, rules = dictionary()
    q = lambda s: "'" + s.replace("'", "''") + "'"
    upper, lower = q("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), q("abcdefghijklmnopqrstuvwxyz")
    norm = lambda x: f"regexp_replace(trim(regexp_replace(translate({x}, {upper}, {lower}), '[^a-z0-9]+', ' ', 'g')), {q(_GRANT)}, 'grant of ')"
    rows = ", ".join(f"({q(a)}, {q(b)})" for a, b in known.items())
    case = " ".join(f"WHEN regexp_full_match(m, {q(p)}) THEN {q(n)}" for p, n in rules)
    return rf"""
WITH known(s, id) AS (VALUES {rows}),
cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?;:])[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents),
sent AS (SELECT doc_id, unnest(ss) AS t, generate_subscripts(ss, 1) AS i FROM cut),
a AS (SELECT doc_id, i, t, id FROM (SELECT *, {norm('t')} AS n FROM sent) LEFT JOIN known ON n = s),
l AS (SELECT doc_id, i, unnest(string_split(t, chr(10))) AS t, generate_subscripts(string_split(t, chr(10)), 1) AS j FROM a WHERE id IS NULL),
ids AS (SELECT doc_id, i, 0 AS j, id FROM a WHERE id IS NOT NULL UNION ALL
        SELECT doc_id, i, j, known.id FROM l JOIN known ON {norm('l.t')} = s),
seq AS (SELECT doc_id, string_agg(id, '' ORDER BY i, j) AS ids FROM ids GROUP BY doc_id),
hit AS (SELECT doc_id, list_transform(regexp_extract_all(ids, {q('|'.join(p for p, _ in rules))}), lambda m: CASE {case} END) AS names FROM seq)
SELECT d.doc_id, coalesce(length(seq.ids), 0) AS n_sentences, coalesce(len(names), 0) AS n_licences,
       coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS licences
FROM documents d LEFT JOIN seq USING (doc_id) LEFT JOIN hit USING (doc_id)
"""
