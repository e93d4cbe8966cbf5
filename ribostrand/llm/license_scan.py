"""License scans by sentence rules, in DataFrame functions alone.

A text is lower-cased and cut into pieces at line ends and at . ! ? ; : before
white space or the end; a piece is normalised to its runs of a-z and 0-9 with
single spaces between. A sentence is a piece, or several that follow each other
with only soft cuts between: line ends (of wrapped lines), colons and the stop
of "v."; other stops and lines without a-z and 0-9 always end it. Known
sentences have identifiers; of two that start at one piece the longer counts,
and the search goes on behind it. A document's
identifiers, in order, are matched against the licence rules: a rule holds if
its identifiers occur one after the other, without a known sentence between.
The rules are ordered; the first that holds is the document's licence.

Edge cases: a null or empty text, like one without known sentences, has no
identifiers and a null licence; repeated rows get a row each; sentences that
occur several times keep all their places; empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT = r"[.!?;:]+(\s|\z)"
PLAIN = "[^a-z0-9]+"
# Hard and soft cuts as characters of the normalised text; patterns and what takes their place, in this order.
HARD, SOFT = "\x01", "\x02"
STEPS = [
    (r"[\x01\x02]", " "), (r"\n[^a-z0-9\n]*+(?=\n)", "\n" + HARD), (r"(?<=\bv)\.\s", SOFT), (r"(?<![.!?;:]):++(?:\s|\z)", SOFT), (r"(?<![.!?;:])[.!?;:]++(?:\s|\z)", HARD),
    (r"\n", SOFT), (r"[^a-z0-9\x01\x02]++", " "), (r"(?<![ \x02])[ \x02]*+\x01[ \x01\x02]*+", HARD), (r"(?<! ) ?\x02[ \x02]*+", SOFT), (r"^ | \z", ""),
]

# Wording of public licences and licence notices, as normalised sentences.
SENTENCES = {
    "mit_notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "license mit", "spdx license identifier mit"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_condition": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as_is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "apache2_notice": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0", "spdx license identifier apache 2 0"],
    "apache2_use": ["you may not use this file except in compliance with the license"],
    "gpl3_notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "spdx license identifier gpl 3 0 only"],
    "gpl2_notice": ["licensed under the gnu general public license version 2", "spdx license identifier gpl 2 0 only"],
    "gpl_or_later": ["this program is free software", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "cc_by_nc4_notice": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc_by4_notice": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc0_notice": ["released under cc0 1 0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "bsd_redistribution": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl2_notice": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
RULES = [
    ("MIT", ["mit_grant", "mit_condition", "as_is"]),
    ("BSD-3-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary"]),
    ("GPL-3.0-or-later", ["gpl_or_later", "gpl_or_later"]),
    ("Apache-2.0", ["apache2_notice", "apache2_use"]),
    ("Apache-2.0", ["apache2_notice"]),
    ("MIT", ["mit_notice"]),
    ("GPL-3.0", ["gpl3_notice"]),
    ("GPL-2.0", ["gpl2_notice"]),
    ("CC-BY-NC-4.0", ["cc_by_nc4_notice"]),
    ("CC-BY-4.0", ["cc_by4_notice"]),
    ("CC0-1.0", ["cc0_notice"]),
    ("ISC", ["isc_grant"]),
    ("MPL-2.0", ["mpl2_notice"]),
    ("Unlicense", ["unlicense"]),
]


def normalised(text: Column) -> Column:
    """The words of a text in order, with a space, a soft or a hard cut between."""
    out = F.lower(text)
    for pattern, instead in STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(instead))
    return out


def identifiers(text: Column, known: dict[str, list[str]]) -> Column:
    """The identifiers of a text's known sentences, in order."""
    table = F.create_map(*[F.lit(x) for name, wordings in known.items() for w in wordings for x in (w, name)])
    wordings = sorted({w for ws in known.values() for w in ws}, key=lambda w: (-len(w), w))
    pattern = r"(?<![^\x01\x02])(?:" + "|".join(w.replace(" ", r"[ \x02]") for w in wordings) + r")(?![^\x01\x02])"
    return F.transform(F.regexp_extract_all(normalised(text), F.lit(pattern), F.lit(0)), lambda s: F.try_element_at(table, F.translate(s, SOFT, " ")))


def license_scan(df: DataFrame, known: dict[str, list[str]] | None = None, rules: list[tuple[str, list[str]]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: key, n_known (known sentences), sentence_ids (comma-joined), license (of the first rule that holds), licenses (of all that hold, in order, comma-joined)."""
    known, rules = known or SENTENCES, rules or RULES
    found = df.select(F.col(key), identifiers(F.coalesce(F.col(text).cast("string"), F.lit("")), known).alias("ids"))
    line = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))
    holds = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(F.col("line"), F.lit("," + ",".join(ids) + ",")), F.lit(name)) for name, ids in rules])))
    return (
        found.select(key, F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), line.alias("line"))
        .select(key, "n_known", "sentence_ids", holds.alias("holds"))
        .select(key, "n_known", "sentence_ids", F.try_element_at("holds", F.lit(1)).alias("license"), F.array_join("holds", ",").alias("licenses"))
    )


def license_sql() -> str:
    """The same over the table documents, in DuckDB SQL, for known sentences without a soft cut inside: wrapped ones are beyond it."""
    table = ", ".join(f"'{w}': '{name}'" for name, wordings in SENTENCES.items() for w in wordings)
    holds = ", ".join(f"CASE WHEN contains(line, ',{','.join(ids)},') THEN '{name}' END" for name, ids in RULES)
    return f"""
WITH s AS (SELECT doc_id, string_split(regexp_replace(lower(coalesce(text, '')), '{CUT}', chr(10), 'g'), chr(10)) AS cut FROM documents),
n AS (SELECT doc_id, list_filter(list_transform(cut, lambda x: MAP {{{table}}}[trim(regexp_replace(x, '{PLAIN}', ' ', 'g'))]), lambda x: x IS NOT NULL) AS ids FROM s),
l AS (SELECT doc_id, len(ids) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, ',' || coalesce(array_to_string(ids, ','), '') || ',' AS line FROM n),
h AS (SELECT *, list_filter([{holds}], lambda x: x IS NOT NULL) AS every FROM l),
d AS (SELECT *, list_filter(every, lambda x, i: list_position(every, x) = i) AS holds FROM h)
SELECT doc_id, n_known, sentence_ids, CASE WHEN len(holds) > 0 THEN holds[1] END AS license, coalesce(array_to_string(holds, ','), '') AS licenses FROM d"""
