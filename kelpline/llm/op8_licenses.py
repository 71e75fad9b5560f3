"""Licence scans by sentence rules. DataFrame functions only.

Texts are cut into sentences, these are normalised (lower case, runs of other than letters and digits as one space) and
looked up among known licence sentences. A line end within a paragraph is white space; a sentence that isn't known so is
cut at its line ends too, for notices that stand on a line of their own without a full stop. The sequence of identifiers found is matched against licence rules, each
an ordered list of identifiers that must follow one another; a longer rule takes its sentences from shorter ones. A
licence's whole text is known by its title and a sentence that only it has; the holder's name in a sentence is left open.

The SQL knows SENTENCES and RULES only and ends sentences at line ends. It gives the same rows where no licence is
wrapped or stated by one of PUBLISHED, as in the supplied tables.

Defined results: null is an empty text, in which nothing is found; repeated rows get the same result each; an empty
table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.common import table

#: Notices, and sentences of public licences, some of them shortened.
SENTENCES = (
    ("mit-notice", "Released under the MIT License."),
    ("mit-licensed", "Licensed under the MIT License."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("gpl3-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl2-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl3-notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-notice", "Licensed under CC BY 4.0."),
    ("cc-by-sa-notice", "Licensed under CC BY-SA 4.0."),
    ("cc0-notice", "Released under CC0 1.0 Universal."),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, subject to the following conditions:"),
    ("mit-keep", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("as-is", "The software is provided \"as is\", without warranty of any kind, express or implied."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but without any warranty."),
    ("rights", "All rights reserved."),
)
#: Sentences in full, as published (GPL: what follows the colon, where its sentence is cut).
PUBLISHED = (
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("as-is", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("gpl-free", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-free", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose."),
    ("lgpl21-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl3-free", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl1-title", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("gpl1-preamble", "The license agreements of most software companies try to keep users at the mercy of those companies."),
    ("gpl2-title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl2-preamble", "The licenses for most software are designed to take away your freedom to share and change it."),
    ("gpl3-title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl3-preamble", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("agpl3-title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("agpl3-preamble", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("lgpl2-title", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("lgpl2-first", "[This is the first released version of the library GPL."),
    ("lgpl21-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("lgpl21-first", "[This is the first released version of the Lesser GPL."),
    ("lgpl3-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl3-terms", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("gfdl12-title", "GNU Free Documentation License Version 1.2, November 2002"),
    ("gfdl13-title", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("gfdl-purpose", "The purpose of this License is to make a manual, textbook, or other functional and useful document \"free\" in the sense of freedom:"),
    ("apache2-title", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("apache2-means", "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("mpl11-title", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("mpl11-means", "\"Contributor\" means each entity that creates or contributes to the creation of Modifications."),
    ("mpl2-title", "Mozilla Public License Version 2.0"),
    ("mpl2-means", "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("cc0-title", "CC0 1.0 Universal"),
    ("cc0-laws", "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship and/or a database (each, a \"Work\")."),
    ("artistic-intent", "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package, while giving the users of the package the right to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable modifications."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("unlicense-free", "This is free and unencumbered software released into the public domain."),
    ("unlicense-anyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mpl-obtain", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl-obtain", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-advert", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
)
#: Licence, whether it permits reuse of any kind, and the sentences that state it, in order.
RULES = (
    ("MIT", True, ("mit-notice",)),
    ("MIT", True, ("mit-licensed",)),
    ("MIT", True, ("mit-grant", "mit-keep", "as-is")),
    ("Apache-2.0", True, ("apache-notice",)),
    ("GPL-3.0", False, ("gpl3-notice",)),
    ("GPL-3.0", False, ("gpl-free", "gpl-hope")),
    ("GPL-2.0", False, ("gpl2-notice",)),
    ("LGPL-3.0", False, ("lgpl3-notice",)),
    ("CC-BY-NC-4.0", False, ("cc-by-nc-notice",)),
    ("CC-BY-4.0", True, ("cc-by-notice",)),
    ("CC-BY-SA-4.0", False, ("cc-by-sa-notice",)),
    ("CC0-1.0", True, ("cc0-notice",)),
    ("MPL-2.0", False, ("mpl-notice",)),
    ("BSD-2-Clause", True, ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", True, ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("All-rights-reserved", False, ("rights",)),
)
#: Rules with sentences of PUBLISHED only.
MORE_RULES = (
    ("GPL-2.0", False, ("gpl2-free", "gpl-hope")),
    ("GPL-1.0", False, ("gpl1-title", "gpl1-preamble")),
    ("GPL-2.0", False, ("gpl2-title", "gpl2-preamble")),
    ("GPL-3.0", False, ("gpl3-title", "gpl3-preamble")),
    ("AGPL-3.0", False, ("agpl3-title", "agpl3-preamble")),
    ("AGPL-3.0", False, ("agpl3-free", "gpl-hope")),
    ("LGPL-2.0", False, ("lgpl2-title", "lgpl2-first")),
    ("LGPL-2.1", False, ("lgpl21-title", "lgpl21-first")),
    ("LGPL-2.1", False, ("lgpl21-free",)),
    ("LGPL-3.0", False, ("lgpl3-title", "lgpl3-terms")),
    ("GFDL-1.2", False, ("gfdl12-title", "gfdl-purpose")),
    ("GFDL-1.3", False, ("gfdl13-title", "gfdl-purpose")),
    ("Apache-2.0", True, ("apache2-title", "apache2-means")),
    ("MPL-1.1", False, ("mpl11-title", "mpl11-means")),
    ("MPL-1.1", False, ("mpl11-title", "mpl11-means", "rights")),
    ("MPL-2.0", False, ("mpl2-title", "mpl2-means")),
    ("MPL-2.0", False, ("mpl-notice", "mpl-obtain")),
    ("CC0-1.0", True, ("cc0-title", "cc0-laws")),
    ("CC0-1.0", True, ("cc0-laws",)),
    ("Artistic-1.0", True, ("artistic-intent",)),
    ("ISC", True, ("isc-grant",)),
    ("0BSD", True, ("0bsd-grant",)),
    ("Zlib", True, ("zlib-as-is", "zlib-grant")),
    ("Unlicense", True, ("unlicense-free", "unlicense-anyone")),
    ("BSD-4-Clause", True, ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names")),
    ("MIT", True, ("rights", "mit-grant", "mit-keep", "as-is")),
    ("BSD-2-Clause", True, ("rights", "bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", True, ("rights", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-4-Clause", True, ("rights", "bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names")),
)
#: Every known sentence holds one of these; a text without any has no sentence to look up.
ANCHOR = r"(?i)licen[cs]e|CC0|permission|copyright|as.is|redistribut|free software|warranty|rights reserved|library GPL|lesser GPL|the MPL|contributor|public domain|compiled binary|this software"
#: The holder's name in a sentence of the BSD licences, after normalisation.
HOLDER = (r"^neither the names? of .+ nor the names of (?:its|their|the|any) contributors", "neither the name of the copyright holder nor the names of its contributors")
#: A sentence ends after . ! ? : before white space, before a line without letters and digits, or before a bullet.
BULLET = r"[\x20\t]*+(?:[-+\x{2022}]|\(?(?:[0-9]{1,2}|[A-Za-z])[.)])[\x20\t]++"
CUT = rf"(?<=[.!?:])[\x20\x09-\x0D]++|\n(?=[^\p{{L}}\p{{N}}\n]*+\n)|\n(?={BULLET})"


def normal(text: str) -> str:
    """As `normalised` does, for the constants: ASCII letters and digits stay."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


def normalised(sentence: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace(sentence, rf"^\s*+{BULLET}", "")), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain.startswith("neither the name"), F.regexp_replace(plain, *HOLDER)).otherwise(plain)


#: v. 2.0. in the notice of the MPL is cut after "v.", so its last part is known as its own sentence would be.
KNOWN = {normal(s if name != "mpl-notice" else s.removesuffix(" 2.0.")): name for name, s in SENTENCES}


ALL_KNOWN = KNOWN | {normal(s): name for name, s in PUBLISHED}


def sequence(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in their order."""
    known = F.create_map(*(F.lit(x) for pair in ALL_KNOWN.items() for x in pair))
    look = lambda s: F.element_at(known, normalised(s))

    def of(sentence: Column) -> Column:
        lines = F.when(F.contains(sentence, F.lit("\n")), F.transform(F.split(sentence, "\n", -1), look)).otherwise(F.expr("cast(array() as array<string>)"))
        whole = look(sentence)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(lines)

    ids = F.filter(F.flatten(F.transform(F.split(text, CUT, -1), of)), lambda x: x.isNotNull())
    return F.when(F.coalesce(text.rlike(ANCHOR), F.lit(False)), ids).otherwise(F.expr("cast(array() as array<string>)"))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sequence, n_sentences, licences, n_licences, permissive) of each document."""
    rows = docs.select(F.col(key), F.array_join(sequence(F.col(text)), ",").alias("sequence"))
    found = F.concat(F.lit(","), F.replace("sequence", F.lit(","), F.lit(",,")), F.lit(","))
    for name, _, ids in sorted(RULES + MORE_RULES, key=lambda rule: -len(rule[2])):  # the longest rule takes its sentences
        found = F.replace(found, F.lit("".join(f",{x}," for x in ids)), F.lit(f",={name},"))
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(found, F.lit(",=([^,]+),"), F.lit(1))))
    names = F.when(F.col("sequence") == "", F.expr("cast(array() as array<string>)")).otherwise(names)
    permits = {name: free for name, free, _ in RULES + MORE_RULES}
    rows = rows.select("*", names.alias("names"))
    free = F.forall("names", lambda x: x.isin([n for n, ok in permits.items() if ok]))
    n = F.when(F.col("sequence") == "", 0).otherwise(F.size(F.split("sequence", ",")))
    return rows.select(key, "sequence", n.cast("long").alias("n_sentences"), F.array_join("names", ",").alias("licences"), F.size("names").cast("long").alias("n_licences"), ((F.size("names") > 0) & free).alias("permissive"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def sql() -> str:
    """The same in DuckDB, which has no look-behind: a mark is put after each end of a sentence, then cut there."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in KNOWN.items()) + "}"
    names = ", ".join(f"CASE WHEN contains(',' || sequence || ',', {quote(',' + ','.join(ids) + ',')}) THEN {quote(name)} END" for name, _, ids in RULES)
    free = ", ".join(sorted({quote(name) for name, ok, _ in RULES if ok}))
    return rf"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
looked AS (
  SELECT doc_id, array_to_string(list_filter(list_transform(parts, lambda s: ({known})[trim(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))]), lambda x: x IS NOT NULL), ',') AS sequence FROM cut),
named AS (
  SELECT doc_id, coalesce(sequence, '') AS sequence, list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))) AS names FROM looked)
SELECT doc_id, sequence, CASE WHEN sequence = '' THEN 0 ELSE len(string_split(sequence, ',')) END AS n_sentences,
  coalesce(array_to_string(names, ','), '') AS licences, len(names) AS n_licences, len(names) > 0 AND len(list_filter(names, lambda x: x NOT IN ({free}))) = 0 AS permissive
FROM named"""
