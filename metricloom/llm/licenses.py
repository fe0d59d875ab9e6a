"""Licence recognition by sentences: known sentences become identifiers, ordered identifier
sequences name the licence. Works row by row with DataFrame functions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

# Sentences of common licences and notices, by identifier; none has an end inside.
SENTENCES: dict[str, str] = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-licensed": "Licensed under the GNU General Public License, version 3",
    "gpl-program": "This program is free software",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-version": "2.0",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-nd": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "all-rights": "All rights reserved",
}

# Identifier sequences that state a licence, most specific first.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache-notice", "apache-use", "apache-copy", "apache-as-is", "apache-limits"]),
    ("Apache-2.0", ["apache-notice"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-as-is"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0", ["gpl3-work"]),
    ("GPL-3.0", ["gpl3-licensed"]),
    ("GPL-3.0-or-later", ["gpl-program", "gpl3-terms", "gpl-hope", "gpl-implied"]),
    ("GPL-2.0-or-later", ["gpl-program", "gpl-terms", "gpl2-version", "gpl-hope", "gpl-implied"]),
    ("MPL-2.0", ["mpl-notice", "mpl-version"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-ND-4.0", ["cc-by-nd"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd"]),
    ("CC0-1.0", ["cc0"]),
    ("all-rights-reserved", ["all-rights"]),
]
CONTAINS = {"BSD-3-Clause": ["BSD-2-Clause"]}  # a licence that includes the sequence of another

SENTENCE_END = r"(?<=[.!?;:])[\x20\x09-\x0D]+|,?\n[\x20\x09-\x0D]*\n"
MARKS = r"[^\p{L}\p{N}]+"


def normalise(text: str) -> str:
    """Lower case, runs of other characters than letters and digits as one blank."""
    return " ".join(re.sub(r"[\W_]+", " ", text.lower()).split())


def sentence_ids(text: Column, sentences: Mapping[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in text order.

    A sentence ends at a mark followed by white space or at an empty line; one that also ends with
    its line is found by a second reading, line by line, of what the first has not recognised.
    """
    known = {normalise(s): name for name, s in sentences.items()}
    if not known:
        return F.array().cast("array<string>")
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])

    def ids(parts: Column) -> Column:
        clean = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.lower(s), MARKS, " ")))
        return F.transform(F.filter(clean, lambda s: s.isin(*known)), lambda s: names[s])

    def sentence(s: Column) -> Column:
        whole = ids(F.array(F.replace(s, F.lit("\n"), F.lit(" "))))
        lines = F.flatten(F.transform(F.split(s, "\n"), lambda line: ids(F.array(line))))
        return F.when(F.size(whole) > 0, whole).otherwise(lines)

    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), sentence))


def licences(found: Column, rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> Column:
    """Licences whose sequence occurs, in order, among the identifiers; each once, in rule order."""
    line = F.concat(F.lit(","), F.array_join(found, ","), F.lit(","))
    hits = [F.when(line.rlike("," + ",(?:[^,]+,)*".join(re.escape(x) for x in ids) + ","), F.lit(name)) for name, ids in rules]
    return F.array_distinct(F.array_compact(F.array(*hits))) if hits else F.array().cast("array<string>")


def scan_licences(
    docs: DataFrame, text: str = "text", sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES
) -> DataFrame:
    """``docs`` with ``licence_sentences`` and ``licences``, two string arrays; map-only.

    Both are empty for null or empty texts and texts without known sentences. Repeated sentences
    stay in the first array; repeated rows give repeated results; an empty table stays empty;
    existing columns of the two names are replaced. The tables of sentences and rules are small
    constants of the job.
    """
    docs = docs.drop(*[x for x in ("licence_sentences", "licences") if x != text])
    out = docs.withColumn("licence_sentences", sentence_ids(c(text), sentences))
    named = licences(c("licence_sentences"), rules)
    for name, parts in CONTAINS.items():
        named = F.when(F.array_contains(named, name), F.array_except(named, F.array(*map(F.lit, parts)))).otherwise(named)
    return out.withColumn("licences", named)
