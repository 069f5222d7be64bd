"""Operator 8 [native], licence scans by sentence rules.

A text is normalised (lower case; runs of other than letters and digits are one space) and cut into sentences at marks,
semicolons and colons before white space, and at empty lines.  Within each, known licence sentences are recognised on word bounds, wherever
they begin: after "Note:", wrapped over lines, or followed by more words.  Of sentences that begin alike the longest is taken.  The
known ones become identifiers, and the identifiers' sequence is matched against rules, those of most identifiers first; a
rule consumes what it matches, so BSD-3-Clause is not BSD-2-Clause too.  Holders' names in the endorsement sentence may vary.

Only DataFrame functions run, all within the row: no shuffle, no broadcast.  Sentences without any trigger word are
passed over, which loses nothing, for each known sentence holds one.

Defined results: null text counts as empty; texts without a match have licence null, empty sentence_ids and zero
counts.  Licences are listed in the order of their places, each once, the first in `licence`; n_unknown counts the
sentences with words between the first and the last sentence with a known one that hold none.  Repeated rows are scanned each; null doc_id and extra columns
are harmless; an empty table gives an empty table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import empty_if_null

#: Sentences of licence texts and notices, in normalised form, and their identifiers (public licence texts; fixed values).
SENTENCES = {
    "licensed under the apache license version 2 0 the license": "apache-2.0-notice",
    "you may not use this file except in compliance with the license": "licence-use",
    "you may obtain a copy of the license at": "licence-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "licence-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "licence-limits",
    "apache license version 2 0 january 2004": "apache-2.0-title",
    "the end user documentation included with the redistribution if any must include the following acknowledgment": "apache-1.1-acknowledgment",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "except as contained in this notice the name of holder shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization": "x11-name",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "neither the name of holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages": "bsd-liability",
    "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages": "bsd-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this notice may not be removed or altered from any source distribution": "zlib-notice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-1.0-grant",
    "distributed under the boost software license version 1 0": "bsl-1.0-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-release",
    "do what the fuck you want to public license": "wtfpl-title",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3.0-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2.0-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl-3.0-alone",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl-2.0-alone",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3.0-later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl-2.1-later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3.0-later",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0-notice",
    "the contents of this file are subject to the mozilla public license version 1 1 the license": "mpl-1.1-notice",
    "the contents of this file are subject to the mozilla public license version 1 1": "mpl-1.1-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0": "epl-1.0-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 1 0": "epl-1.0-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "epl-2.0-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0": "epl-2.0-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4.0-notice",
    "waived all copyright and related or neighboring rights": "cc0-1.0-waiver",
}

#: Licences and their names in notices of one sentence, in normalised form (fixed values).
NAMES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"],
    "MIT": ["mit license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "ISC": ["isc license"],
    "Zlib": ["zlib license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gplv2"],
    "GPL-2.0-or-later": ["gnu general public license version 2 or later", "gnu general public license v2 or later", "gplv2 or later"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gplv3"],
    "GPL-3.0-or-later": ["gnu general public license version 3 or later", "gnu general public license v3 or later", "gplv3 or later"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "gnu lgpl version 2 1", "lgplv2 1"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "gnu lgpl version 3", "lgplv3"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "gnu agpl version 3", "agplv3"],
    "MPL-1.1": ["mozilla public license version 1 1"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0"],
    "Artistic-2.0": ["artistic license version 2 0", "artistic license 2 0"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "Unlicense": ["unlicense"],
}

#: How such a notice begins.
NOTICES = ["licensed under", "released under", "distributed under", "available under", "published under"]

#: The tag that names a licence alone, by its public short name.
TAG = "spdx license identifier"


def _longest_first(phrases) -> str:
    return "|".join(sorted(set(phrases), key=lambda s: (-len(s), s)))


_TAGS = {x: x.lower().replace("-", " ").replace(".", " ") for x in NAMES}

#: Any known sentence on word bounds; of two which begin alike the longer comes first.  The texts' sentences are none of them the beginning of a notice.
KNOWN = rf"\b(?:{_longest_first(SENTENCES)}|(?:{_longest_first(NOTICES)}) (?:the )?(?:{_longest_first(n for names in NAMES.values() for n in names)})|{TAG} (?:{_longest_first(_TAGS.values())}))\b"

# the identifiers of notices and tags: short-<licence> and spdx-<licence>
SENTENCES |= {f"{begin} {the}{name}": f"short-{x}" for x, names in NAMES.items() for name in names for begin in NOTICES for the in ("", "the ") if f"{begin} {the}{name}" not in SENTENCES}
SENTENCES |= {f"{TAG} {name}": f"spdx-{x}" for x, name in _TAGS.items()}

#: A licence and the identifiers that must follow one another.
RULES = [
    ("Apache-2.0", ["apache-2.0-notice", "licence-use", "licence-copy", "licence-as-is", "licence-limits"]),
    ("Apache-2.0", ["apache-2.0-notice", "licence-use", "licence-copy"]),
    ("Apache-2.0", ["apache-2.0-notice", "licence-use"]),
    ("Apache-2.0", ["apache-2.0-notice"]),
    ("Apache-2.0", ["apache-2.0-title"]),
    ("Apache-1.1", ["bsd-grant", "bsd-source", "bsd-binary", "apache-1.1-acknowledgment"]),
    ("X11", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability", "x11-name"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse", "bsd-warranty", "bsd-liability"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty", "bsd-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("Zlib", ["zlib-warranty", "zlib-grant", "zlib-notice"]),
    ("Zlib", ["zlib-grant", "zlib-notice"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["bsl-1.0-grant"]),
    ("BSL-1.0", ["bsl-1.0-notice"]),
    ("Unlicense", ["unlicense-release"]),
    ("WTFPL", ["wtfpl-title"]),
    *((licence, [sentence, *more]) for licence, sentence in (
        ("GPL-3.0-or-later", "gpl-3.0-later"), ("GPL-2.0-or-later", "gpl-2.0-later"), ("GPL-3.0-only", "gpl-3.0-alone"), ("GPL-2.0-only", "gpl-2.0-alone"),
        ("LGPL-3.0-or-later", "lgpl-3.0-later"), ("LGPL-2.1-or-later", "lgpl-2.1-later"), ("AGPL-3.0-or-later", "agpl-3.0-later"),
    ) for more in (["gpl-warranty"], [])),
    ("MPL-2.0", ["mpl-2.0-notice"]),
    ("MPL-1.1", ["mpl-1.1-notice", "licence-use", "licence-copy"]),
    ("MPL-1.1", ["mpl-1.1-notice", "licence-use"]),
    ("MPL-1.1", ["mpl-1.1-notice"]),
    ("EPL-1.0", ["epl-1.0-notice"]),
    ("EPL-2.0", ["epl-2.0-notice"]),
    ("CC-BY-4.0", ["cc-by-4.0-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-notice"]),
    ("CC0-1.0", ["cc0-1.0-waiver"]),
    *((licence, [f"{kind}-{licence}"]) for licence in NAMES for kind in ("short", "spdx")),
]

#: Each known sentence holds one of these.
TRIGGERS = ["licen", "permission", "copyright", "redistribut", "released under", "distributed under", "available under", "published under", "warrant", "liable", "notice", "public domain", "endorse", "advertising", "acknowledg", "advertis"]

#: Steps to sentences of normalised words, in order: an abbreviation's mark is no end; marks,
#: semicolons and colons before white space, and empty lines end a sentence, which is noted by a bar; runs of other than letters, digits and
#: bars are one space; a clause that a colon parts is joined; and a holder's name in an endorsement clause gives way to one word.  As RE2 and Java take them.
STEPS = [
    (r"\|", " "),
    (r"(\A|[\x20\x09-\x0D,(])v\.[\x20\x09]+([0-9])", r"\1v \2"),
    (r"spdx-license-identifier:", "spdx license identifier "),
    (r"[.!?;:]+(?:[\x20\x09-\x0D]|\z)|(?:\x0D\x0A|[\x0A-\x0D])[^a-z0-9\x0A-\x0D|]*(?:\x0D\x0A|[\x0A-\x0D])", "|"),
    (r"[^a-z0-9|]+", " "),
    (r"is free software\|\x20?you can", "is free software you can"),
    (r"neither the names? of [a-z0-9\x20]{1,200}? nor the names of (?:its|their|any) contributors", "neither the name of holder nor the names of its contributors"),
    (r"the name of [a-z0-9\x20]{1,200}? shall not be used in advertising", "the name of holder shall not be used in advertising"),
]

#: The rules as they are tried: those of most identifiers first, else in their order.
ORDERED = sorted(RULES, key=lambda rule: -len(rule[1]))


def sentences(text: Column) -> Column:
    """The normalised sentences of a text."""
    out = F.lower(text)
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, new.replace("\\", "$"))
    return F.filter(F.split(out, r"\|", -1), lambda s: F.trim(s) != "")


def _framed(ids: list[str]) -> str:
    return "".join(f"<{x}>" for x in ids)


def matched_rules(framed: Column) -> Column:
    """The licences, in the order of their places, of a sequence <id><id>... after each rule has taken what it matches."""
    for licence, need in ORDERED:
        framed = F.replace(framed, F.lit(_framed(need)), F.lit(f"<={licence}>"))
    return F.array_distinct(F.regexp_extract_all(framed, F.lit("<=([^>]+)>"), F.lit(1)))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, licence, licences, sentence_ids, n_sentences (known ones) and n_unknown of each row."""
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), empty_if_null(text).alias("text"))
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    trigger = "|".join(TRIGGERS)
    of_sentence = lambda s: F.when(s.rlike(trigger), F.transform(F.regexp_extract_all(s, F.lit(KNOWN), F.lit(0)), lambda x: F.element_at(known, x))).otherwise(F.array().cast("array<string>"))
    found = F.when(F.col("text").rlike(f"(?i){trigger.replace(' ', '[^A-Za-z0-9]+')}"), F.transform(sentences(F.col("text")), of_sentence)).otherwise(F.array().cast("array<array<string>>"))
    per = rows.select("doc_id", found.alias("per"))
    some = F.transform("per", lambda x: F.size(x) > 0)
    first, last = F.array_position(some, F.lit(True)), F.size("per") + 1 - F.array_position(F.reverse(some), F.lit(True))
    between = F.when(first > 0, last - first + 1 - F.size(F.filter(some, lambda x: x))).otherwise(0).cast("long")
    flat = per.select("doc_id", F.flatten("per").alias("ids"), between.alias("n_unknown"))
    matched = F.when(F.size("ids") > 0, matched_rules(F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">")))).otherwise(F.array().cast("array<string>"))
    out = flat.select("doc_id", matched.alias("matched"), F.array_join("ids", ",").alias("sentence_ids"), F.size("ids").cast("long").alias("n_sentences"), "n_unknown")
    return out.select("doc_id", F.when(F.size("matched") > 0, F.element_at("matched", 1)).alias("licence"), F.array_join("matched", ",").alias("licences"), "sentence_ids", "n_sentences", "n_unknown")


def scan_sql() -> str:
    """The same in DuckDB's SQL."""
    known = ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items())
    lines = "lower(coalesce(text, ''))"
    for pattern, new in STEPS:
        lines = f"regexp_replace({lines}, '{pattern}', '{new}', 'g')"
    framed = "'<' || array_to_string(ids, '><') || '>'"
    for licence, need in ORDERED:
        framed = f"replace({framed}, '{_framed(need)}', '<={licence}>')"
    return rf"""
WITH s AS (SELECT row_number() OVER () AS serial, doc_id, list_filter(string_split({lines}, '|'), lambda x: trim(x) <> '') AS parts FROM documents),
     e AS (SELECT serial, unnest(parts) AS part, unnest(range(len(parts))) AS place FROM s),
     k AS (SELECT serial, place, list_transform(regexp_extract_all(part, '{KNOWN}'), lambda x: MAP {{{known}}}[x]) AS found FROM e),
     i AS (SELECT serial, flatten(list(found ORDER BY place)) AS ids, max(place) - min(place) + 1 - count(*) AS n_unknown FROM k WHERE len(found) > 0 GROUP BY serial),
     m AS (SELECT *, regexp_extract_all({framed}, '<=([^>]+)>', 1) AS raw FROM i),
     d AS (SELECT *, list_filter(raw, lambda x, n: list_position(raw, x) = n) AS matched FROM m)
SELECT s.doc_id, matched[1] AS licence, coalesce(array_to_string(matched, ','), '') AS licences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(len(ids), 0)::BIGINT AS n_sentences, coalesce(n_unknown, 0)::BIGINT AS n_unknown
FROM s LEFT JOIN d USING (serial)
"""
