"""Licence recognition by sentences, by DataFrame functions only.

Normalised sentences are looked up in a table of known licence sentences; the ids
found, in order, are matched against rules, each an ordered list of ids that may
stand apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let

# Sentences of public licence texts and notices, in lower case, without
# punctuation but for dots, pluses and hyphens within words, by id.
SENTENCES = {
    "apache-note": "licensed under the apache license version 2.0",
    "apache-note-the": "licensed under the apache license version 2.0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www.apache.org licenses license-2.0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-note": "released under the mit license",
    "mit-note-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-note": "this work is licensed under the gnu general public license version 3",
    "gpl3-note-licensed": "licensed under the gnu general public license version 3",
    "gpl2-note": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-note": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "cc-by-nc-4-note": "licensed under cc by-nc 4.0",
    "cc-by-4-note": "licensed under cc by 4.0",
    "cc-by-sa-4-note": "licensed under cc by-sa 4.0",
    "cc-by-4-long": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-sa-4-long": "this work is licensed under a creative commons attribution-sharealike 4.0 international license",
    "cc-by-nc-4-long": "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "lgpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "zlib-as-is": "this software is provided as-is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "epl2-note": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl-2.0",
    "cc0-dedicated": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0-without": "this software is distributed without any warranty",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
}
# Licence names that a tag may give.
TAGS = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "Zlib", "EPL-2.0", "CC0-1.0", "Unlicense"]
SENTENCES |= {f"tag-{t.lower().replace('.', '-')}": f"spdx-license-identifier {t.lower()}" for t in TAGS}
# The rules, as a licence's name, ordered sentence ids, and perhaps one that must not follow them.
RULES = [
    ("Apache-2.0", ["apache-note"]),
    ("Apache-2.0", ["apache-note-the", "apache-use"]),
    ("Apache-2.0", ["apache-use", "apache-as-is", "apache-see"]),
    ("MIT", ["mit-note"]),
    ("MIT", ["mit-note-licensed"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("GPL-3.0", ["gpl3-note"]),
    ("GPL-3.0", ["gpl3-note-licensed"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see"]),
    ("GPL-2.0", ["gpl2-note"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"], "bsd-name"),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl2-note"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-note"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-long"]),
    ("CC-BY-4.0", ["cc-by-4-note"]),
    ("CC-BY-4.0", ["cc-by-4-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-note"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-long"]),
    ("Unlicense", ["unlicense-free"]),
    ("Unlicense", ["unlicense-anyone"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-see"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope", "lgpl-see"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope", "lgpl-see"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope", "agpl-see"]),
    ("Zlib", ["zlib-as-is", "zlib-grant", "zlib-origin"]),
    ("EPL-2.0", ["epl2-note"]),
    ("CC0-1.0", ["cc0-dedicated", "cc0-without"]),
]
RULES += [(t, [f"tag-{t.lower().replace('.', '-')}"]) for t in TAGS]
#: Every known sentence has one of these words or beginnings of words, so texts without them are not cut up.
SIGNS = ["licens", "permission", "redistribut", "warrant", "unencumbered", "misrepresented", "neighboring", "non-commercial", "distributed"]

#: What parts sentences for good, and what may part them or only wrap.
HARD, SOFT = "\x01", "|"
#: After lowering, in this order: blanks, comment marks and list numbers at the start of a line go; a blank line before an
#: address only wraps; final punctuation and blank lines part for good, colons, semicolons and line ends perhaps; what is
#: no part of a word goes, then what is left of it at an edge. Groups are kept. No step looks far ahead in vain, so
#: that time grows with the text.
STEPS = [
    (r"(^|\n)[ \t*#/;%!>-]+", r"\1"),
    (r"(^|\n)\(?(?:[0-9]{1,2}|[a-z])[.)][ \t]+", r"\1"),
    (r"([^a-z0-9])v\.[ \n]+([0-9])", r"\1v \2"),
    (r"\n\n\n+", "\n\n"),
    (r"\n\n(https?://)", rf"{SOFT}\1"),
    (r"""[.!?]["')\]]*[ \t\n]+""", HARD),
    (r"\n\n", HARD),
    (r"[;:][ \t\n]+|\n", SOFT),
    (r"[^a-z0-9.+|\x01-]+", " "),
    (r"[ .+-]{4,}", " "),
    (r"[ .+-]*\|[ .+|-]*", SOFT),
]
LAST = r"[ .+|-]*\x01[ .+|\x01-]*"
#: An edge as it stands in the normalised text: twice, so that each of two neighbours has one.
EDGES = [(SOFT, SOFT * 2), (HARD, HARD * 2)]


def pieces(text):
    """The normalised text, with HARD where a sentence ends for good (final punctuation, a blank line) and SOFT at colons, semicolons and other line ends, each twice."""
    out = F.lower(F.translate(text, SOFT + HARD + "\r", "  "))
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by.replace("\\", "$"))
    out = F.regexp_replace(F.concat(F.lit(HARD), out, F.lit(HARD)), LAST, HARD)
    for edge, twice in EDGES:
        out = F.replace(out, F.lit(edge), F.lit(twice))
    return out


def _pattern() -> str:
    """Any known sentence, the longest first, from one edge of a piece to another; soft edges may lie within."""
    quoted = [s.replace(".", r"\.").replace("+", r"\+").replace(" ", r"(?: |\|\|)") for s in sorted(SENTENCES.values(), key=len, reverse=True)]
    return rf"[|\x01]({'|'.join(quoted)})[|\x01]"


def _follows(ids: list[str]) -> str:
    return ".*".join(f">{i}>" for i in ids)


def _by_name() -> dict:
    by: dict = {}
    for name, ids, *without in RULES:
        by.setdefault(name, []).append((ids, without))
    return dict(sorted(by.items()))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sentence_ids, the known sentences in order parted by >, and licenses, the names found in order of name parted by commas.

    A rule is tried from each of its first sentences to the next such sentence. Both columns are
    empty where nothing is found and for null or empty texts; columns of docs with those names give way.
    """
    docs = docs.drop("sentence_ids", "licenses")
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    lowered = F.lower(F.col(text))
    any_sign = lowered.contains(SIGNS[0])
    for s in SIGNS[1:]:
        any_sign = any_sign | lowered.contains(s)
    whole = F.regexp_extract_all(pieces(F.col(text)), F.lit(_pattern()), F.lit(1))
    ids = F.transform(whole, lambda x: F.try_element_at(known, F.replace(x, F.lit(SOFT * 2), F.lit(" "))))
    found = F.when(any_sign, F.array_join(ids, ">")).otherwise("")
    out = docs.withColumn("sentence_ids", F.coalesce(found, F.lit("")))

    def holds(line, ids, without):
        if len(ids) == 1 and not without:
            return line.contains(f">{ids[0]}>")

        def follow(rest):
            meets = rest.rlike(_follows(ids[1:]))
            return meets & ~rest.rlike(_follows([*ids[1:], *without])) if without else meets

        return F.exists(F.slice(F.split(line, f">{ids[0]}>"), 2, 1 << 30), follow)

    def names(line):
        tests = []
        for name, rules in _by_name().items():
            test = holds(line, *rules[0])
            for rule in rules[1:]:
                test = test | holds(line, *rule)
            tests.append(F.when(test, F.lit(name)))
        return F.array_join(F.array(*tests), ",")

    line = F.concat(F.lit(">"), F.replace("sentence_ids", F.lit(">"), F.lit(">>")), F.lit(">"))
    return out.withColumn("licenses", F.when(F.col("sentence_ids") == "", F.lit("")).otherwise(let(line, names)))


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "sentence_ids", "licenses")


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    text = "lower(translate(text, '|' || chr(1) || chr(13), '  '))"
    for pattern, by in STEPS:
        text = f"regexp_replace({text}, {quote(pattern)}, {'chr(1)' if by == HARD else quote(by)}, 'g')"
    text = f"regexp_replace(chr(1) || {text} || chr(1), {quote(LAST)}, chr(1), 'g')"
    text = f"replace(replace({text}, '|', '||'), chr(1), chr(1) || chr(1))"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for i, s in SENTENCES.items())

    def holds(ids, without):
        if len(ids) == 1 and not without:
            return f"contains(line, {quote(f'>{ids[0]}>')})"
        test = f"regexp_matches(x, {quote(_follows(ids[1:]))})"
        test += f" AND NOT regexp_matches(x, {quote(_follows([*ids[1:], *without]))})" if without else ""
        return f"len(list_filter(string_split(line, {quote(f'>{ids[0]}>')})[2:], lambda x: {test})) > 0"

    names = ", ".join(f"CASE WHEN {' OR '.join(holds(*r) for r in rules)} THEN {quote(n)} END" for n, rules in _by_name().items())
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
s AS (
  SELECT doc_id, i, replace(p[i], '||', ' ') AS sentence
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all({text}, {quote(_pattern())}, 1) AS p FROM documents))),
found AS (SELECT doc_id, string_agg(id, '>' ORDER BY i) AS ids FROM s JOIN known USING (sentence) GROUP BY doc_id),
lines AS (SELECT d.doc_id, coalesce(ids, '') AS sentence_ids, '>' || replace(coalesce(ids, ''), '>', '>>') || '>' AS line FROM documents d LEFT JOIN found USING (doc_id))
SELECT doc_id, sentence_ids, coalesce(array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ','), '') AS licenses
FROM lines
"""


OP8_SQL = _sql()
