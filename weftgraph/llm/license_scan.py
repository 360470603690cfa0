"""License scans: normalised sentences become identifiers, and ordered rules match the identifier sequence.

A text is cut into sentences at blank lines and at ``.``, ``;`` or ``:`` before white space. A known
sentence may also begin and end at any line end, and may be wrapped over lines with or without
comment prefixes; of those that begin at a place the longest wins. A sentence is normalised (A-Z lower-cased, runs of anything but letters and digits as one space) and
looked up in the table of known licence sentences. A document's identifiers, in order, then meet
the ordered rules: a rule is a sequence of identifiers that must stand next to each other among the
known sentences; at each position the first rule that fits wins and its sentences are consumed.

All of this happens within a document's row: no join and no shuffle, so no key can be hot.

Defined cases: a null or empty text gives no licence (null) and an empty sequence; repeated rows
are each returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and licence notices, by identifier.
TEXTS = {
    "mit-name": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-title-short": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "apache-2-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-2-the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-2-may-not": "you may not use this file except in compliance with the License",
    "apache-2-copy": "You may obtain a copy of the License at",
    "apache-2-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2-https": "https://www.apache.org/licenses/LICENSE-2.0",
    "apache-2-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-2-see": "See the License for the specific language governing permissions and limitations under the License",
    "apache-2-title": "Apache License Version 2.0, January 2004",
    "gpl-3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software",
    "gpl-grant": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-2-option": "either version 2 of the License, or (at your option) any later version",
    "gpl-3-option": "either version 3 of the License, or (at your option) any later version",
    "gpl-3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-2-as-published": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl-2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "lgpl-free": "This library is free software",
    "lgpl-grant": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl-21-option": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl-3-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl-3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl-grant": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "agpl-3-later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "mpl-2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl-2-copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl-2-title": "Mozilla Public License Version 2.0",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-title": "ISC License",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "bsl-distributed": "Distributed under the Boost Software License, Version 1.0",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "epl-2-title": "Eclipse Public License - v 2.0",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc0": "Released under CC0 1.0",
    "cc-by-4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0-title": "CC0 1.0 Universal",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-author": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "proprietary": "All rights reserved",
    "spdx": "SPDX-License-Identifier",
}
#: Licences by the names that one-line notices give them, and identifiers of SPDX tags.
NAMES = {
    "MIT License": "MIT", "Apache License 2.0": "Apache-2.0", "Apache License, Version 2.0": "Apache-2.0", "BSD 2-Clause License": "BSD-2-Clause", "BSD 3-Clause License": "BSD-3-Clause",
    "GNU General Public License v2.0": "GPL-2.0", "GNU General Public License v3.0": "GPL-3.0", "GNU Lesser General Public License v2.1": "LGPL-2.1", "GNU Lesser General Public License v3.0": "LGPL-3.0",
    "GNU Affero General Public License v3.0": "AGPL-3.0", "Mozilla Public License 2.0": "MPL-2.0", "ISC License": "ISC", "zlib License": "Zlib", "Boost Software License 1.0": "BSL-1.0", "Eclipse Public License 2.0": "EPL-2.0",
}
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()
OPENINGS = ["Licensed under the", "Released under the", "Distributed under the", "This project is licensed under the", "This software is licensed under the", "This program is licensed under the"]


def identifier(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def notices() -> dict[str, tuple[str, str]]:
    """One-line notices by identifier: the sentence and its licence; the ones of TEXTS are left to it."""
    plain = {identifier(t) for t in TEXTS.values()}
    made = {identifier(f"{opening} {name}"): (f"{opening} {name}", licence) for opening in OPENINGS for name, licence in NAMES.items()}
    return {name: made[name] for name in made if name not in plain}


SENTENCES = {**TEXTS, **{name: text for name, (text, _) in notices().items()}, **{identifier(f"spdx {x}"): x for x in SPDX}}
#: The rules in order; the first that fits at a position wins.
GRANTS = [
    (("mit-grant", "mit-notice"), "MIT"),
    (("mit-grant",), "MIT"),
    (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"), "BSD-4-Clause"),
    (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse-author"), "BSD-3-Clause"),
    (("bsd-redistribution", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-redistribution", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("bsd-redistribution",), "BSD-2-Clause"),
    (("isc-grant",), "ISC"),
    (("isc-grant-and",), "ISC"),
    (("zlib-as-is", "zlib-liability", "zlib-grant"), "Zlib"),
    (("zlib-grant",), "Zlib"),
    (("bsl-grant",), "BSL-1.0"),
]
RULES = [
    # a copyright line that reserves all rights goes with the grant that follows it
    *((("proprietary", *rule), licence) for rule, licence in GRANTS),
    *GRANTS,
    *((("spdx", identifier(f"spdx {x}")), x) for x in SPDX),
    (("apache-2-the", "apache-2-may-not", "apache-2-copy"), "Apache-2.0"),
    (("gpl-free", "gpl-3-later"), "GPL-3.0-or-later"),
    (("gpl-free", "gpl-grant", "gpl-3-option"), "GPL-3.0-or-later"),
    (("gpl-free", "gpl-grant", "gpl-2-option"), "GPL-2.0-or-later"),
    (("gpl-free", "gpl-2-as-published"), "GPL-2.0-only"),
    (("lgpl-free", "lgpl-grant", "lgpl-21-option"), "LGPL-2.1-or-later"),
    (("gpl-free", "lgpl-grant", "gpl-3-option"), "LGPL-3.0-or-later"),
    (("lgpl-3-later",), "LGPL-3.0-or-later"),
    (("gpl-free", "agpl-grant", "gpl-3-option"), "AGPL-3.0-or-later"),
    (("agpl-3-later",), "AGPL-3.0-or-later"),
    (("mit-title",), "MIT"),
    (("mit-title-short",), "MIT"),
    (("mit-name",), "MIT"),
    (("mit-licensed",), "MIT"),
    (("apache-2-the",), "Apache-2.0"),
    (("apache-2-licensed",), "Apache-2.0"),
    (("apache-2-title",), "Apache-2.0"),
    (("gpl-3-work",), "GPL-3.0"),
    (("gpl-3-later",), "GPL-3.0-or-later"),
    (("gpl-2-title",), "GPL-2.0"),
    (("gpl-3-title",), "GPL-3.0"),
    (("lgpl-21-title",), "LGPL-2.1"),
    (("lgpl-3-title",), "LGPL-3.0"),
    (("agpl-3-title",), "AGPL-3.0"),
    (("mpl-2-subject",), "MPL-2.0"),
    (("mpl-2-title",), "MPL-2.0"),
    (("isc-title",), "ISC"),
    (("bsl-distributed",), "BSL-1.0"),
    (("unlicense",), "Unlicense"),
    (("epl-2-title",), "EPL-2.0"),
    (("cc-by-nc-4",), "CC-BY-NC-4.0"),
    (("cc-by-4",), "CC-BY-4.0"),
    (("cc-by-sa-4",), "CC-BY-SA-4.0"),
    (("cc-by-nc-4-work",), "CC-BY-NC-4.0"),
    (("cc-by-4-work",), "CC-BY-4.0"),
    (("cc-by-sa-4-work",), "CC-BY-SA-4.0"),
    (("cc0",), "CC0-1.0"),
    (("cc0-title",), "CC0-1.0"),
    *(((name,), licence) for name, (_, licence) in notices().items()),
    (("proprietary",), "Proprietary"),
]
BREAK = r"\n+|[.;:]+[ \t\r\n]+|[.;:]+\z"
OTHER = r"[^\p{L}\p{N}]+"


#: Stands for a sentence's end in marked texts; not a letter or a digit.
END = "\ue000"
ENDS = r"[.;:]+(?:[ \t\r\n]+|\z)|\n(?:[^\p{L}\p{N}\n]*\n)+"


def marked(text: Column) -> Column:
    """Lower-cased words with one character between: a space, a line end, or END."""
    parts = F.regexp_replace(F.regexp_replace(F.lower(text), END, " "), ENDS, END)
    spaced = F.regexp_replace(parts, rf"[^\p{{L}}\p{{N}}\n{END}]+", " ")
    return F.regexp_replace(F.concat(F.lit(END), spaced, F.lit(END)), rf" ?([\n{END}]) ?", "$1")


def sentence_pattern(plain: list[str]) -> str:
    """Known sentences between two ends, by first word and the longest first; a line may end after any word."""
    by_word: dict[str, list[str]] = {}
    for x in sorted(plain, key=lambda x: (-len(x), x)):
        word, _, rest = x.partition(" ")
        by_word.setdefault(word, []).append((" " + rest if rest else "").replace(" ", r"[ \n]"))
    return rf"(?<=[\n{END}])(?:" + "|".join(f"{word}(?:{'|'.join(rests)})" for word, rests in by_word.items()) + rf")(?=[\n{END}])"


def known(sentences: dict[str, str]) -> dict[str, str]:
    """Identifier by normalised sentence; a known sentence holds no break and is known once."""
    out: dict[str, str] = {}
    for name, text in sentences.items():
        if not re.fullmatch(r"[a-z0-9-]+", name) or len([x for x in re.split(BREAK.replace(r"\z", r"\Z"), text) if x]) != 1:
            raise ValueError(f"not one sentence: {name}")
        plain = re.sub(r"[\W_]+", " ", text.lower()).strip()
        if plain in out:
            raise ValueError(f"{name} repeats {out[plain]}")
        out[plain] = name
    return out


def rule_key(rule: tuple[str, ...]) -> str:
    return "".join(f"<{name}>" for name in rule)


def recognise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """``doc_id, licenses, first_license, sentence_ids, n_sentences``, a row for each document.

    The sentence table and the rules are parameters and travel in the plan.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    table = known(sentences)
    names = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    first = {rule_key(rule): name for rule, name in reversed(rules)}
    licence = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
    pattern = "|".join(re.escape(rule_key(r)).replace("\\-", "-") for r, _ in rules)
    met = F.regexp_extract_all(marked(F.coalesce(F.col(text_col), F.lit(""))), F.lit(sentence_pattern(list(table))), F.lit(0))
    ids = F.transform(met, lambda s: F.try_element_at(names, F.translate(s, "\n", " ")))
    seen = docs.select(F.col(id_col).alias(id_col), ids.alias("ids"))
    found = seen.select(id_col, "ids", F.regexp_extract_all(F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""), F.lit(pattern), F.lit(0)).alias("met"))
    found = found.select(id_col, "ids", F.transform("met", lambda m: F.try_element_at(licence, m)).alias("all"))
    return found.select(
        id_col,
        F.array_join(F.array_sort(F.array_distinct("all")), ",").alias("licenses"),
        F.get("all", F.lit(0)).alias("first_license"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.size("ids").cast("long").alias("n_sentences"),
    )


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return recognise(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    pairs = ", ".join(f"({quoted(s)}, {quoted(n)})" for s, n in known(SENTENCES).items())
    rules = ", ".join(f"({quoted(rule_key(r))}, {quoted(n)})" for r, n in RULES)
    pattern = "|".join(rule_key(r) for r, _ in RULES)
    return f"""
WITH known(sentence, name) AS (VALUES {pairs}), rules(rule, licence) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS n, doc_id, string_split_regex(coalesce(text, ''), '{BREAK}') AS s FROM documents),
s AS (SELECT n, generate_subscripts(s, 1) AS k, unnest(s) AS sentence FROM d),
m AS (SELECT n, k, name FROM s JOIN known ON known.sentence = trim(regexp_replace(lower(s.sentence), '{OTHER}', ' ', 'g'))),
q AS (SELECT n, string_agg('<' || name || '>', '' ORDER BY k) AS seq, string_agg(name, ',' ORDER BY k) AS ids, count(*) AS c FROM m GROUP BY n),
h AS (SELECT n, unnest(regexp_extract_all(seq, '{pattern}')) AS rule, generate_subscripts(regexp_extract_all(seq, '{pattern}'), 1) AS k FROM q),
a AS (SELECT n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licenses, arg_min(licence, k) AS first_license FROM h JOIN rules USING (rule) GROUP BY n)
SELECT doc_id, coalesce(licenses, '') AS licenses, first_license, coalesce(ids, '') AS sentence_ids, coalesce(c, 0)::BIGINT AS n_sentences
FROM d LEFT JOIN q USING (n) LEFT JOIN a USING (n)
"""
