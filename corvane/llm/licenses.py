"""License scans: sentences are mapped to identifiers of known licence sentences, and ordered rules match sequences.

Everything is a Spark SQL expression over the row's own text. A sentence ends at an empty line or at . ! ? ; : and white
space (but not between "v." and a number), and may end at any other line break: a known sentence may be wrapped over any number of lines of a paragraph, and
lines that are in no such sentence are sentences of their own. Sentences are normalised to lower-case letters and digits
with single spaces. The sequence of a text's identifiers, with a gap wherever sentences are not known, is one string, and
each rule is a run of identifiers in it; copyright lines, the licence's own address and numbers of list entries are
passed over. Rules are tried in
their order, and what a rule has matched is taken out before the next one, so a part of a longer notice is not reported
again.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACE, let

#: Normalised sentences of licence texts and notices, by identifier.
SENTENCES = {
    "apache2-notice": "licensed under the apache license version 2 0",
    "apache2-may-not": "you may not use this file except in compliance with the license",
    "apache2-obtain": "you may obtain a copy of the license at",
    "apache2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-notice-licensed": "licensed under the mit license",
    "mit-title": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl2-notice": "this work is licensed under the gnu general public license version 2",
    "gpl-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-free": "this program is free software",
    "lgpl3-notice": "this work is licensed under the gnu lesser general public license version 3",
    "bsd3-notice": "licensed under the bsd 3 clause license",
    "bsd2-notice": "licensed under the bsd 2 clause license",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-nd-notice": "licensed under cc by nd 4 0",
    "cc0-notice": "released under cc0 1 0",
}


class LicenceRule(NamedTuple):
    licence: str
    sentences: tuple[str, ...]


#: Rules in the order in which they are tried, longer notices before their parts.
RULES = [
    LicenceRule("Apache-2.0", ("apache2-notice", "apache2-may-not", "apache2-obtain", "apache2-as-is", "apache2-see")),
    LicenceRule("MIT", ("mit-title", "mit-grant", "mit-condition", "mit-as-is")),
    LicenceRule("MIT", ("mit-grant", "mit-condition", "mit-as-is")),
    LicenceRule("GPL-3.0-or-later", ("gpl-free", "gpl-redistribute", "gpl-hope")),
    LicenceRule("Apache-2.0", ("apache2-notice", "apache2-may-not")),
    LicenceRule("Apache-2.0", ("apache2-notice",)),
    LicenceRule("MIT", ("mit-notice",)),
    LicenceRule("MIT", ("mit-notice-licensed",)),
    LicenceRule("MIT", ("mit-grant",)),
    LicenceRule("GPL-3.0-only", ("gpl3-notice",)),
    LicenceRule("GPL-2.0-only", ("gpl2-notice",)),
    LicenceRule("GPL-3.0-or-later", ("gpl-redistribute",)),
    LicenceRule("LGPL-3.0-only", ("lgpl3-notice",)),
    LicenceRule("BSD-3-Clause", ("bsd3-notice",)),
    LicenceRule("BSD-2-Clause", ("bsd2-notice",)),
    LicenceRule("MPL-2.0", ("mpl2-notice",)),
    LicenceRule("CC-BY-4.0", ("cc-by-notice",)),
    LicenceRule("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    LicenceRule("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    LicenceRule("CC-BY-ND-4.0", ("cc-by-nd-notice",)),
    LicenceRule("CC0-1.0", ("cc0-notice",)),
]

#: Further sentences of published licence texts; a * stands for any words.
CANONICAL = {
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl2-later": "either version 2 of the license or at your option any later version",
    "gpl3-later": "either version 3 of the license or at your option any later version",
    "gpl2-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl-library": "this library is free software",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl21-later": "either version 2 1 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "agpl3-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl2-copy-http": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd4-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "epl2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at *",
    "epl2-short": "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc-by-full": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-full-the": "this work is licensed under the creative commons attribution 4 0 international license",
    "cc-by-name": "creative commons attribution 4 0 international license",
    "cc-by-sa-full": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-sa-full-the": "this work is licensed under the creative commons attribution sharealike 4 0 international license",
    "cc-by-sa-name": "creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-full": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd-full": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-nc-sa-full": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc0-full": "this work is licensed under a creative commons zero v1 0 universal license",
}

#: Licences by the identifier of a tag line, "SPDX-License-Identifier: <identifier>".
TAGS = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "MPL-2.0", "EPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
]
# The colon ends a sentence, so a tag line is one known sentence with an END inside.
CANONICAL |= {f"spdx-{t}": "spdx license identifier." + " ".join(re.findall("[a-z0-9]+", t.lower())) for t in TAGS}

#: Other wordings of known sentences.
VARIANTS = [
    ("licensed under the apache license version 2 0 the license", "apache2-notice"),
    ("the mit license", "mit-title"),
    ("the mit license mit", "mit-title"),
    ("mit license mit", "mit-title"),
]

#: Rules of published texts, tried before the others.
CANONICAL_RULES = [
    LicenceRule("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    LicenceRule("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    LicenceRule("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is")),
    LicenceRule("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "gpl3-later", "gpl-hope")),
    LicenceRule("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "gpl2-later", "gpl-hope")),
    LicenceRule("GPL-2.0-or-later", ("gpl-free", "gpl2-redistribute", "gpl-hope")),
    LicenceRule("GPL-3.0-or-later", ("gpl-terms", "gpl3-later")),
    LicenceRule("GPL-2.0-or-later", ("gpl-terms", "gpl2-later")),
    LicenceRule("GPL-2.0-or-later", ("gpl2-redistribute",)),
    LicenceRule("LGPL-2.1-or-later", ("lgpl-library", "lgpl-terms", "lgpl21-later", "lgpl-hope")),
    LicenceRule("LGPL-2.1-or-later", ("lgpl-terms", "lgpl21-later")),
    LicenceRule("LGPL-3.0-or-later", ("lgpl-terms", "gpl3-later")),
    LicenceRule("AGPL-3.0-or-later", ("gpl-free", "agpl-terms", "gpl3-later", "gpl-hope")),
    LicenceRule("AGPL-3.0-or-later", ("gpl-free", "agpl3-terms", "gpl-hope")),
    LicenceRule("AGPL-3.0-or-later", ("agpl-terms", "gpl3-later")),
    LicenceRule("AGPL-3.0-or-later", ("agpl3-terms",)),
    LicenceRule("MPL-2.0", ("mpl2-notice", "mpl2-copy")),
    LicenceRule("MPL-2.0", ("mpl2-notice", "mpl2-copy-http")),
    LicenceRule("ISC", ("isc-grant", "isc-as-is")),
    LicenceRule("ISC", ("isc-grant",)),
    LicenceRule("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd4-advertising")),
    LicenceRule("EPL-2.0", ("epl2-notice",)),
    LicenceRule("EPL-2.0", ("epl2-short",)),
    LicenceRule("Unlicense", ("unlicense", "unlicense-anyone")),
    LicenceRule("Unlicense", ("unlicense",)),
    *[LicenceRule("CC-BY-4.0", (k,)) for k in ("cc-by-full", "cc-by-full-the", "cc-by-name")],
    *[LicenceRule("CC-BY-SA-4.0", (k,)) for k in ("cc-by-sa-full", "cc-by-sa-full-the", "cc-by-sa-name")],
    LicenceRule("CC-BY-NC-4.0", ("cc-by-nc-full",)),
    LicenceRule("CC-BY-ND-4.0", ("cc-by-nd-full",)),
    LicenceRule("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-full",)),
    LicenceRule("CC0-1.0", ("cc0-full",)),
    *[LicenceRule(t, (f"spdx-{t}",)) for t in TAGS],
]

#: Words of which every known sentence has one: a text without any of them needs no further look.
ANCHORS = ["licens", "software", "redistribut", "program", "mozilla", "cc0", "library"]

#: Sentences that leave no gap between known ones.
PASSED_OVER = "copyright [a-z0-9 ]+|all rights reserved|https? www apache org licenses license 2 0|[0-9]"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = "_"


def tokens() -> dict[str, str]:
    """A token of one width for each identifier, so that a run of identifiers is a piece of a string."""
    return {name: f"<{i:03d}>" for i, name in enumerate([*SENTENCES, *CANONICAL])}


#: Ends of sentences in a normalised text: one that no sentence passes, and a line break inside a paragraph.
END, WRAP = ".", "|"


def lines(text: Column) -> Column:
    """Normalised text with an END before, after and wherever a sentence ends for sure, and a WRAP at other line breaks;
    only END for a text without words."""
    changed = lambda t, a, b: F.replace(t, F.lit(a), F.lit(b))
    plain = changed(changed(changed(F.coalesce(text, F.lit("")), "\x02", "\x03"), "\r\n", "\n"), "\r", "\n")
    # A number after "v." is a version, and no sentence begins there.
    ended = F.regexp_replace(plain, rf"(?:[!?;:]|(?<!\b[vV])[.]|[.](?![{SPACE}]+[0-9]))[{SPACE}]+", "\x02")
    normal = F.concat(F.lit("\x02"), F.lower(F.regexp_replace(ended, "[^A-Za-z0-9\n\x02]+", " ")), F.lit("\x02"))
    sure = F.regexp_replace(normal, " ?(?:\x02[ \n\x02]*|\n ?[\n\x02][ \n\x02]*)", END)
    return F.regexp_replace(F.regexp_replace(sure, " ?\n ?", WRAP), "[.|]*[.][.|]*", END)


def known_patterns() -> Column:
    """Structs (part, pattern, token) of known sentences, longer ones first: a text without the part cannot have it."""
    of = tokens()
    known = sorted([(v, of[k]) for k, v in [*SENTENCES.items(), *CANONICAL.items()]] + [(v, of[k]) for v, k in VARIANTS], key=lambda x: (-len(x[0]), x[0]))
    pattern = lambda s: f"(?<=[{END}{WRAP}])" + s.replace(" ", f"[ {WRAP}]").replace("*", f"[a-z0-9 {WRAP}]+").replace(".", f"[{END}]") + f"(?=[{END}{WRAP}])"
    return F.array(*[F.struct(F.lit(max(s.split("*"), key=len).strip()).alias("part"), F.lit(pattern(s)).alias("pattern"), F.lit(token).alias("token")) for s, token in known])


def candidates(whole: Column) -> Column:
    """Known sentences whose part occurs in lines(), whatever its line breaks."""
    table, none = known_patterns(), F.array().cast("array<struct<part:string,pattern:string,token:string>>")
    anchored = reduce(lambda a, b: a | b, [F.contains(whole, F.lit(x)) for x in ANCHORS])
    found = let(F.replace(whole, F.lit(WRAP), F.lit(" ")), lambda f: F.filter(table, lambda k: F.contains(f, k["part"])))
    return F.when(anchored, found).otherwise(none)


def with_tokens(whole: Column, found: Column) -> Column:
    """lines() with tokens in place of the known sentences found in it, wrapped or not."""
    return F.aggregate(found, whole, lambda t, k: F.regexp_replace(t, k["pattern"], k["token"]))


def sequence(found: Column) -> Column:
    """Tokens of known sentences in order, one gap for each run of others but those that are passed over."""
    rest = F.regexp_replace(found, f"[{END}{WRAP}](?:{PASSED_OVER})(?=[{END}{WRAP}])", "")
    ids = F.translate(F.regexp_replace(rest, f"[{END}{WRAP}][a-z0-9 ]+(?=[{END}{WRAP}])", GAP), END + WRAP, "")
    return F.regexp_replace(ids, f"{GAP}+", GAP)


def matched(ids: Column, rules: list[LicenceRule]) -> Column:
    """Struct of the licences of all rules that match, in rule order, and the number of matches."""
    of, rest, hits = tokens(), ids, []
    none = F.struct(ids.alias("rest"), F.array().cast("array<string>").alias("licences"), F.lit(0).cast("long").alias("n"))
    table = F.array(*[F.struct(F.lit(r.licence).alias("licence"), F.lit("".join(of[s] for s in r.sentences)).alias("run")) for r in rules])

    def tried(state: Column, rule: Column) -> Column:
        left = F.replace(state["rest"], rule["run"], F.lit(GAP))
        n = F.try_divide(F.length(state["rest"]) - F.length(left), F.length(rule["run"]) - len(GAP)).cast("long")
        return F.when(
            F.contains(state["rest"], rule["run"]),
            F.struct(left.alias("rest"), F.array_union(state["licences"], F.array(rule["licence"])).alias("licences"), (state["n"] + n).alias("n")),
        ).otherwise(state)

    return F.aggregate(table, none, tried)


def recognise(docs: DataFrame, text: str = "text", result: str = "licence", rules: list[LicenceRule] | None = None) -> DataFrame:
    """docs with a struct column `result`: licences (distinct, in rule order), n_matches, n_sentences and n_known; an
    input column of that name is replaced. Null and empty texts have no sentence and no licence. Repeated rows are judged
    alike; an empty table gives an empty table."""

    none = F.array().cast("array<string>")
    ends = lambda found: (F.length(found) - F.length(F.replace(F.replace(found, F.lit(END), F.lit("")), F.lit(WRAP), F.lit(""))) - 1).cast("long")

    def verdict(licences: Column, n_matches: Column, n_sentences: Column, n_known: Column) -> Column:
        return F.struct(licences.alias("licences"), n_matches.cast("long").alias("n_matches"), n_sentences.alias("n_sentences"), n_known.cast("long").alias("n_known"))

    def judged(found: Column) -> Column:
        def of(ids: Column) -> Column:
            known = F.length(F.replace(ids, F.lit(GAP), F.lit("")))
            width = len(next(iter(tokens().values())))
            end = F.when(known > 0, matched(ids, CANONICAL_RULES + RULES if rules is None else rules))
            return let(end, lambda e: verdict(F.coalesce(e["licences"], none), F.coalesce(e["n"], F.lit(0)), ends(found), F.try_divide(known, F.lit(width))))

        return let(sequence(found), of)

    def whole(of: Column) -> Column:
        plain = verdict(none, F.lit(0), ends(of), F.lit(0))
        return let(candidates(of), lambda known: F.when(F.size(known) == 0, plain).otherwise(let(with_tokens(of, known), judged)))

    return docs.withColumn(result, let(lines(F.col(text)), whole))
