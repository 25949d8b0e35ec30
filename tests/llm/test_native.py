"""Quality rules, licenses, preference pairs and url filters against plain Python, with odd rows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from corvane.llm import licenses, preference, quality, registry, urls

SPACE = r"[\x20\x09-\x0D]"


def test_op5_counts(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.op5_quality(spark, sf).collect():
        text = docs[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {k for i, g in enumerate(windows) if windows.count(g) > 1 for k in (i, i + 1, i + 2)} if len(w) < 3000 else None
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)))
        if covered is not None:
            assert r.n_repeat_words == len(covered)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


def test_quality_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (2, "", "a"), (3, "\n \n", "a"), (4, "x y " * 20000, "a"), (5, "\U0001f600 | #\nb\nb", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    out = [r.quality for r in quality.assess(df).collect()]
    assert [q.n_words for q in out] == [0, 0, 0, 0, 40000, 5] and not any(q.kept for q in out)
    assert out[4].n_repeat_words == 40000 and (out[5].n_symbols, out[5].n_dup_lines, out[5].word_chars) == (2, 1, 5)
    assert quality.assess(df.limit(0)).count() == 0


def test_licence_sequences(spark):
    mit = "MIT License\n\n" + " ".join(licenses.SENTENCES[k] + "." for k in ("mit-grant", "mit-condition", "mit-as-is"))
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [(1, None), (2, ""), (3, apache), (3, apache), (4, f"Some text. {apache} More."), (5, mit), (6, "MIT License"), (7, f"{apache}\n{apache}"), (8, (apache + "\nother words.\n") * 3000), (9, "Released under the MIT License. " + apache)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, licence int")
    out = [(r.doc_id, r.licence.licences, r.licence.n_matches) for r in licenses.recognise(df).collect()]
    assert out == [(1, [], 0), (2, [], 0), (3, ["Apache-2.0"], 1), (3, ["Apache-2.0"], 1), (4, ["Apache-2.0"], 1), (5, ["MIT"], 1), (6, [], 0), (7, ["Apache-2.0"], 2), (8, ["Apache-2.0"], 3000), (9, ["Apache-2.0", "MIT"], 2)]
    assert licenses.recognise(df.limit(0)).count() == 0


MIT = """MIT License

Copyright (c) 2024 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
APACHE = """# Copyright 2024 Jane Doe
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
BSD = """Copyright (c) 2024, Jane Doe
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation%s either version %d of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""


def test_licences_as_published_with_wrapped_lines(spark):
    rows = [(MIT, "MIT"), (APACHE, "Apache-2.0"), (BSD % "", "BSD-2-Clause"), (BSD % THIRD, "BSD-3-Clause"), (GPL % (",", 3), "GPL-3.0-or-later"), (GPL % (";", 2), "GPL-2.0-or-later"), (GPL % (";", 3), "GPL-3.0-or-later"), (GPL % (",", 2), "GPL-2.0-or-later")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)] + [(100 + k, t.replace("\n", "\r\n"), x) for k, (t, x) in enumerate(rows)], "doc_id long, text string, expect string")
    out = licenses.recognise(df.repartition(2)).collect()
    assert [(r.doc_id, r.licence.licences, r.licence.n_matches) for r in out] == [(r.doc_id, [r.expect], 1) for r in out] and len(out) == 16


LATER = """    {0} is free software{1} you can redistribute it and/or
    modify it under the terms of the GNU {2} General Public
    License as published by the Free Software Foundation{3} either
    version {4} of the License, or (at your option) any later version.

    {0} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
"""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
OLD_BSD = (BSD % "").split("THIS SOFTWARE")[0].split("\n", 1)[1] + """3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement: This product includes software.
"""
CC = "This work is licensed under a Creative Commons Attribution{} 4.0\nInternational License."


def test_further_published_notices(spark):
    """Wrapped, on one line, and between other paragraphs."""
    notices = [
        (MPL, "MPL-2.0"), (ISC, "ISC"), (EPL, "EPL-2.0"), (UNLICENSE, "Unlicense"), (OLD_BSD, "BSD-4-Clause"), (CC.format(""), "CC-BY-4.0"), (CC.format("-ShareAlike"), "CC-BY-SA-4.0"),
        (LATER.format("This library", ";", "Lesser", ";", "2.1"), "LGPL-2.1-or-later"), (LATER.format("This program", ":", "Affero", ", ", "3"), "AGPL-3.0-or-later"),
        ("# SPDX-License-Identifier: BSD-3-Clause\n", "BSD-3-Clause"), ("// SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1-or-later"), ("Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    ]
    forms = [lambda t: t, lambda t: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n")), lambda t: f"First words.\n\n{t}\n\nLast words."]
    rows = [(k * 10 + i, f(t), x) for k, (t, x) in enumerate(notices) for i, f in enumerate(forms)]
    out = licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string, expect string").repartition(2)).collect()
    assert [(r.doc_id, r.licence.licences) for r in out if r.licence.licences != [r.expect]] == [] and len(out) == len(rows)
    plain = spark.createDataFrame([("Version v. 2.0 of it. And v. two. Software.",), ("SPDX-License-Identifier: Unknown-1.0",)], "text string")
    assert [(r.licence.licences, r.licence.n_sentences) for r in licenses.recognise(plain).collect()] == [([], 4), ([], 2)]


def test_every_known_sentence_has_an_anchor():
    known = [*licenses.SENTENCES.values(), *licenses.CANONICAL.values(), *[v for v, _ in licenses.VARIANTS]]
    assert not [k for k in known if not any(a in k for a in licenses.ANCHORS)]


def shown(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


@pytest.mark.parametrize(
    ("chosen", "rejected", "n"),
    [
        ([("user", "hi"), ("assistant", "yes")], [("user", "hi"), ("assistant", "no")], 1),
        ([("user", "hi")], [("user", "hi"), ("assistant", "ünd")], 1),
        ([("user", "a")], [("system", "a")], 0),
        ([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "b")], 2),
        ([], [("user", "a")], 0),
        (None, [("user", None), (None, "x")], 0),
    ],
)
def test_preference_pairs(spark, chosen, rejected, n):
    df = spark.createDataFrame([(chosen, rejected, 1)], f"chosen {preference.TURNS}, rejected {preference.TURNS}, preference int")
    row = preference.format_pairs(df).collect()[0]
    p = row.preference
    clean = lambda x: [(r or "user", t or "") for r, t in x or []]
    c, r = clean(chosen), clean(rejected)
    assert (p.n_common, p.prompt, p.chosen, p.rejected) == (n, shown(c[:n]), shown(c[n:]), shown(r[n:]))
    for text, spans, turns in ((p.chosen, p.chosen_mask, c[n:]), (p.rejected, p.rejected_mask, r[n:])):
        assert [text[s.start : s.end] for s in spans] == [t + "<|im_end|>" for role, t in turns if role == "assistant"]


def test_op8_odd_conversations(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, 0, "user", None), (None, 0, None, "x"), (3, 5, "assistant", "only")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.conv_id: r for r in registry.op8_preference(spark, str(tmp_path)).collect()}
    assert len(out) == 4 and out[1].n_common == 3 and out[2].chosen == "" and out[None].prompt == shown([("user", "x")])
    assert out[3].rejected == shown([("assistant", "")]) and out[3].rejected_mask == "22:32"


def test_conversations_empty_long_and_with_clashing_columns(spark):
    ddl = "conv_id long, turn long, role string, text string, turns string, Preference int"
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i} " * 50, "x", 1) for i in range(2001)] + [(2, 0, "user", "x" * 300_000, None, None)]
    df = spark.createDataFrame(rows, ddl)
    pairs = preference.with_rejected(preference.turns_of(df))
    out = {r.conv_id: r.preference for r in preference.format_pairs(pairs).collect()}
    chosen = [(r[2], r[3]) for r in rows[:2001]]
    n = 1999  # up to the last assistant turn
    assert out[1].n_common == n and out[1].prompt == shown(chosen[:n]) and out[1].chosen == shown(chosen[n:])
    assert out[1].rejected == shown([("assistant", rows[1997][3])])
    assert out[2].n_common == 1 and len(out[2].prompt) > 300_000 and out[2].chosen == out[2].rejected == ""
    none = preference.format_pairs(preference.with_rejected(preference.turns_of(df.limit(0))))
    assert none.count() == 0 and "preference" in none.columns


def reference_rule(host, path):
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_url_filter(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/de/x?y#z", "http://example.net/en/1", "x://www.example.net/fr", "http://y.org/fr/", "http://org", "http://fooexample.com/de/", "a://b://c.net/", "http://net?x", "http://net/", "ftp://ÄB.net/é", "http://www.cheap-pills.example.com/fr/176/", "http://museum.example.com/fr/" + "a" * 20000, "http://www.museum.example.com/fr/176/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(odd)] * 2, "page_id long, url string, rule string")
    out = urls.judge(df).collect()
    assert len(out) == 2 * len(odd)
    for r in out:
        m = re.search(r"://([^/?#]*)([^?#]*)", odd[r.page_id] or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        rule, verdict = reference_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= urls.BLOCK_AT else "allow"))
    by = {odd[r.page_id]: r.verdict for r in out}
    assert by[odd[-3]] == "block" and by[odd[-1]] == "allow"
    assert urls.judge(df.limit(0)).count() == 0


def scores(spark, names):
    df = spark.createDataFrame([(f"http://www.{n}.example.com/en/7",) for n in names], "url string")
    return [r.score for r in urls.judge(df).collect()]


def test_url_model_on_held_out_names(spark):
    """Names that the labelled table lacks, made of its parts."""
    unwanted = ["best-poker", "discount-viagra", "jackpot-slots", "loans-payday-quick"]
    wanted = ["city-museum", "school-library", "weather-research", "garden-history"]
    assert min(scores(spark, unwanted)) > max(scores(spark, wanted))


def test_url_model_on_names_without_a_known_part(spark):
    """Little can be known of such names: the model ranks them better than chance, and blocks few."""
    unwanted = ["bingo-palace", "blackjack", "roulette", "nudepics", "lottery-winner", "hairloss-cure", "phishing-kit", "malware-drop", "penny-auction", "bitcoin-double", "webcam-babes", "iptv-reseller"]
    wanted = ["ornithology", "bakery", "monastery", "kayaking", "cathedral", "radio-amateur", "seismology", "veterinary", "bookbinding", "marathon", "vineyard", "observatory"]
    bad, good = scores(spark, unwanted), scores(spark, wanted)
    ranked = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / len(bad) / len(good)
    assert ranked > 0.55 and sum(x >= urls.BLOCK_AT for x in good) <= 1


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_labelled_names_share_nothing_with_the_test_pages(spark, scale):
    """No labelled name is part of a host, and no part of a host's hyphenated names, which are the unwanted sites, is in a
    labelled name (parts of one or two letters: is a part of one)."""
    hosts = {r.host for r in spark.read.parquet(f"/root/testdata/{scale}/pages.parquet").select(urls.host_of(F.col("url")).alias("host")).distinct().collect()}
    names = {p for h in hosts for p in h.split(".")}
    labelled = {*urls.UNWANTED, *urls.WANTED}
    assert not names & labelled
    parts = {p for n in names if "-" in n for p in n.split("-")}
    assert parts and not [(p, n) for p in parts for n in labelled if (p in n if len(p) > 2 else p in n.split("-"))]
