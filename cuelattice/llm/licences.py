"""Licence scan by sentence rules: known sentences become identifiers, ordered rules match identifier sequences.

A text is lower-cased and cut into sentences: at signs of an end before white space, at blank lines (also of a comment), around
copyright lines and at "(a)". This is done twice, once with line ends as sentence ends and once with line ends as spaces, since
licence texts are wrapped. Sentences, their signs turned to spaces, that are known give their identifiers in order; a rule
is a sequence of identifiers that must occur in this order, with other known sentences between them allowed. The known sentences
are those of ``PASSAGES``, cut by the same function.

DataFrame functions only; nothing shuffles. Defined results: a null text counts as empty; a text without known sentences
has empty lists; repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import table

_BSD = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. """
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}

#: The passages that tell a licence, as (licence, passage); each is a rule over its sentences in order.
PASSAGES = (
    ("all-rights-reserved", "All rights reserved."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies."""),
    ("isc", """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd-2-clause", _BSD),
    ("bsd-3-clause", _BSD + """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Released under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("apache-2.0", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/"),
    ("hpnd-sell-variant", """Permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted
without fee, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in
supporting documentation."""),
    ("bzip2-1.0.6", """The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required."""),
    ("python-2.0", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"),
    ("blessing", "May you do good and not evil."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License version 3."),
    *((f"{name}-{float(version)}-or-later", _GNU.format(title, version)) for name, title, versions in (("gpl", "General", ("2", "3")), ("lgpl", "Lesser General", ("2.1", "3")), ("agpl", "Affero General", ("3",))) for version in versions),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("lgpl-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("agpl-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software."""),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare
derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""),
    ("cc0-1.0", "CC0 1.0 Universal"),
    ("cc0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    *((f"cc-{k}-4.0", f"This work is licensed under a Creative Commons {title} 4.0 International License.") for k, title in _CC.items()),
    *((f"cc-{k}-3.0", f"This work is licensed under a Creative Commons {title} 3.0 Unported License.") for k, title in _CC.items()),
    *((f"cc-{k}-4.0", f"Licensed under CC {k.upper()} 4.0.") for k in _CC),
)
#: A licence whose passage begins with all of another's: the other one is met beside it only if its last sentence is met more often than
#: the sentence that the longer one adds. "All rights reserved" tells something only where no licence does.
STRONGER = (("bsd-3-clause", "bsd-2-clause"),)
WEAKEST = "all-rights-reserved"

#: Steps over a lower-cased text, as (pattern, replacement): \x01 is a cut. Names of holders in the BSD's third clause are made one.
_SPACE, _MARK = r"[ \t\n\f\r]", r"\(?[0-9a-z]{1,3}\)[ \t]+"
#: A run of stops is tried from its first one only; engines that take linear time anyway do without.
_ONCE = r"(?<![.!?:;])"
STEPS = (
    (r"(^|\n)([ \t#*/]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9]{4}|<)[^\n]*)", "{0}\\2{0}"),
    (rf"({_ONCE}[.!?:;]+[)\x22']*{_SPACE}+|\n[ \t\r#*/;-]*\n{_SPACE}*)({_MARK})?|\n[ \t]*{_MARK}", "{0}"),
)
LINE_STEP = (r"\n", "{0}")
LAST_STEPS = ((r"[^a-z0-9\x01]+", " "), (r"(^|\x01)( ?)neither the name of [a-z0-9 ]+? nor the names of (its|the) contributors", "\\1\\2neither the name of the copyright holder nor the names of its contributors"))
CUT = "\x01"


def steps(wrapped: bool) -> list[tuple[str, str]]:
    return [*STEPS, *([] if wrapped else [LINE_STEP]), *LAST_STEPS]


def sentences_of(text: str) -> list[str]:
    """The sentences of a wrapped text."""
    text = text.lower() + "\n"
    for pattern, new in steps(True):
        text = re.sub(pattern, new.format(CUT), text)
    return [s.strip() for s in text.split(CUT) if s.strip()]


#: Known sentences by identifier, from 1 in the order of the passages; and the rules as (licence, identifiers in order).
SENTENCES = dict(enumerate(dict.fromkeys(s for _, passage in PASSAGES for s in sentences_of(passage)), 1))
_NUMBER = {s: i for i, s in SENTENCES.items()}
RULES = tuple((name, tuple(_NUMBER[s] for s in sentences_of(passage))) for name, passage in PASSAGES)


def telling_words() -> list[str]:
    """A few words of which every known sentence has one: always the one that covers most of the sentences left."""
    left, chosen = [set(s.split()) for s in SENTENCES.values()], []
    while left:
        count: dict[str, int] = {}
        for words in left:
            for w in words:
                count[w] = count.get(w, 0) + (len(w) > 5 or w in ("cc", "cc0"))
        best = max(sorted(count), key=lambda w: (count[w], len(w)))
        chosen.append(best)
        left = [words for words in left if best not in words]
    return chosen


def rule_pattern(ids: tuple[int, ...]) -> str:
    """A pattern over ``,1,5,9,`` that asks for the identifiers in order."""
    return "," + ",([0-9]+,)*".join(map(str, ids)) + ","


def _rule(name: str) -> tuple[int, ...]:
    return next(ids for n, ids in RULES if n == name)


def _told_apart(strong: str, weak: str) -> tuple[int, int]:
    """The last identifier of the shorter rule and the one that the longer rule adds."""
    return _rule(weak)[-1], _rule(strong)[len(_rule(weak))]


def sentence_ids(text: Column, wrapped: bool) -> Column:
    """The identifiers of the known sentences of ``text`` in order, as ``,1,5,9,`` (``,`` if there are none)."""
    low = F.lower(text)
    cut = F.concat(low, F.lit("\n"))
    for pattern, new in steps(wrapped):
        cut = F.regexp_replace(cut, pattern, new.format(CUT).replace("\\", "$"))
    number = F.create_map(*(F.lit(x) for i, s in SENTENCES.items() for x in (s, f"{i},")))
    found = F.filter(F.transform(F.split(cut, CUT), lambda s: F.try_element_at(number, F.trim(s))), lambda x: x.isNotNull())
    # normalising only puts spaces between words, so a text without any telling word has no known sentence and is not cut
    return F.when(reduce(Column.__or__, [low.contains(w) for w in telling_words()]), F.concat(F.lit(","), F.array_join(found, ""))).otherwise(F.lit(","))


def _placed(met: dict) -> list[str]:
    """The licences but the weakest, by name."""
    return sorted(set(met) - {WEAKEST})


def licence_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_sentences, wrapped_sentences, n_known, licences): identifiers with commas, licences by name with commas."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = df.select(F.col(id_col).alias("id"), sentence_ids(text, False).alias("lines"), sentence_ids(text, True).alias("wrapped"))
    by_name: dict[str, list[Column]] = {}
    for name, rule in RULES:
        by_name.setdefault(name, []).append(F.col("lines").rlike(rule_pattern(rule)) | F.col("wrapped").rlike(rule_pattern(rule)))
    met = {name: reduce(Column.__or__, rules) for name, rules in by_name.items()}
    for strong, weak in STRONGER:
        last, more = _told_apart(strong, weak)
        times = lambda c, i: F.size(F.filter(F.split(c, ","), lambda x: x == str(i)))
        beside = reduce(Column.__or__, [F.col(c).rlike(rule_pattern(_rule(weak))) & (~F.col(c).rlike(rule_pattern(_rule(strong))) | (times(c, last) > times(c, more))) for c in ("lines", "wrapped")])
        met[weak] = F.when(met[strong], beside).otherwise(met[weak])
    met[WEAKEST] = met[WEAKEST] & ~reduce(Column.__or__, [met[n] for n in _placed(met)])
    names = F.concat_ws(",", *(F.when(met[name], F.lit(name)) for name in sorted(met)))
    count = F.length("lines") - F.length(F.translate("lines", ",", "")) - 1
    shown = lambda c: F.trim(F.col(c), F.lit(",")).alias(f"{'line' if c == 'lines' else c}_sentences")
    return ids.select(F.col("id").alias(id_col), shown("lines"), shown("wrapped"), count.cast("long").alias("n_known"), names.alias("licences"))


def oracle(rows: str = "documents") -> str:
    """The scan as a DuckDB statement."""
    number = "MAP {" + ", ".join(f"'{s}': '{i},'" for i, s in SENTENCES.items()) + "}"

    def ids(wrapped: bool) -> str:
        cut = "lower(coalesce(text, '')) || chr(10)"
        for pattern, new in steps(wrapped):
            quoted, by = pattern.replace(_ONCE, "").replace("'", "''"), "' || chr(1) || '".join(new.format(CUT).split(CUT))
            cut = f"regexp_replace({cut}, '{quoted}', '{by}', 'g')"
        parts = f"list_transform(string_split({cut}, chr(1)), lambda s: trim(s))"
        return f"',' || coalesce(list_aggregate(list_transform(list_filter({parts}, lambda s: map_contains({number}, s)), lambda s: {number}[s]), 'string_agg', ''), '')"

    by_name: dict[str, list[str]] = {}
    for name, rule in RULES:
        by_name.setdefault(name, []).append(f"regexp_matches(lines, '{rule_pattern(rule)}') OR regexp_matches(wrapped, '{rule_pattern(rule)}')")
    met = {name: f"({' OR '.join(rules)})" for name, rules in by_name.items()}
    for strong, weak in STRONGER:
        last, more = _told_apart(strong, weak)
        times = lambda c, i: f"len(list_filter(string_split({c}, ','), lambda x: x = '{i}'))"
        beside = " OR ".join(f"(regexp_matches({c}, '{rule_pattern(_rule(weak))}') AND (NOT regexp_matches({c}, '{rule_pattern(_rule(strong))}') OR {times(c, last)} > {times(c, more)}))" for c in ("lines", "wrapped"))
        met[weak] = f"(CASE WHEN {met[strong]} THEN {beside} ELSE {met[weak]} END)"
    met[WEAKEST] = f"({met[WEAKEST]} AND NOT ({' OR '.join(met[n] for n in _placed(met))}))"
    names = ", ".join(f"CASE WHEN {met[name]} THEN '{name}' END" for name in sorted(met))
    return f"""WITH ids AS (SELECT doc_id, {ids(False)} AS lines, {ids(True)} AS wrapped FROM {rows})
SELECT doc_id, trim(lines, ',') AS line_sentences, trim(wrapped, ',') AS wrapped_sentences,
       CAST(length(lines) - length(replace(lines, ',', '')) - 1 AS BIGINT) AS n_known, concat_ws(',', {names}) AS licences FROM ids"""


def op6_licences(spark, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))
