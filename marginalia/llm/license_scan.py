"""License scan: ordered signature rules behind a keyword prefilter.

A text becomes its words, lower-cased (A-Z) and joined by single spaces. Each rule is a
regular expression over that string, written by hand from the wording of a license, its notice or its name; its keyword, the
longest stretch of words without which it cannot match, is read off the expression, and
only rules whose keyword occurs in the text run. What they find are intervals of
words. They are resolved in order of priority, then length, then place: one that lies
inside an interval that comes before it is suppressed; others stay, overlapping or not. A sweep over the sorted intervals for
each priority does this in time in proportion to their number.

The three base phrases are rules of the highest priority, which nothing suppresses.

Defined results: a null text counts as empty and has no words, no labels (empty strings),
null places and score 0; a very long text, or endless repeats of a phrase, takes time in proportion to its length; repeated rows
repeat their result; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

# Phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TOP = 100

# Identifiers in headers: priority 90, confidence 1.
IDENTIFIERS = r"""
mit             | spdx license identifier mit
mit-0           | spdx license identifier mit 0
apache-2        | spdx license identifier apache 2 0
bsd-2-clause    | spdx license identifier bsd 2 clause
bsd-3-clause    | spdx license identifier bsd 3 clause
bsd-0-clause    | spdx license identifier 0bsd
isc             | spdx license identifier isc
zlib            | spdx license identifier zlib
gpl-2           | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3           | spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2.1        | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3          | spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3          | spdx license identifier agpl 3 0(?: only| or later)?
mpl-2           | spdx license identifier mpl 2 0
epl-1           | spdx license identifier epl 1 0
epl-2           | spdx license identifier epl 2 0
cddl            | spdx license identifier cddl 1 [01]
eupl            | spdx license identifier eupl 1 [12]
unlicense       | spdx license identifier unlicense
boost           | spdx license identifier bsl 1 0
busl-1.1        | spdx license identifier busl 1 1
cc0             | spdx license identifier cc0 1 0
cc-by-4.0       | spdx license identifier cc by 4 0
cc-by-sa-4.0    | spdx license identifier cc by sa 4 0
ofl-1.1         | spdx license identifier ofl 1 1
artistic-2      | spdx license identifier artistic 2 0
elastic-2       | spdx license identifier elastic 2 0
postgresql      | spdx license identifier postgresql
"""

# Sentences of the licenses themselves: priority 80, confidence 0.95.
SENTENCES = r"""
mit             | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit             | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit             | to use copy modify merge publish distribute sublicense and or sell copies of the software
mit-0           | permission is hereby granted free of charge to any person obtaining a copy of this software (?:\w+ ){1,40}without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
isc             | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
bsd-0-clause    | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd             | redistribution and use in source and binary forms with or without modification are permitted
bsd             | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd             | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause    | neither the name of (?:\w+ ){1,12}nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-4-clause    | all advertising materials mentioning features or use of this software must display the following acknowledgement
apache-1        | the end user documentation included with the redistribution if any must include the following acknowledg(?:e)?ment
apache-2        | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2        | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2        | terms and conditions for use reproduction and distribution
gpl             | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl             | this program is distributed in the hope that it will be useful but without any warranty
gpl-2           | gnu general public license as published by the free software foundation version 2
gpl-2           | gnu general public license as published by the free software foundation either version 2 of the license
gpl-3           | gnu general public license as published by the free software foundation version 3
gpl-3           | gnu general public license as published by the free software foundation either version 3 of the license
gpl             | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl-3           | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-2           | the licenses for most software are designed to take away your freedom to share and change it
lgpl            | gnu lesser general public license as published by the free software foundation
lgpl-2.1        | gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-3          | gnu lesser general public license as published by the free software foundation either version 3
lgpl-2          | gnu library general public license as published by the free software foundation
agpl-3          | gnu affero general public license as published by the free software foundation
agpl-3          | the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software
gfdl            | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2           | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1         | the contents of this file are subject to the mozilla public license version 1 1
npl             | the contents of this file are subject to the netscape public license
epl-1           | this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0
epl-2           | this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?2 0
cpl-1           | the accompanying program is provided under the terms of this common public license
ipl-1           | the accompanying program is provided under the terms of this ibm public license
cddl            | the contents of this file are subject to the terms of the common development and distribution license
eupl            | licensed under the eupl version 1 [12]
zlib            | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib            | the origin of this software must not be misrepresented you must not claim that you wrote the original software
boost           | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unlicense       | this is free and unencumbered software released into the public domain
unlicense       | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl           | you just do what the fuck you want to
beerware        | if we meet some day and you think this stuff is worth it you can buy me a beer in return
openssl         | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay          | this package is an ssl implementation written by eric young
python          | psf is making python available to licensee on an as is basis
python          | psf hereby grants licensee a nonexclusive royalty free world wide license
php             | this product includes php software freely available from
ruby            | you may make and give away verbatim copies of the source form of the software without restriction
perl            | you can redistribute it and or modify it under the same terms as perl itself
artistic-1      | you may copy and give away verbatim copies of the source form of the standard version of this package without restriction
artistic-2      | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
vim             | there are no restrictions on distributing unmodified copies of vim
ms-pl           | if you use the software you accept this license if you do not accept the license do not use the software
ms-rl           | for any file you distribute that contains code from the software (?:\w+ ){1,10}you must provide recipients the source code to that file
ofl-1.1         | this font software is licensed under the sil open font license version 1 1
ofl-1.1         | the fonts and derivatives however cannot be released under any other type of license
x11             | except as contained in this notice the name of the x consortium shall not be used in advertising
ncsa            | developed by (?:\w+ ){1,12}permission is hereby granted free of charge to any person obtaining a copy of this software
postgresql      | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd            | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
curl            | copyright and permission notice copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])? daniel stenberg
icu             | icu license icu 1 8 1 and later
unicode         | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
w3c             | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms and conditions
jpeg            | this software is based in part on the work of the independent jpeg group
freetype        | portions of this software are copyright (?:c )?(?:\w+ ){1,4}the freetype project
libpng          | this copy of the libpng notices is provided for your convenience
bzip2           | this program bzip2 the associated library libbzip2 and all documentation are copyright
json            | the software shall be used for good not evil
elastic-2       | you may not provide the software to third parties as a hosted or managed service
sspl            | if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1        | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
commons-clause  | without limiting other conditions in the license the grant of rights under the license will not include and the license does not grant to you the right to sell the software
odbl            | this database is made available under the open database license
odc-by          | this (?:\w+ ){1,8}is made available under the open data commons attribution license
pddl            | this (?:\w+ ){1,8}is made available under the public domain dedication and license
cc0             | to the extent possible under law (?:\w+ ){1,8}has waived all copyright and related or neighboring rights to
cc              | to view a copy of this license visit https? creativecommons org licenses
openrail        | you agree not to use the model or derivatives of the model
llama           | is licensed under the llama (?:[23] )?community license
gemma           | gemma is provided under and subject to the gemma terms of use
"""

# Grants and notices that name a license: priority 60, confidence 0.9.
GRANTS = r"""
mit             | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?mit(?: x11)?(?: license)?
mit             | (?:licensed|released|distributed|available) under an mit style license
mit             | the mit license mit
mit             | under the expat license
x11             | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?x11 license
apache-2        | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?(?: license)?
apache-1        | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?apache(?: software)? license(?: version)? 1 [01]
apache          | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?apache(?: software)? license
bsd             | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?bsd(?: style)? license
bsd             | use of this source code is governed by a bsd style license
bsd-2-clause    | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)(?: license)?
bsd-3-clause    | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: license)?
isc             | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?isc license
zlib            | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?zlib(?: libpng)? license
gpl             | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:gnu )?(?:gpl|general public license)
gpl-2           | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:gnu )?(?:gpl|general public license) ?(?:version |v)?2(?: 0)?
gpl-3           | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:gnu )?(?:gpl|general public license) ?(?:version |v)?3(?: 0)?
gpl             | may be distributed under the terms of the gnu general public license
gpl-2           | gpl version 2 or (?:at your option )?(?:any )?later
gpl-3           | gpl version 3 or (?:at your option )?(?:any )?later
lgpl            | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:gnu )?(?:lgpl|lesser general public license)
lgpl-2.1        | (?:gnu )?(?:lgpl|lesser general public license) ?(?:version |v)?2 1
lgpl-3          | (?:gnu )?(?:lgpl|lesser general public license) ?(?:version |v)?3(?: 0)?
agpl-3          | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:gnu )?(?:agpl|affero general public license)
agpl-3          | (?:gnu )?(?:agpl|affero general public license) ?(?:version |v)?3(?: 0)?
gfdl            | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:gnu )?(?:gfdl|free documentation license)
mpl             | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:mpl|mozilla public license)
mpl-2           | mozilla public license ?(?:version |v)?2(?: 0)?
mpl-1.1         | mozilla public license ?(?:version |v)?1 1
epl             | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:epl|eclipse public license)
epl-1           | eclipse public license ?(?:version |v)?1 0
epl-2           | eclipse public license ?(?:version |v)?2 0
cddl            | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:cddl|common development and distribution license)
eupl            | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:eupl|european union public licen[cs]e)
boost           | distributed under the boost software license version 1 0
unlicense       | (?:licensed|released|distributed|available) under (?:the )?unlicense
wtfpl           | (?:licensed|released|distributed|available) under (?:the )?(?:wtfpl|do what the fuck you want to public license)
artistic        | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?artistic license
python          | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?(?:psf|python software foundation|python) license
php             | subject to version 3 01? of the php license
ms-pl           | (?:licensed|released|distributed|available) under (?:the )?microsoft public license
ms-rl           | (?:licensed|released|distributed|available) under (?:the )?microsoft reciprocal license
ofl-1.1         | (?:licensed|released|distributed|available) under (?:the )?(?:sil )?open font license
odbl            | (?:licensed|released|distributed|available) under (?:the )?(?:odbl|open database license)
elastic-2       | (?:licensed|released|distributed|available) under (?:the )?elastic license
sspl            | (?:licensed|released|distributed|available) under (?:the )?server side public license
busl-1.1        | (?:licensed|released|distributed|available) under (?:the )?business source license
cc              | (?:licensed|released|distributed|available) under (?:a |the )?creative commons
cc-by           | creative commons attribution (?:\w+ )?licen[cs]e
cc-by-sa        | creative commons attribution share ?alike
cc-by-nd        | creative commons attribution no ?deriv(?:ative)?s
cc-by-nc        | creative commons attribution non ?commercial
cc-by-nc-sa     | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd     | creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc0             | creative commons zero
public-domain   | (?:released|placed|dedicated) (?:in|in to|into|to) the public domain
public-domain   | this work is in the public domain
"""

# Names and links: priority 40, confidence 0.7.
NAMES = r"""
mit             | mit licen[cs]ed?
mit             | opensource org licenses mit
apache-2        | apache licen[cs]e ?(?:version |v)?2(?: 0)?
apache-2        | apache org licenses license 2 0
apache          | apache licen[cs]e
bsd             | bsd licen[cs]ed?
bsd-2-clause    | (?:2 clause bsd|simplified bsd|bsd 2 clause) licen[cs]e
bsd-3-clause    | (?:3 clause bsd|new bsd|bsd 3 clause) licen[cs]e
isc             | isc licen[cs]e
zlib            | zlib licen[cs]e
gpl             | gnu general public licen[cs]e
gpl             | gnu gpl
gpl-2           | gpl ?v2
gpl-3           | gpl ?v3
gpl             | gnu org licenses gpl
lgpl            | gnu lesser general public licen[cs]e
lgpl            | gnu org licenses lgpl
agpl-3          | gnu affero general public licen[cs]e
agpl-3          | agpl ?v3
gfdl            | gnu free documentation licen[cs]e
mpl             | mozilla public licen[cs]e
epl             | eclipse public licen[cs]e
cddl            | common development and distribution licen[cs]e
boost           | boost software licen[cs]e
artistic        | artistic licen[cs]e
ofl-1.1         | sil open font licen[cs]e
odbl            | open database licen[cs]e
elastic-2       | elastic licen[cs]e 2 0
busl-1.1        | business source licen[cs]e
cc-by-4.0       | cc by 4 0
cc-by-3.0       | cc by 3 0
cc-by-2.0       | cc by 2 [05]
cc-by-sa-4.0    | cc by sa 4 0
cc-by-sa-3.0    | cc by sa 3 0
cc-by-sa-2.0    | cc by sa 2 [05]
cc-by-nd-4.0    | cc by nd 4 0
cc-by-nd-3.0    | cc by nd 3 0
cc-by-nc-4.0    | cc by nc 4 0
cc-by-nc-3.0    | cc by nc 3 0
cc-by-nc-sa-4.0 | cc by nc sa 4 0
cc-by-nc-sa-3.0 | cc by nc sa 3 0
cc-by-nc-nd-4.0 | cc by nc nd 4 0
cc-by-nc-nd-3.0 | cc by nc nd 3 0
cc-by-sa        | cc by sa
cc-by-nd        | cc by nd
cc-by-nc-sa     | cc by nc sa
cc-by-nc-nd     | cc by nc nd
cc0             | cc0
cc-by           | creativecommons org licenses by
cc0             | creativecommons org publicdomain zero
"""

# What tells of rights without a license: priority 10, confidence 0.5.
HINTS = r"""
proprietary     | all rights reserved
proprietary     | proprietary and confidential
proprietary     | not for redistribution
proprietary     | unauthorized copying of this file
proprietary     | may not be reproduced without (?:prior |written |express )*permission
proprietary     | end user license agreement
copyright       | copyright (?:c )?(?:19|20)[0-9][0-9]
copyright       | this file is part of
patent          | patent pending
export          | subject to (?:the )?(?:us |united states )?export (?:control|administration)
"""
TABLES = ((90, 1.0, IDENTIFIERS), (80, 0.95, SENTENCES), (60, 0.9, GRANTS), (40, 0.7, NAMES), (10, 0.5, HINTS))


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: bytes
    confidence: float
    pattern: re.Pattern


def keyword_of(expression: str) -> str:
    """The longest stretch of the expression that stands in whatever it matches: outside of groups, classes and what may be missing."""
    plain, depth = [""], 0
    for k, c in enumerate(expression):
        after = expression[k + 1 : k + 2]
        if c == "(":
            depth += 1
        if depth or c in "[]?*+{}\\" or after in ("?", "*", "{") or "[" in expression[:k] and "]" not in expression[expression.rindex("[", 0, k) : k]:
            plain.append("")
        else:
            plain[-1] += c
        if c == ")":
            depth -= 1
    return max(plain, key=len)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, in the order of their priorities."""
    rows = [(TOP, 1.0, label, phrase) for phrase, label in BASE.items()]
    for priority, confidence, table in TABLES:
        rows += [(priority, confidence, *(x.strip() for x in line.split("|", 1))) for line in table.strip().splitlines()]
    return tuple(Rule(priority, label, keyword_of(expression).encode(), confidence, re.compile(rf"(?<= )(?:{expression})(?= )".encode())) for priority, confidence, label, expression in rows)


@cache
def keywords() -> ahocorasick.Automaton:
    """Finds all keywords in one pass; each names the numbers of its rules."""
    numbers: dict[bytes, list[int]] = {}
    for k, rule in enumerate(rules()):
        numbers.setdefault(rule.keyword, []).append(k)
    found = ahocorasick.Automaton()
    for keyword, own in numbers.items():
        found.add_word(keyword.decode("latin-1"), own)
    found.make_automaton()
    return found


#: Of a byte: itself, in lower case, if it is part of a word; a space if not.
WORD_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


class Found(NamedTuple):
    start: int
    end: int
    label: str
    priority: int
    confidence: float


def detections(joined: bytes) -> list[Found]:
    """What the rules find in words that are joined, led and followed by single spaces, after suppression."""
    own, seen, hits = rules(), set(), []
    for _, numbers in keywords().iter(joined.decode("latin-1")):
        seen.update(numbers)
    for rule in map(own.__getitem__, sorted(seen)):
        hits += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(joined)]
    # Words are counted once from the start to the end of the text.
    number, at, n = {}, 0, 0
    for place in sorted({p for a, b, _ in hits for p in (a, b)}):
        n += joined.count(b" ", at, place)
        number[place] = n
        at = place
    return resolved([Found(number[a] - 1, number[b], rule.label, rule.priority, rule.confidence) for a, b, rule in hits])


def resolved(found: list[Found]) -> list[Found]:
    """Keeps what isn't contained in an interval that comes before it in the order of priority, length, place and label.

    Whether that interval is itself suppressed makes no difference, as what contains it contains this one as well.
    """
    kept: list[Found] = []
    before: list[Found] = []
    for priority in sorted({f.priority for f in found}, reverse=True):
        # At each start the longest comes first: of one priority it is before what it contains.
        own = sorted((f for f in found if f.priority == priority), key=lambda f: (f.start, -f.end, f.label))
        reach, k = -1, 0
        for f in own:
            while k < len(before) and before[k].start <= f.start:
                reach = max(reach, before[k].end)
                k += 1
            if priority == TOP or f.end > reach:
                kept.append(f)
            reach = max(reach, f.end)
        before = sorted(before + own, key=lambda f: f.start)
    return sorted(kept)


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    words = text.translate(WORD_BYTES).split()
    found = detections(b" ".join([b"", *words, b""]))
    places = [f.start for f in found if f.priority == TOP]
    base = {f.label for f in found if f.priority == TOP}
    score = max((f.confidence for f in found), default=0.0)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted({f.label for f in found})), score


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts and places of the base phrases, labels of all rules, highest confidence."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t) for t in as_bytes(batch.column(1))]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
