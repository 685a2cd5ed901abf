"""Licence recognition by sentences and rules.

A text's sentences are normalised and mapped to identifiers of known licence sentences. The
sequence of identifiers is matched against ordered rules; the first rule that matches at a
place takes its sentences, so a longer notice goes before the single sentences in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "mit-released": ["Released under the MIT License", "Licensed under the MIT License", "Licensed under the MIT license", "This project is licensed under the MIT License", "This software is released under the MIT License", "MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "mit-0-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"],
    "isc-released": ["Licensed under the ISC License", "Released under the ISC License", "ISC License", "SPDX-License-Identifier: ISC"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "0bsd-released": ["Licensed under the Zero-Clause BSD license", "SPDX-License-Identifier: 0BSD"],
    "apache-short": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Licensed under the Apache License 2.0", "Released under the Apache License 2.0", "This project is licensed under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "apache-header": ["Apache License Version 2.0, January 2004"],
    "apache-comply": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache-specific": ["See the License for the specific language governing permissions and limitations under the License"],
    "gpl3-short": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0", "Released under the GNU General Public License v3.0", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl3-short-later": ["Licensed under the GNU General Public License v3.0 or later", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl3-header": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl3-only-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"],
    "gpl2-short": ["Licensed under the GNU General Public License v2.0", "Licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl2-short-later": ["Licensed under the GNU General Public License v2.0 or later", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl2-header": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl2-only-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl-details": ["See the GNU General Public License for more details"],
    "gpl-received": ["You should have received a copy of the GNU General Public License along with this program"],
    "lgpl3-short": ["Licensed under the GNU Lesser General Public License v3.0", "Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"],
    "lgpl3-free": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "lgpl21-short": ["Licensed under the GNU Lesser General Public License v2.1", "Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only"],
    "lgpl21-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "lgpl-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "lgpl-details": ["See the GNU Lesser General Public License for more details"],
    "agpl-short": ["Licensed under the GNU Affero General Public License v3.0", "Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "agpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "agpl-details": ["See the GNU Affero General Public License for more details"],
    "mpl2-short": ["Licensed under the Mozilla Public License 2.0", "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "mpl2-form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "epl2-short": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution", "Licensed under the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "bsd-released-3": ["Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "bsd-released-2": ["Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "bsd-redist": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain"],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "unlicense-short": ["Released under the Unlicense", "Licensed under the Unlicense", "SPDX-License-Identifier: Unlicense"],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "boost-short": ["Distributed under the Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003", "SPDX-License-Identifier: BSL-1.0"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-liable": ["In no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "wtfpl": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "SPDX-License-Identifier: WTFPL"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "This work is dedicated to the public domain under CC0 1.0", "Licensed under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "cc-by-4": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "This work is licensed under the Creative Commons Attribution 4.0 International License"],
    "cc-by-3": ["Licensed under CC BY 3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License"],
    "cc-by-sa-4": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-sa-3": ["Licensed under CC BY-SA 3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License", "Text is available under the Creative Commons Attribution-ShareAlike License 3.0"],
    "cc-by-nc-4": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nc-sa-4": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd-4": ["Licensed under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-nc-nd-4": ["Licensed under CC BY-NC-ND 4.0", "This work is licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "all-rights": ["All rights reserved"],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
}

#: Ordered rules: a licence, the identifiers that follow one another, and how many other sentences may lie between two.
RULES = [
    ("MIT", ("mit-grant", "mit-notice"), 1),
    ("MIT", ("mit-grant",), 0),
    ("MIT-0", ("mit-0-grant",), 0),
    ("MIT", ("mit-released",), 0),
    ("BSL-1.0", ("boost-short", "boost-grant"), 1),
    ("BSL-1.0", ("boost-grant",), 0),
    ("BSL-1.0", ("boost-short",), 0),
    ("ISC", ("isc-grant",), 0),
    ("ISC", ("isc-released",), 0),
    ("0BSD", ("0bsd-grant",), 0),
    ("0BSD", ("0bsd-released",), 0),
    ("Apache-2.0", ("apache-short", "apache-comply", "apache-copy", "apache-as-is", "apache-specific"), 1),
    ("Apache-2.0", ("apache-short", "apache-comply", "apache-copy"), 1),
    ("Apache-2.0", ("apache-short",), 0),
    ("Apache-2.0", ("apache-header",), 0),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope", "agpl-details"), 1),
    ("AGPL-3.0-or-later", ("agpl-free",), 0),
    ("AGPL-3.0-only", ("agpl-short",), 0),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope", "lgpl-details"), 1),
    ("LGPL-3.0-or-later", ("lgpl3-free",), 0),
    ("LGPL-3.0-only", ("lgpl3-short",), 0),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-details"), 1),
    ("LGPL-2.1-or-later", ("lgpl21-free",), 0),
    ("LGPL-2.1-only", ("lgpl21-short",), 0),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details"), 1),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope"), 1),
    ("GPL-3.0-or-later", ("gpl-free",), 0),
    ("GPL-3.0-or-later", ("gpl3-short-later",), 0),
    ("GPL-3.0-only", ("gpl3-only-free", "gpl-hope"), 1),
    ("GPL-3.0-only", ("gpl3-only-free",), 0),
    ("GPL-3.0-only", ("gpl3-short",), 0),
    ("GPL-3.0-only", ("gpl3-header",), 0),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details"), 1),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope"), 1),
    ("GPL-2.0-or-later", ("gpl2-free",), 0),
    ("GPL-2.0-or-later", ("gpl2-short-later",), 0),
    ("GPL-2.0-only", ("gpl2-only-free", "gpl-hope"), 1),
    ("GPL-2.0-only", ("gpl2-only-free",), 0),
    ("GPL-2.0-only", ("gpl2-short",), 0),
    ("GPL-2.0-only", ("gpl2-header",), 0),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy"), 1),
    ("MPL-2.0", ("mpl2-form",), 0),
    ("MPL-2.0", ("mpl2-short",), 0),
    ("EPL-2.0", ("epl2-short",), 0),
    ("BSD-4-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"), 1),
    ("BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse"), 1),
    ("BSD-2-Clause", ("bsd-redist", "bsd-source", "bsd-binary"), 1),
    ("BSD", ("bsd-redist",), 0),
    ("BSD-3-Clause", ("bsd-released-3",), 0),
    ("BSD-2-Clause", ("bsd-released-2",), 0),
    ("Unlicense", ("unlicense-free", "unlicense-anyone"), 1),
    ("Unlicense", ("unlicense-free",), 0),
    ("Unlicense", ("unlicense-short",), 0),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant"), 1),
    ("Zlib", ("zlib-grant",), 0),
    ("WTFPL", ("wtfpl",), 0),
    ("CC0-1.0", ("cc0",), 0),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4",), 0),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",), 0),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",), 0),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",), 0),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",), 0),
    ("CC-BY-SA-3.0", ("cc-by-sa-3",), 0),
    ("CC-BY-4.0", ("cc-by-4",), 0),
    ("CC-BY-3.0", ("cc-by-3",), 0),
]

# Names by which a licence is called, with or without the word licence after them.
NAMES = {
    "MIT": ["MIT", "MIT/X11", "Expat"], "ISC": ["ISC"], "0BSD": ["0BSD", "Zero-Clause BSD"], "BSD-2-Clause": ["BSD-2-Clause", "BSD 2-Clause", "2-Clause BSD", "Simplified BSD"],
    "BSD-3-Clause": ["BSD-3-Clause", "BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD"], "Apache-2.0": ["Apache-2.0", "Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0"],
    "MPL-2.0": ["MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"], "EPL-2.0": ["EPL-2.0", "Eclipse Public License 2.0"], "BSL-1.0": ["BSL-1.0", "Boost Software License 1.0"],
    "Zlib": ["zlib"], "Unlicense": ["Unlicense"], "CC0-1.0": ["CC0-1.0", "CC0 1.0"],
    **{f"{g}GPL-{v}-{only}": [f"{g}GPL-{v}-{only}", *([f"{g}GPL-{v}+", f"{g}GPLv{v[0] if v.endswith('.0') else v}+", f"{g}GPL-{v} or later"] if only == "or-later" else [f"{g}GPL-{v}", f"{g}GPLv{v[0] if v.endswith('.0') else v}"])]
       for g, versions in (("", ("2.0", "3.0")), ("L", ("2.1", "3.0")), ("A", ("3.0",))) for v in versions for only in ("only", "or-later")},
}
_THINGS = "project software library package program module work code source file repository product".split()
_VERBS = ["Licensed under", "Released under", "Distributed under", "Available under", "Provided under", "Licensed under the terms of", "Released under the terms of", "Distributed under the terms of", "Available under the terms of"]


def _called() -> dict[str, str]:
    """Sentences that name a licence, made of verbs, things and names, by their normal form."""
    out = {}
    for licence, names in NAMES.items():
        calls = [c for n in names for c in (n, *([f"{n} license", f"{n} licence"] if "license" not in n.lower() else []))]
        verbs = [*_VERBS, *(f"This {x} is {v[0].lower()}{v[1:]}" for x in _THINGS for v in _VERBS)]
        forms = [f"{start}{c}" for c in calls for start in ("License: ", "Licence: ", *(f"{v} {the}" for v in verbs for the in ("", "the ")))]
        out |= {normalised(f): f"named-{licence}" for f in forms}
    return out


_END = re.compile(r"(?<=[.!?;])[ \t]+")
_FIRST = re.compile(r"[^a-z0-9]*(?:(?:rem|dnl)\b[^a-z0-9]*)?([a-z0-9]+)", re.I)
_OTHER = re.compile(r"[^a-z0-9]+")
_PLUS = re.compile(r"(?<=[0-9])\+(?![a-z0-9+])")


def normalised(sentence: str) -> str:
    """Lower-cased runs of letters and digits, joined by single spaces; a plus after a version is a word."""
    return _OTHER.sub(" ", _PLUS.sub(" plus ", sentence.lower())).strip()


#: The sentences in the table, and those that are made; where both say the same, the table holds.
KNOWN = _called() | {normalised(s): name for name, forms in SENTENCES.items() for s in forms}
#: The rules in their order, and those of the sentences that are made.
ALL_RULES = [*RULES, *((name, (f"named-{name}",), 0) for name in NAMES)]

# ---- expressions of licence identifiers
_SPDX_LINE = re.compile(r"(?i)^[^a-z0-9]*(?:(?:rem|dnl)\b[^a-z0-9]*)?(?:spdx-license-identifier|licen[sc]e)\s*:\s*(.*)$")
_TOKEN = re.compile(r"[()]|[^\s()]+")
_TAIL = re.compile(r"[\s*/#<>!;,.\-]+$")
#: Identifiers by their lower-case form. The names without "only" or "or later" are the former ones of version numbers alone.
SPDX = {n.lower(): n for n in [*NAMES, *(r[0] for r in RULES if r[0] != "BSD")]}
SPDX |= {n[:-5].lower(): n for n in NAMES if n.endswith("-only")} | {f"{n[:-9]}+".lower(): n for n in NAMES if n.endswith("-or-later")}


def expression(text: str) -> list[str] | None:
    """The licences of an expression with OR, AND, WITH and brackets, in order; null if the text is none.

    Identifiers that aren't known give no licence. An exception stays with its licence; a plus
    means that version or a later one.
    """
    tokens, depth, out, operand = _TOKEN.findall(_TAIL.sub("", text.strip())), 0, [], True
    at = 0
    while at < len(tokens):
        token = tokens[at]
        if token in "()":
            depth += 1 if token == "(" else -1
            if depth < 0 or operand != (token == "("):
                return None
        elif operand:
            if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.\-]*\+?", token) or token.upper() in ("OR", "AND", "WITH"):
                return None
            known = SPDX.get(token.lower()) or (f"{SPDX[token[:-1].lower()]}+" if token.endswith("+") and token[:-1].lower() in SPDX else None)
            if at + 2 < len(tokens) and tokens[at + 1].upper() == "WITH":
                known = known and f"{known} WITH {tokens[at + 2]}"
                at += 2
            out += [known] if known else []
            operand = False
        elif token in ("OR", "AND", "or", "and"):
            operand = True
        else:
            return None
        at += 1
    return None if operand or depth else out


def _expressed(piece: str) -> list[str]:
    """The licences that a piece of text names as an expression: after a label, or alone with an operator in it."""
    labelled = _SPDX_LINE.match(piece)
    first = _FIRST.match(piece)
    bare = piece[first.start(1) :] if first else ""
    body = labelled[1] if labelled else bare if " OR " in bare or " AND " in bare or " WITH " in bare else ""
    return (expression(body) or []) if body else []


#: What known sentences begin with: their first words, and all runs of words from the first.
_BEGINS = {k.split()[0] for k in KNOWN}
_PREFIXES = {" ".join(k.split()[:n]) for k in KNOWN for n in range(1, len(k.split()))}


def pieces(text: str) -> list[tuple[str, int, int, bool]]:
    """(piece, sentence, paragraph, whether a line begins with it) of a text, cut at line ends and after punctuation.

    A line goes on with the sentence of the line before unless that ended with punctuation.
    Lines of comment marks only count as blank; blank lines end sentences and paragraphs.
    """
    out, sentence, paragraph, ended = [], -1, 0, True
    for line in text.splitlines():
        cut = [x for x in _END.split(line) if any(map(str.isalnum, x))]
        if not cut:
            paragraph, ended = paragraph + 1, True
        for n, x in enumerate(cut):
            sentence += ended or n > 0
            out.append((x, sentence, paragraph, n == 0))
            ended = x.rstrip().endswith((".", "!", "?", ";"))
    return out


def recognised(text: str | None) -> list[tuple[int, int, str]]:
    """(first sentence, last sentence, identifier) of the known sentences of a text, in order.

    A known sentence is one piece of the text or several in one paragraph, so it may be
    wrapped over lines, with comment marks, and have a semicolon in it.
    """
    found, at = [], 0
    given = pieces(text or "")
    while at < len(given):
        first, best, end = _FIRST.match(given[at][0]), None, at
        if first and first[1].lower() in _BEGINS:
            have = ""
            for i in range(at, len(given)):
                x, _, paragraph, starts = given[i]
                x = x[m.start(1) :] if starts and (m := _FIRST.match(x)) else x
                have = f"{have} {normalised(x)}".strip()
                if paragraph != given[at][2]:
                    break
                if have in KNOWN:
                    best, end = KNOWN[have], i
                if have not in _PREFIXES:
                    break
        if best:
            found.append((given[at][1], given[end][1], best))
        elif given[at][3]:
            found += [(given[at][1], given[at][1], f"spdx-{x}") for x in _expressed(given[at][0])]
        at = end + 1
    return found


def licences(text: str | None, rules=ALL_RULES) -> list[tuple[str, int, int, list[str]]]:
    """(licence, first sentence, last sentence, identifiers) of the rules that match, in the order of the text."""
    found, out, at = recognised(text), [], 0
    while at < len(found):
        if found[at][2].startswith("spdx-"):  # an identifier names its licence
            first, last, x = found[at]
            out.append((x.removeprefix("spdx-"), first, last, [x]))
            at += 1
            continue
        for name, wanted, gap in rules:
            part = found[at : at + len(wanted)]
            if tuple(x for _, _, x in part) == wanted and all(b[0] - a[1] <= gap + 1 for a, b in zip(part, part[1:])):
                out.append((name, part[0][0], part[-1][1], [x for _, _, x in part]))
                at += len(wanted)
                break
        else:
            at += 1
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_match, licence, first_sentence, last_sentence, sentences): one row for each match in a text.

    Null and empty texts have no match and give no row; rows that repeat a document give
    repeated rows, rows without id rows without id, an empty table none. Other columns aren't
    read, whatever their names. Whole texts are read; a task holds one batch of them.
    """
    schema = "id long, n_match int, licence string, first_sentence int, last_sentence int, sentences array<string>"
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))
    names = ["id", "n_match", "licence", "first_sentence", "last_sentence", "sentences"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i.as_py(), n, *m) for i, t in zip(batch.column(0), batch.column(1)) for n, m in enumerate(licences(t.as_py()))]
            columns = list(zip(*found)) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, schema).withColumnRenamed("id", id_col)
