"""The signature rules of the license scan: hand-written wordings of each license, SPDX identifiers, and names in their contexts.

All patterns are over normalised text: words in lower case, joined by single spaces; ``v2.0`` is ``v2 0`` there.
"""

from __future__ import annotations

from typing import NamedTuple

# Rank, confidence, and for each wording: label, a keyword that every match holds, the wording. Texts of the
# licenses themselves and of their notices come first, then exceptions and dedications, then hints.
WORDINGS = {
    (0, 1.0): """
mit | hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy
mit | this permission notice | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies
mit | without restriction including | to deal in the software without restriction including without limitation the rights to use copy
isc | distribute this software for any purpose | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
0bsd | distribute this software for any purpose | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software
bsd | source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions of source code | redistributions of source code must retain the above copyright notice
bsd | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | nor the names of its contributors | neither the name of (?:\\S+ ){1,12}nor the names of its contributors may be used to endorse
bsd-4-clause | all advertising materials | all advertising materials mentioning features or use of this software must display
apache | licensed under the apache license | licensed under the apache license version 2 0 the license
apache | except in compliance with the license | you may not use this (?:file|work|software) except in compliance with the license
apache | unless required by applicable law | unless required by applicable law or agreed to in writing software distributed under the license
apache | specific language governing permissions | see the license for the specific language governing permissions and limitations
apache | apache software foundation | licensed to the apache software foundation asf under one or more contributor license agreements
apache | apache org licenses license 2 0 | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
gpl | this program is free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | copy of the gnu general public license | you should have received a copy of the gnu general public license along with
gpl | permitted to copy and distribute verbatim | everyone is permitted to copy and distribute verbatim copies of this license document
gpl | gnu general public license as published | gnu general public license as published by the free software foundation(?: inc)? either version [123](?: of the license)? or at your option any later version
gpl | in the hope that it will be useful | this (?:program|software|file) is distributed in the hope that it will be useful but without any warranty
gpl | gnu org licenses gpl | (?:www )?gnu org licenses gpl(?: [123] 0)?(?: html| txt)?
lgpl | this library is free software | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | lesser general public license along | copy of the gnu lesser general public license along with
lgpl | library general public license | gnu library general public license
lgpl | gnu org licenses lgpl | (?:www )?gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?
agpl | affero general public license as published | gnu affero general public license as published by the free software foundation
agpl | gnu org licenses agpl | (?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?
fdl | copy distribute and or modify this document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
fdl | no front cover texts | with no invariant sections no front cover texts and no back cover texts
mpl | source code form is subject | this source code form is subject to the terms of the mozilla public license
mpl | copy of the mpl was not distributed | if a copy of the mpl was not distributed with this file you can obtain one at
mpl | contents of this file are subject to the mozilla | the contents of this file are subject to the mozilla public license
mpl | mozilla org mpl | (?:www )?mozilla org mpl(?: [12] [01])?
epl | accompanying materials are made available | this program and the accompanying materials are made available under the terms of the eclipse public license
epl | eclipse org legal epl | (?:www )?eclipse org legal epl(?: v10| 2 0)?
cddl | terms of the common development | the contents of this file are subject to the terms of the common development and distribution license
eupl | licensed under the eupl | licensed under the eupl(?: version 1 [012])?
unlicense | free and unencumbered software | this is free and unencumbered software released into the public domain
unlicense | unlicense org | (?:https? )?unlicense org
wtfpl | what the fuck you want | do what the fuck you want to public license
zlib | altered source versions | altered source versions must be plainly marked as such
zlib | authors be held liable | in no event will the authors be held liable for any damages arising from the use of this software
boost | obtaining a copy of the software and accompanying | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
boost | boost org license 1 0 | (?:www )?boost org license 1 0(?: txt)?
psf | between the python software foundation | this license agreement is between the python software foundation
ofl | reserved font name | with reserved font name
ofl | scripts sil org ofl | scripts sil org ofl
artistic | standard version refers | standard version refers to such a package if it has not been modified
php | this product includes php | this product includes php software freely available from
openssl | openssl project for use | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | cryptographic software written by | this product includes cryptographic software written by eric young
ncsa | ncsa open source license | (?:university of illinois )?ncsa open source license
json | used for good not evil | the software shall be used for good not evil
beerware | whatever you want with this stuff | as long as you retain this notice you can do whatever you want with this stuff
libpng | png reference library | the png reference library is supplied as is
curl | curl license | copyright (?:\\S+ ){0,12}curl license
imagemagick | imagemagick license | licensed under the imagemagick license
vim | vim is charityware | vim is charityware
perl | same terms as perl itself | under the same terms as perl itself
ruby | same terms as ruby | under the same terms as ruby(?: itself)?
cecill | governed by the cecill | this software is governed by the cecill(?: [bc])? license
cc-by | creativecommons org licenses by | creativecommons org licenses by [1234] [05]
cc-by-sa | creativecommons org licenses by sa | creativecommons org licenses by sa [1234] [05]
cc-by-nc | creativecommons org licenses by nc | creativecommons org licenses by nc [1234] [05]
cc-by-nd | creativecommons org licenses by nd | creativecommons org licenses by nd [1234] [05]
cc-by-nc-sa | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd [1234] [05]
cc0 | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0
cc0 | to the extent possible under law | to the extent possible under law (?:\\S+ ){1,12}(?:has|have) waived all copyright
cc-by | you are free to share and adapt | you are free to share and adapt the material for any purpose even commercially under the following terms attribution
odc-by | open data commons attribution | open data commons attribution license(?: v?1 0)?
odbl | opendatacommons org licenses odbl | opendatacommons org licenses odbl(?: 1 0)?
cdla | community data license agreement | community data license agreement (?:permissive|sharing)(?: version)?(?: [12] 0)?
sspl | server side public license | server side public license(?: version 1)?
elastic | elastic license | licensed under the elastic license(?: 2 0)?
busl | business source license | business source license(?: version)?(?: 1 1)?
commons-clause | commons clause license condition | commons clause license condition(?: v1 0)?
polyform | polyform noncommercial | polyform noncommercial license(?: 1 0 0)?
openrail | openrail | (?:bigscience |creativeml )?openrail(?: ?[ms]{1,2})?(?: license)?
rail | responsible ai | responsible ai licenses?
llama | community license agreement | llama(?: [234](?: [0-9])?)? community license agreement
gemma | gemma terms of use | gemma terms of use
ogl | open government licence | (?:under the )?open government licence(?: v?[123](?: 0)?)?
etalab | licence ouverte | licence ouverte(?: open licence)?(?: etalab)?
dl-de | datenlizenz deutschland | datenlizenz deutschland(?: namensnennung| zero)(?: version)?(?: [12] 0)?
""",
    (1, 0.9): """
gpl | at your option any later version | either version [123](?: of the license)? or at your option any later version
gpl-exception | classpath exception | (?:with (?:the )?)?classpath exception(?: 2 0)?
gpl-exception | gcc runtime library exception | gcc runtime library exception(?: version)?(?: 3 1)?
gpl-exception | linux syscall note | linux syscall note
gpl-exception | autoconf exception | autoconf exception
gpl-exception | bison exception | bison exception
gpl-exception | font embedding exception | font embedding exception
gpl-exception | font exception | font exception
gpl-exception | openssl exception | openssl exception
gpl-exception | as a special exception | as a special exception (?:to the gnu general public license|the copyright holders|you may)
apache-exception | llvm | (?:with )?llvm exceptions?
gpl | published by the free software foundation | as published by the free software foundation
agpl | interacting with it remotely | (?:all )?users interacting with it remotely through a computer network
bsd | provided by the copyright holders and contributors | this software is provided by the copyright holders and contributors as is
mit | without warranty of any kind express or implied | the software is provided as is without warranty of any kind express or implied
public-domain | released into the public domain | released into the public domain
public-domain | waive all copyright | waive all copyright and related or neighboring rights
public-domain | of the united states government | (?:is a|are) works? of the united states government
public-domain | not subject to copyright protection | (?:is|are) not subject to copyright protection
cc-by | creative commons namensnennung | creative commons namensnennung(?: [1234] [05])?
cc-by-sa | namensnennung weitergabe | (?:creative commons )?namensnennung weitergabe unter gleichen bedingungen
cc-by | creative commons reconocimiento | creative commons reconocimiento(?: [1234] [05])?
cc-by-sa | reconocimiento compartirigual | (?:creative commons )?reconocimiento compartirigual
cc-by | creative commons paternité | creative commons paternité
cc-by-sa | attribution partage dans les mêmes conditions | attribution partage dans les mêmes conditions
gpl | allgemeine öffentliche gnu lizenz | allgemeine öffentliche gnu lizenz
gpl | licencia pública general | licencia pública general(?: de)? gnu
gpl | licence publique générale | licence publique générale gnu
dual | dual licensed | dual licensed under
perl | gpl or the artistic | under (?:either )?the (?:terms of the )?gpl or the artistic license
commercial | commercial license | (?:requires|under) a commercial license
proprietary | confidential and proprietary | confidential and proprietary
proprietary | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
proprietary | without the prior written permission | without the prior written permission of
proprietary | end user license agreement | end user license agreement
""",
    (3, 0.6): """
gpl | gplv1 | gplv1
gpl | gplv2 | gplv2(?: or later)?
gpl | gplv3 | gplv3(?: or later)?
lgpl | lgplv2 | lgplv2(?: 1)?(?: or later)?
lgpl | lgplv3 | lgplv3(?: or later)?
agpl | agplv3 | agplv3(?: or later)?
gpl | gnu gpl | gnu gpl
lgpl | gnu lgpl | gnu lgpl
agpl | gnu agpl | gnu agpl
apache | asl 2 0 | asl 2 0
apache | apache 2 0 | apache 2 0
cc-by | cc attribution | cc attribution
cc-by-sa | ccbysa | ccbysa
proprietary | alle rechte vorbehalten | alle rechte vorbehalten
proprietary | tous droits réservés | tous droits réservés
proprietary | todos los derechos reservados | todos los derechos reservados
copyleft | copyleft | copyleft
""",
}

# Label and the SPDX identifiers that tell it, as they stand in normalised text.
SPDX = """
mit: mit|mit 0|mit cmu|mit modern variant
apache: apache 1 0|apache 1 1|apache 2 0
bsd: bsd 1 clause|bsd 2 clause|bsd 2 clause patent|bsd source code|0bsd
bsd-3-clause: bsd 3 clause|bsd 3 clause clear|bsd 3 clause lbnl
bsd-4-clause: bsd 4 clause|bsd 4 clause uc
gpl: gpl 1 0|gpl 2 0|gpl 3 0
lgpl: lgpl 2 0|lgpl 2 1|lgpl 3 0|lgpllr
agpl: agpl 1 0|agpl 3 0
fdl: gfdl 1 1|gfdl 1 2|gfdl 1 3
mpl: mpl 1 0|mpl 1 1|mpl 2 0
epl: epl 1 0|epl 2 0
cddl: cddl 1 0|cddl 1 1
eupl: eupl 1 0|eupl 1 1|eupl 1 2
isc: isc
zlib: zlib|zlib acknowledgement
boost: bsl 1 0
unlicense: unlicense
wtfpl: wtfpl
psf: psf 2 0|python 2 0
php: php 3 0|php 3 01
ofl: ofl 1 0|ofl 1 1
artistic: artistic 1 0|artistic 2 0
ms-pl: ms pl|ms rl
cc0: cc0 1 0
cc-by: cc by 1 0|cc by 2 0|cc by 2 5|cc by 3 0|cc by 4 0
cc-by-sa: cc by sa 1 0|cc by sa 2 0|cc by sa 2 5|cc by sa 3 0|cc by sa 4 0
cc-by-nc: cc by nc 2 0|cc by nc 3 0|cc by nc 4 0
cc-by-nd: cc by nd 2 0|cc by nd 3 0|cc by nd 4 0
cc-by-nc-sa: cc by nc sa 2 0|cc by nc sa 3 0|cc by nc sa 4 0
cc-by-nc-nd: cc by nc nd 2 0|cc by nc nd 3 0|cc by nc nd 4 0
odbl: odbl 1 0
pddl: pddl 1 0
sspl: sspl 1 0
busl: busl 1 1
ncsa: ncsa
curl: curl
openssl: openssl
ruby: ruby
vim: vim
x11: x11
beerware: beerware
json: json
"""

# Label, keyword, pattern of the name, pattern of the versions ("" where the license has none).
FAMILIES = (
    ("gpl", "gpl", "gpl", "[123](?: 0)?"),
    ("gpl", "general public", "(?:gnu )?general public licen[sc]e", "[123](?: 0)?"),
    ("lgpl", "lgpl", "lgpl", "[23](?: [01])?"),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public licen[sc]e", "[23](?: [01])?"),
    ("agpl", "agpl", "agpl", "[13](?: 0)?"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e", "[13](?: 0)?"),
    ("fdl", "free documentation", "(?:gnu )?free documentation licen[sc]e", "1 [123]"),
    ("apache", "apache", "apache(?: software)?(?: licen[sc]e)?", "[12](?: [01])?"),
    ("mit", "mit", "mit(?: licen[sc]e)?", ""),
    ("mit", "expat", "expat(?: licen[sc]e)?", ""),
    ("x11", "x11", "x11(?: licen[sc]e)?", ""),
    ("bsd", "bsd", "(?:[234] clause |simplified |new |revised |modified )?bsd(?: [234] clause)?(?: licen[sc]e)?", ""),
    ("isc", "isc", "isc licen[sc]e", ""),
    ("mpl", "mozilla public", "mozilla public licen[sc]e", "[12] [01]"),
    ("mpl", "mpl", "mpl", "[12] [01]"),
    ("epl", "eclipse public", "eclipse public licen[sc]e", "[12] 0"),
    ("cddl", "common development", "common development and distribution licen[sc]e", "1 [01]"),
    ("eupl", "european union public", "european union public licen[sc]e", "1 [012]"),
    ("artistic", "artistic", "(?:clarified )?artistic licen[sc]e", "[12] 0"),
    ("zlib", "zlib", "zlib(?: libpng)?(?: licen[sc]e)?", ""),
    ("boost", "boost software", "boost software licen[sc]e", "1 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", ""),
    ("wtfpl", "wtfpl", "wtfpl", "[12]"),
    ("psf", "python software foundation", "python software foundation licen[sc]e", "2"),
    ("php", "php", "php licen[sc]e", "3 0[01]?"),
    ("ofl", "open font", "(?:sil )?open font licen[sc]e", "1 [01]"),
    ("ms-pl", "microsoft public", "microsoft public licen[sc]e", ""),
    ("odbl", "open database", "open database licen[sc]e", "1 0"),
    ("pddl", "public domain dedication", "(?:open data commons )?public domain dedication(?: and)? licen[sc]e", "1 0"),
    ("cc0", "cc0", "cc0", "1 0"),
    ("public-domain", "public domain", "(?:the )?public domain", ""),
    ("cc-by", "cc by", "cc by", "[1234] [05]"),
    ("cc-by-sa", "cc by sa", "cc by sa", "[1234] [05]"),
    ("cc-by-nd", "cc by nd", "cc by nd", "[1234] [05]"),
    ("cc-by-nc", "cc by nc", "cc by nc", "[1234] [05]"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa", "[1234] [05]"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd", "[1234] [05]"),
    ("cc-by", "creative commons attribution", "creative commons attribution", "[1234] [05]"),
    ("cc-by-sa", "creative commons attribution", "creative commons attribution share ?alike", "[1234] [05]"),
    ("cc-by-nc", "creative commons attribution", "creative commons attribution non ?commercial", "[1234] [05]"),
    ("cc-by-nd", "creative commons attribution", "creative commons attribution no ?deriv(?:ative)?s", "[1234] [05]"),
    ("proprietary", "all rights reserved", "all rights reserved", ""),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", ""),
)

# Rank (0 is the highest), confidence, and what stands around a name. V stands for the version part.
TEMPLATES = (
    (0, 1.0, "(?:licen[sc]ed|released|distributed|published|available|redistributed)(?: to you)? under(?: the)?(?: terms of)?(?: the)? NAME(?: licen[sc]e)?(?: version| v)?(?: V)?(?: international)?"),
    (1, 0.9, "(?:subject to|governed by|covered by|see|under)(?: the)?(?: terms of)?(?: the)? NAME(?: licen[sc]e)?(?: version| v)?(?: V)?"),
    (1, 0.9, "(?:dedicated to|placed in|in) NAME"),
    (2, 0.8, "NAME(?: licen[sc]e)?(?: version| v)? V"),
    (3, 0.6, "NAME licen[sc]e"),
    (4, 0.5, "NAME"),
)
# Names that are words or projects too, so that they count only beside a licence word; and their keywords.
ORDINARY, ORDINARY_WORDS = ("mit", "apache", "x11", "zlib", "public-domain"), ("mit", "apache", "x11", "zlib", "php", "artistic", "expat", "isc")
# Licence words, one of which a text needs where only ordinary names stand in it.
TRIGGERS = ("license", "licence", "licensed", "licenced", "licenses", "licences", "released under", "distributed under", "published under", "available under", "redistributed under", "released to you", "distributed to you", "published to you", "available to you", "redistributed to you")
LEVELS = 1 + max(t[0] for t in TEMPLATES)


class Rule(NamedTuple):
    """Rank (0 is the highest), confidence, label, keyword that every match holds as whole words, and the pattern."""

    rank: int
    confidence: float
    label: str
    keyword: str
    pattern: str


def _bounded(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def rules() -> list[Rule]:
    """All rules: wordings, SPDX identifiers, and each family in each context that suits it."""
    out = []
    for (rank, confidence), lines in WORDINGS.items():
        for line in lines.strip().split("\n"):
            label, keyword, pattern = (x.strip() for x in line.split(" | "))
            out.append(Rule(rank, confidence, label, keyword, _bounded(pattern.replace("\\\\", "\\"))))
    for line in SPDX.strip().split("\n"):
        label, ids = line.split(": ")
        out += [Rule(0, 1.0, label, "spdx license identifier", _bounded(f"spdx license identifier (?:(?:(?!(?:and|or) )\\S+ ){{1,6}}(?:and|or) ){{0,3}}{x}(?: only| or later)?")) for x in ids.split("|")]
    for label, keyword, name, versions in FAMILIES:
        for rank, confidence, template in TEMPLATES:
            dedication, versioned = "dedicated" in template, template.endswith(" V")
            if dedication and label != "public-domain" or versioned and not versions or rank == 4 and label in ORDINARY:
                continue
            if rank in (1, 2) and keyword in ORDINARY_WORDS:  # "see mit" may be German, "apache 2 4" a server
                template = template.replace("NAME(?: licen[sc]e)?", "NAME licen[sc]e")
            body = template.replace("NAME", f"(?:{name})")
            body = body.replace("(?: V)?", f"(?: (?:{versions}))?" if versions else "").replace(" V", f" (?:{versions})")
            out.append(Rule(rank, confidence, label, keyword, _bounded(body)))
    return out


def gate(phrases: list[str], between: str) -> str:
    """One regular expression over raw text that finds any of the phrases as whole words: a tree of their letters.

    ``between``: the class of separators, as it stands in brackets.
    """
    tree: dict = {}
    for phrase in phrases:
        at = tree
        for c in phrase:
            at = at.setdefault(c, {})
        at[""] = {}

    def branch(at: dict) -> str:
        # where a phrase ends, a longer one that goes on with another word adds nothing
        arms = [f"(?![^{between}])"] if "" in at else []
        arms += [(f"[{between}]+" if c == " " else c) + branch(rest) for c, rest in sorted(at.items()) if c and not (c == " " and "" in at)]
        return arms[0] if len(arms) == 1 else f"(?:{'|'.join(arms)})"

    return f"(?i)(?<![^{between}]){branch(tree)}"
