"""Signature rules of the licence scanner: rules written one by one, SPDX tags, addresses, short names, and families of
names with sentence shapes.

Patterns are written for lower-cased text and use a blank for any run of separators between words. A rule with a keyword
runs only on texts that hold the keyword.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Label, names in running text, keyword that each name holds.
FAMILIES: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("agpl", ("gnu affero general public license", "affero general public license", "agpl"), "a"),
    ("apache", ("apache license", "apache software license"), "apache"),
    ("artistic", ("artistic license", "perl artistic license"), "artistic"),
    ("blue-oak", ("blue oak model license",), "blue oak"),
    ("boost", ("boost software license",), "boost"),
    ("bsd", ("bsd license", "bsd 2 clause license", "bsd 3 clause license", "bsd 4 clause license", "new bsd license", "simplified bsd license"), "bsd"),
    ("cc-by", ("creative commons attribution", "cc by"), "c"),
    ("cc-by-nc", ("creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc"), "nc"),
    ("cc-by-nc-nd", ("creative commons attribution noncommercial noderivatives", "cc by nc nd"), "nd"),
    ("cc-by-nc-sa", ("creative commons attribution noncommercial sharealike", "cc by nc sa"), "sa"),
    ("cc-by-nd", ("creative commons attribution noderivatives", "cc by nd"), "nd"),
    ("cc-by-sa", ("creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"), "sa"),
    ("cc0", ("creative commons zero", "cc0"), "c"),
    ("cddl", ("common development and distribution license", "cddl"), "d"),
    ("cecill", ("cecill license", "cecill"), "cecill"),
    ("cpl", ("common public license",), "common public"),
    ("ecl", ("educational community license",), "educational"),
    ("epl", ("eclipse public license",), "eclipse"),
    ("eupl", ("european union public licence", "european union public license", "eupl"), "eu"),
    ("fdl", ("gnu free documentation license", "gfdl"), "f"),
    ("gpl", ("gnu general public license", "gnu gpl", "gpl"), "g"),
    ("isc", ("isc license",), "isc"),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "lesser general public license", "lgpl"), "l"),
    ("lppl", ("latex project public license",), "latex"),
    ("mit", ("mit license", "expat license", "x11 license"), "license"),
    ("mpl", ("mozilla public license",), "mozilla"),
    ("ms-pl", ("microsoft public license",), "microsoft"),
    ("ms-rl", ("microsoft reciprocal license",), "microsoft"),
    ("ncsa", ("university of illinois ncsa open source license", "ncsa open source license"), "ncsa"),
    ("odbl", ("open database license", "odbl"), "od"),
    ("odc-by", ("open data commons attribution license",), "open data"),
    ("ofl", ("sil open font license", "open font license"), "open font"),
    ("osl", ("open software license",), "open software"),
    ("pddl", ("public domain dedication and license",), "public domain"),
    ("php", ("php license",), "php"),
    ("postgresql", ("postgresql license",), "postgresql"),
    ("psf", ("python software foundation license", "psf license"), "license"),
    ("ruby", ("ruby license",), "ruby"),
    ("unlicense", ("the unlicense", "unlicense"), "unlicense"),
    ("vim", ("vim license",), "vim"),
    ("wtfpl", ("do what the fuck you want to public license", "wtfpl"), "w"),
    ("zlib", ("zlib license", "zlib libpng license"), "zlib"),
    ("zpl", ("zope public license",), "zope"),
)

# Shape, priority, keyword. NAME stands for a family's name, VERSION for an optional version after it.
SHAPES: tuple[tuple[str, int, str], ...] = (
    ("spdx license identifier NAME VERSION", 100, "spdx"),
    ("licensed under (?:the )?(?:terms of (?:the )?)?NAME VERSION", 90, "licensed"),
    ("(?:released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?NAME VERSION", 85, "under"),
    ("under the terms (?:and conditions )?of the NAME VERSION", 80, "terms"),
    ("subject to the (?:terms of the )?NAME VERSION", 75, "subject"),
    ("NAME VERSION", 50, ""),
)

# SPDX identifiers in words, by label; rules are made for a tag and for the further terms of its expression.
SPDX: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("0bsd", ("0bsd",)),
    ("afl", ("afl 2 1", "afl 3 0")),
    ("agpl", ("agpl 1 0", "agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later")),
    ("apache", ("apache 1 0", "apache 1 1", "apache 2 0")),
    ("apsl", ("apsl 1 0", "apsl 2 0")),
    ("artistic", ("artistic 1 0", "artistic 1 0 perl", "artistic 2 0")),
    ("beerware", ("beerware",)),
    ("blue-oak", ("blueoak 1 0 0",)),
    ("boost", ("bsl 1 0",)),
    ("bsd", ("bsd 1 clause", "bsd 2 clause", "bsd 2 clause patent", "bsd 2 clause views", "bsd 3 clause", "bsd 3 clause clear", "bsd 3 clause lbnl", "bsd 4 clause", "bsd source code")),
    ("busl", ("busl 1 1",)),
    ("cc-by", ("cc by 1 0", "cc by 2 0", "cc by 2 5", "cc by 3 0", "cc by 4 0")),
    ("cc-by-nc", ("cc by nc 2 0", "cc by nc 3 0", "cc by nc 4 0")),
    ("cc-by-nc-nd", ("cc by nc nd 3 0", "cc by nc nd 4 0")),
    ("cc-by-nc-sa", ("cc by nc sa 3 0", "cc by nc sa 4 0")),
    ("cc-by-nd", ("cc by nd 3 0", "cc by nd 4 0")),
    ("cc-by-sa", ("cc by sa 2 0", "cc by sa 3 0", "cc by sa 4 0")),
    ("cc0", ("cc0 1 0",)),
    ("cddl", ("cddl 1 0", "cddl 1 1")),
    ("cecill", ("cecill 2 0", "cecill 2 1", "cecill b", "cecill c")),
    ("cpl", ("cpl 1 0",)),
    ("ecl", ("ecl 1 0", "ecl 2 0")),
    ("elastic", ("elastic 2 0",)),
    ("epl", ("epl 1 0", "epl 2 0")),
    ("eupl", ("eupl 1 1", "eupl 1 2")),
    ("fdl", ("gfdl 1 1", "gfdl 1 2", "gfdl 1 3", "gfdl 1 3 or later")),
    ("ftl", ("ftl",)),
    ("gpl", ("gpl 1 0", "gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later")),
    ("hpnd", ("hpnd",)),
    ("icu", ("icu",)),
    ("ijg", ("ijg",)),
    ("ipl", ("ipl 1 0",)),
    ("isc", ("isc",)),
    ("json", ("json",)),
    ("lgpl", ("lgpl 2 0", "lgpl 2 0 or later", "lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later")),
    ("lppl", ("lppl 1 3a", "lppl 1 3c")),
    ("mit", ("mit", "mit 0", "mit modern variant", "x11")),
    ("mpl", ("mpl 1 0", "mpl 1 1", "mpl 2 0", "mpl 2 0 no copyleft exception")),
    ("ms-pl", ("ms pl",)),
    ("ms-rl", ("ms rl",)),
    ("mulan", ("mulanpsl 1 0", "mulanpsl 2 0")),
    ("ncsa", ("ncsa",)),
    ("odbl", ("odbl 1 0",)),
    ("odc-by", ("odc by 1 0",)),
    ("ofl", ("ofl 1 0", "ofl 1 1")),
    ("openssl", ("openssl",)),
    ("osl", ("osl 2 1", "osl 3 0")),
    ("pddl", ("pddl 1 0",)),
    ("php", ("php 3 0", "php 3 01")),
    ("postgresql", ("postgresql",)),
    ("psf", ("psf 2 0", "python 2 0")),
    ("qpl", ("qpl 1 0",)),
    ("ruby", ("ruby",)),
    ("sspl", ("sspl 1 0",)),
    ("unlicense", ("unlicense",)),
    ("upl", ("upl 1 0",)),
    ("vim", ("vim",)),
    ("w3c", ("w3c",)),
    ("wtfpl", ("wtfpl",)),
    ("zlib", ("zlib", "libpng 2 0", "zlib acknowledgement")),
    ("zpl", ("zpl 2 0", "zpl 2 1")),
)

# How licences are called in short, by label; a rule is made for each after "licensed under" and its like.
SHORT: tuple[tuple[str, str], ...] = (
    ("agpl", "(?:gnu )?agpl"), ("apache", "apache"), ("apache", "asl"), ("artistic", "artistic"), ("boost", "boost"), ("boost", "bsl"),
    ("bsd", "(?:new |modified |simplified |revised )?bsd"), ("bsd", "(?:two|three|2|3|4) clause bsd"), ("busl", "business source"), ("cc-by", "creative commons"),
    ("cc0", "cc0"), ("cc0", "cc zero"), ("cddl", "cddl"), ("cpl", "cpl"), ("ecl", "ecl"), ("elastic", "elastic"), ("epl", "epl"), ("eupl", "eupl"),
    ("fdl", "gfdl"), ("fdl", "gnu fdl"), ("gpl", "(?:gnu )?gplv?[123]"), ("gpl", "(?:gnu )?gpl"), ("isc", "isc"), ("lgpl", "(?:gnu )?lgplv?[23]?"), ("mit", "mit"), ("mit", "expat"),
    ("mit", "mit x11"), ("mpl", "mpl"), ("ms-pl", "ms pl"), ("mulan", "mulan psl"), ("ncsa", "ncsa"), ("odbl", "odbl"), ("ofl", "(?:sil )?ofl"), ("osl", "osl"), ("php", "php"),
    ("postgresql", "postgresql"), ("psf", "psf"), ("ruby", "ruby"), ("sspl", "sspl"), ("unlicense", "unlicense"), ("upl", "upl"), ("wtfpl", "wtfpl"), ("zlib", "zlib"), ("zpl", "zpl"),
)

# Addresses of licence texts in words, by label, and the keyword that each holds.
URLS: tuple[tuple[str, str, str], ...] = (
    ("agpl", "gnu org licenses agpl", "gnu"), ("apache", "apache org licenses", "apache"), ("artistic", "opensource org licenses? artistic", "opensource"),
    ("artistic", "perlfoundation org artistic license", "perlfoundation"), ("blue-oak", "blueoakcouncil org license", "blueoakcouncil"), ("boost", "boost org license", "boost"),
    ("boost", "opensource org licenses? bsl 1 0", "opensource"), ("bsd", "opensource org licenses? bsd", "opensource"), ("bsd", "freebsd org copyright", "freebsd"),
    ("busl", "mariadb com bsl11", "mariadb"), ("cc-by", "creativecommons org licenses by", "creativecommons"), ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "creativecommons"), ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "creativecommons"),
    ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons"), ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons"),
    ("cc0", "creativecommons org publicdomain zero", "creativecommons"), ("cddl", "opensource org licenses? cddl", "opensource"), ("cecill", "cecill info licences", "cecill"),
    ("epl", "eclipse org legal epl", "eclipse"), ("epl", "opensource org licenses? epl", "opensource"), ("eupl", "joinup ec europa eu (?:[a-z0-9]+ ){0,4}eupl", "joinup"),
    ("fdl", "gnu org licenses fdl", "gnu"), ("fdl", "gnu org copyleft fdl", "gnu"), ("gpl", "gnu org licenses gpl", "gnu"), ("gpl", "gnu org licenses old licenses gpl", "gnu"),
    ("gpl", "gnu org copyleft gpl", "gnu"), ("gpl", "opensource org licenses? gpl", "opensource"), ("isc", "opensource org licenses? isc", "opensource"), ("isc", "isc org licenses", "isc"),
    ("json", "json org license", "json"), ("lgpl", "gnu org licenses lgpl", "gnu"), ("lgpl", "gnu org copyleft lesser", "gnu"), ("lgpl", "gnu org licenses old licenses lgpl", "gnu"),
    ("lgpl", "opensource org licenses? lgpl", "opensource"), ("lppl", "latex project org lppl", "latex"), ("mit", "opensource org licenses? mit", "opensource"),
    ("mit", "mit license org", "license"), ("mit", "choosealicense com licenses mit", "choosealicense"), ("mpl", "mozilla org mpl", "mozilla"), ("mpl", "mozilla org (?:en us )?mpl", "mozilla"),
    ("mpl", "opensource org licenses? mpl", "opensource"), ("ms-pl", "opensource org licenses? ms pl", "opensource"), ("odbl", "opendatacommons org licenses odbl", "opendatacommons"),
    ("odc-by", "opendatacommons org licenses by", "opendatacommons"), ("ofl", "scripts sil org ofl", "sil"), ("ofl", "openfontlicense org", "openfontlicense"),
    ("osl", "opensource org licenses? osl", "opensource"), ("pddl", "opendatacommons org licenses pddl", "opendatacommons"), ("php", "php net license", "php"),
    ("psf", "docs python org (?:[0-9]+ )?license", "python"), ("sspl", "mongodb com licensing server side public license", "mongodb"), ("unlicense", "unlicense org", "unlicense"),
    ("upl", "opensource org licenses? upl", "opensource"), ("w3c", "w3 org consortium legal", "consortium"), ("wtfpl", "wtfpl net", "wtfpl"), ("zlib", "zlib net zlib license", "zlib"),
    ("zlib", "opensource org licenses? zlib", "opensource"),
)

# Rules of their own: label, pattern, priority, keyword. Grants, conditions, headers, notices.
SINGLE: tuple[tuple[str, str, int, str], ...] = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 95, "hereby granted"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", 92, "permission notice"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim", 88, "holders"),
    ("mit", "use of this source code is governed by an mit style licen[cs]e", 93, "governed"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy", 95, "organization"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 95, "redistribution"),
    ("bsd", "redistributions of source code must retain the above copyright notice", 92, "redistributions"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", 92, "redistributions"),
    ("bsd", "neither the name of (?:the )?(?:[a-z0-9]+ ){1,12}nor the names of (?:its|their|any) contributors", 92, "contributors"),
    ("bsd", "all advertising materials mentioning features or use of this software", 92, "advertising"),
    ("bsd", "use of this source code is governed by a bsd style licen[cs]e", 93, "governed"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 95, "permission to use"),
    ("isc", "permission to use copy modify and distribute this software for any purpose", 94, "permission to use"),
    ("hpnd", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose", 95, "documentation"),
    ("apache", "licensed to the apache software foundation", 95, "apache"),
    ("apache", "you may not use this file except in compliance with the license", 90, "compliance"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license", 90, "applicable"),
    ("apache", "terms and conditions for use reproduction and distribution", 85, "reproduction"),
    ("gpl", "this program is free software you can redistribute it and or modify it", 70, "free software"),
    ("gpl", "you should have received a copy of the gnu general public licen[cs]e", 92, "received"),
    ("gpl", "this program is distributed in the hope that it will be useful", 72, "hope"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies", 70, "verbatim"),
    ("gpl", "with the (?:gnu )?(?:classpath|autoconf|bison|gcc runtime library) exception", 74, "exception"),
    ("lgpl", "this library is free software you can redistribute it and or modify it", 72, "free software"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", 94, "received"),
    ("agpl", "you should have received a copy of the gnu affero general public licen[cs]e", 94, "received"),
    ("agpl", "remote network interaction use with", 72, "interaction"),
    ("fdl", "with no invariant sections", 80, "invariant"),
    ("mpl", "this source code form is subject to the terms of the mozilla public licen[cs]e", 95, "mozilla"),
    ("mpl", "the contents of this file are subject to the mozilla public licen[cs]e", 95, "mozilla"),
    ("mpl", "incompatible with secondary licenses", 80, "secondary"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 95, "development"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", 95, "eclipse"),
    ("cpl", "accompanying materials are made available under the terms of the common public licen[cs]e", 95, "accompanying"),
    ("eupl", "licensed under the eupl", 95, "eupl"),
    ("zlib", "altered source versions must be plainly marked as such", 94, "plainly"),
    ("zlib", "this software is provided as is without any express or implied warranty", 60, "warranty"),
    ("zlib", "the origin of this software must not be misrepresented", 94, "misrepresented"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", 95, "retain"),
    ("json", "the software shall be used for good not evil", 95, "evil"),
    ("openssl", "this product includes software developed by the openssl project", 95, "openssl"),
    ("ijg", "this software is based in part on the work of the independent jpeg group", 95, "jpeg"),
    ("ftl", "portions of this software are copyright (?:[a-z0-9]+ ){0,4}the freetype project", 95, "freetype"),
    ("artistic", "the artistic licen[cs]e preamble", 90, "artistic"),
    ("ofl", "reserved font names?", 80, "font"),
    ("ofl", "this font software is licensed under the sil open font licen[cs]e", 95, "font"),
    ("wtfpl", "you just do what the fuck you want to", 95, "fuck"),
    ("unlicense", "free and unencumbered software released into the public domain", 95, "unencumbered"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", 94, "publish"),
    ("cc0", "has waived all copyright and related or neighboring rights", 94, "neighboring"),
    ("cc0", "no rights reserved", 60, "reserved"),
    ("cc-by", "attribution (?:[0-9] [0-9] )?(?:international|unported|generic)", 70, "attribution"),
    ("cc-by-sa", "attribution share ?alike (?:[0-9] [0-9] )?(?:international|unported|generic)", 74, "attribution"),
    ("cc-by-nc", "attribution non ?commercial (?:[0-9] [0-9] )?(?:international|unported|generic)", 74, "attribution"),
    ("cc-by-nd", "attribution no ?deriv(?:ative)?s (?:[0-9] [0-9] )?(?:international|unported|generic)", 74, "attribution"),
    ("cc-by-nc-sa", "attribution non ?commercial share ?alike (?:[0-9] [0-9] )?(?:international|unported|generic)", 76, "attribution"),
    ("busl", "business source licen[cs]e", 80, "business"),
    ("busl", "additional use grant", 60, "additional"),
    ("sspl", "server side public licen[cs]e", 80, "server"),
    ("elastic", "elastic licen[cs]e", 70, "elastic"),
    ("commons-clause", "commons clause", 70, "commons"),
    ("polyform", "polyform (?:noncommercial|small business|shield|perimeter|strict) licen[cs]e", 80, "polyform"),
    ("mulan", "mulan permissive software licen[cs]e", 80, "mulan"),
    ("upl", "universal permissive licen[cs]e", 80, "universal"),
    ("rail", "(?:creativeml )?open ?rail(?: m)?", 80, "rail"),
    ("rail", "responsible ai licen[cs]es?", 80, "responsible"),
    ("llama", "llama [0-9]?(?: [0-9])? ?community licen[cs]e", 80, "llama"),
    ("public-domain", "(?:released|dedicated|placed|is) (?:in|to|into) the public domain", 60, "public domain"),
    ("public-domain", "this (?:work|file|software) is (?:hereby )?(?:released|placed) (?:into|in) the public domain", 62, "public domain"),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", 40, "copyright"),
    ("copyright", "copyright (?:c )?by (?:the )?(?:[a-z]+ )?(?:[0-9]{4}|inc|llc|ltd|gmbh|corp|corporation|company|foundation|university|authors?|contributors?)", 36, "copyright"),
    ("copyright", "copyright c by [a-z]+", 36, "copyright"),
    ("copyright", "(?:19|20)[0-9][0-9] copyright", 35, "copyright"),
    ("copyright", "portions copyright", 36, "portions"),
    ("reserved", "all rights reserved", 45, "reserved"),
    ("reserved", "alle rechte vorbehalten", 45, "vorbehalten"),
    ("reserved", "tous droits r\u00e9serv\u00e9s", 45, "droits"),
    ("reserved", "todos los derechos reservados", 45, "derechos"),
    ("reserved", "no part of this (?:publication|work|book) may be reproduced", 60, "reproduced"),
    ("reserved", "reproduction (?:in whole or in part )?(?:without permission )?is (?:strictly )?prohibited", 58, "prohibited"),
    ("proprietary", "proprietary and confidential", 60, "proprietary"),
    ("proprietary", "confidential and proprietary", 60, "proprietary"),
    ("proprietary", "unauthorized (?:copying|use|distribution|reproduction) of this (?:file|software|document)", 60, "unauthorized"),
    ("proprietary", "(?:valuable|confidential|proprietary|unpublished) trade secrets? of", 55, "trade"),
    ("proprietary", "end user licen[cs]e agreement", 55, "agreement"),
    ("proprietary", "for evaluation (?:purposes )?only", 45, "evaluation"),
    ("proprietary", "not for (?:re)?distribution", 45, "distribution"),
    ("proprietary", "for internal use only", 40, "internal use"),
    ("noncommercial", "for non ?commercial (?:use|purposes) only", 50, "commercial"),
    ("noncommercial", "for (?:academic|research|educational) (?:use|purposes) only", 50, "only"),
    ("warranty", "without warranties or conditions of any kind", 30, "warrant"),
    ("warranty", "(?:provided )?as is without warranty of any kind", 30, "warrant"),
    ("warranty", "without even the implied warranty of merchantability", 30, "merchantability"),
    ("warranty", "the implied warranties of merchantability and fitness for a particular purpose", 30, "merchantability"),
    ("dual", "dual licensed under", 45, "dual"),
    ("dual", "at your option (?:either|any|under)", 35, "option"),
    ("unknown", "see (?:the )?(?:accompanying )?licen[cs]e (?:file )?for (?:licen[cs]e )?(?:details|terms|information)", 25, "details"),
    ("unknown", "licensed under the (?:same )?terms (?:specified )?in (?:the )?licen[cs]e file", 25, "licensed"),
)

VERSION = "(?:licen[cs]e )?(?:(?:version |v )?v?[0-9]+(?: [0-9]+){0,2}(?: or (?:any )?later(?: version)?| only)?)?"

# The phrases that are always looked for, and their labels.
BASE: tuple[tuple[str, str], ...] = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    """rank orders rules of equal priority: the one written first wins."""

    label: str
    pattern: str
    priority: int
    keywords: tuple[str, ...]
    rank: int


#: Before the short name of a licence, and priority.
UNDER = (("(?:licen[cs]ed|released|distributed|published|available|provided) under (?:the |an? )?(?:terms of (?:the )?)?", 84, "under"), ("licen[cs]e ", 42, "licen"))


#: Priority of the further terms of an SPDX expression, which count only within one (see licenses.within_expression).
FURTHER_TERM = 98


def rules() -> tuple[Rule, ...]:
    """All rules, in order: rules of their own, addresses, SPDX tags, short names, then each family's names in each shape.

    The first keyword is the rarest; a text without it never meets the rule.
    """
    made = [(label, pattern, priority, (keyword,)) for label, pattern, priority, keyword in SINGLE]
    made += [(label, f"(?:www )?{pattern}", 88, (keyword, "org" if " org" in pattern else keyword)) for label, pattern, keyword in URLS]
    for label, names in SPDX:
        for name in names:
            made.append((label, f"spdx (?:file |snippet )?licen[cs]e identifier {name}", 100, ("spdx", name)))
            made.append((label, f"(?:or|and|with) {name}", FURTHER_TERM, ("spdx", name)))
            made.append((label, f"spdx org licenses {name}", 100, ("spdx", name)))
    for label, name in SHORT:
        word = max(re.findall("[a-z0-9]{2,}", re.sub("[(][?]:.*?[)][?]?", "", name)) or [""], key=len)
        for before, priority, keyword in UNDER:
            optional = f"(?: licen[cs]e)?(?: {VERSION})?" if priority > 50 else f"(?: {VERSION})?"
            made.append((label, f"{before}{name}{optional}", priority, tuple(filter(None, (keyword, word)))))
    for label, names, keyword in FAMILIES:
        for name in names:
            for shape, priority, word in SHAPES:
                pattern = shape.replace("NAME", name.replace("license", "licen[cs]e")).replace(" VERSION", f"(?: {VERSION})?")
                own = name.split(" ")[0] if len(keyword) < 3 or keyword == "license" else keyword
                made.append((label, pattern, priority, tuple(filter(None, (word, own, "licen" if "license" in name else "")))))
    return tuple(Rule(label, pattern, priority, keywords, i) for i, (label, pattern, priority, keywords) in enumerate(made))
