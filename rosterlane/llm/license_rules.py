"""Signature rules for licence texts, over text that is lower-cased and whose words are joined by single spaces.

A rule is (priority, label, keyword, pattern, score): lower priority numbers win; the keyword, a plain string that every match
contains, gates the pattern. Names, versions and addresses are hand-written per licence; the phrases around them
(tags, grants, headings) are hand-written once and combined with each.
"""

from __future__ import annotations

#: Label, keyword, pattern of the licence's names. A keyword is in every match of its pattern.
NAMES = [
    ("agpl", "affero general public license", r"(?:gnu )?affero general public license"),
    ("agpl", "agpl", r"agpl(?: ?v?[13](?: 0)?)?"),
    ("lgpl", "lesser general public license", r"(?:gnu )?lesser general public license"),
    ("lgpl", "library general public license", r"(?:gnu )?library general public license"),
    ("lgpl", "lgpl", r"lgpl(?: ?v?[23](?: [01])?)?"),
    ("gpl", "general public license", r"gnu general public license"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?: ?v?[123](?: 0)?)?"),
    ("gfdl", "free documentation license", r"(?:gnu )?free documentation license"),
    ("gfdl", "gfdl", r"gfdl"),
    ("apache", "apache", r"(?:the )?apache(?: software)? license"),
    ("apache", "apache", r"apache 2(?: 0)?"),
    ("mit", "mit", r"(?:the )?mit license"),
    ("mit", "expat", r"(?:the )?expat license"),
    ("bsd-2", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd(?: 2 clause)?(?: license)?"),
    ("bsd-2", "bsd", r"bsd 2 clause(?: license)?"),
    ("bsd-3", "bsd", r"(?:new|revised|modified|3 clause|three clause) bsd(?: 3 clause)?(?: license)?"),
    ("bsd-3", "bsd", r"bsd 3 clause(?: license)?"),
    ("bsd-4", "bsd", r"(?:original|4 clause|four clause) bsd(?: license)?"),
    ("bsd-4", "bsd", r"bsd 4 clause(?: license)?"),
    ("bsd", "bsd", r"bsd(?: style)? license"),
    ("0bsd", "0bsd", r"0bsd"),
    ("0bsd", "zero clause bsd", r"(?:bsd )?zero clause bsd(?: license)?"),
    ("isc", "isc", r"(?:the )?isc license"),
    ("mpl", "mozilla public license", r"mozilla public license"),
    ("mpl", "mpl", r"mpl ?v? ?[12] [01]"),
    ("epl", "eclipse public license", r"eclipse public license"),
    ("epl", "epl", r"epl ?v? ?[12] 0"),
    ("edl", "eclipse distribution license", r"eclipse distribution license"),
    ("cddl", "common development and distribution license", r"common development and distribution license"),
    ("cddl", "cddl", r"cddl(?: 1 [01])?"),
    ("cpl", "common public license", r"common public license"),
    ("ipl", "ibm public license", r"ibm public license"),
    ("eupl", "european union public licen", r"european union public licen[cs]e"),
    ("eupl", "eupl", r"eupl(?: ?v? ?1 [012])?"),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: license)?"),
    ("artistic", "artistic license", r"(?:clarified )?artistic license"),
    ("perl", "same terms as perl", r"same terms as perl(?: itself)?"),
    ("psf", "python software foundation license", r"python software foundation license"),
    ("psf", "psf license", r"psf license"),
    ("ruby", "ruby license", r"ruby license"),
    ("php", "php license", r"php license"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("libpng", "libpng license", r"libpng license"),
    ("bsl-boost", "boost software license", r"boost software license"),
    ("busl", "business source license", r"business source license"),
    ("sspl", "server side public license", r"server side public license"),
    ("sspl", "sspl", r"sspl(?: 1 0)?"),
    ("elastic", "elastic license", r"elastic license"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("upl", "universal permissive license", r"universal permissive license"),
    ("afl", "academic free license", r"academic free license"),
    ("osl", "open software license", r"open software license"),
    ("apsl", "apple public source license", r"apple public source license"),
    ("ms-pl", "microsoft public license", r"microsoft public license"),
    ("ms-rl", "microsoft reciprocal license", r"microsoft reciprocal license"),
    ("ofl", "open font license", r"(?:sil )?open font license"),
    ("ofl", "ofl 1 1", r"ofl 1 1"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source license"),
    ("postgresql", "postgresql license", r"postgresql license"),
    ("openssl", "openssl license", r"openssl license"),
    ("beerware", "beer", r"beer ?ware(?: license)?"),
    ("w3c", "w3c", r"w3c software(?: notice and)? license"),
    ("unicode", "unicode license", r"unicode license(?: v3)?"),
    ("vim", "vim license", r"vim license"),
    ("x11", "x11 license", r"x11 license"),
    ("zpl", "zope public license", r"zope public license"),
    ("qpl", "q public license", r"q public license"),
    ("sleepycat", "sleepycat license", r"sleepycat license"),
    ("watcom", "sybase open watcom public license", r"sybase open watcom public license"),
    ("odbl", "open database license", r"open database license"),
    ("odbl", "odbl", r"odbl(?: 1 0)?"),
    ("odc-by", "open data commons attribution license", r"open data commons attribution license"),
    ("pddl", "public domain dedication and license", r"(?:open data commons )?public domain dedication and license"),
    ("ogl", "open government licence", r"open government licence"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa"),
    ("cc-by-nc", "cc by nc", r"cc by nc"),
    ("cc-by-nd", "cc by nd", r"cc by nd"),
    ("cc-by-sa", "cc by sa", r"cc by sa"),
    ("cc-by", "cc by", r"cc by"),
    ("cc-by-nc-nd", "attribution noncommercial noderiv", r"(?:creative commons )?attribution noncommercial noderiv(?:ative)?s"),
    ("cc-by-nc-sa", "attribution noncommercial sharealike", r"(?:creative commons )?attribution noncommercial sharealike"),
    ("cc-by-nc", "attribution noncommercial", r"(?:creative commons )?attribution noncommercial"),
    ("cc-by-nd", "attribution noderiv", r"(?:creative commons )?attribution noderiv(?:ative)?s"),
    ("cc-by-sa", "attribution sharealike", r"(?:creative commons )?attribution sharealike"),
    ("cc-by", "creative commons attribution", r"creative commons attribution"),
    ("openrail", "openrail", r"(?:creativeml )?openrail(?: m)?"),
    ("llama", "llama", r"llama ?[0-9]*(?: [0-9])? community license"),
    ("mulan", "mulan", r"mulan (?:psl|permissive software license)"),
    ("blueoak", "blue oak model license", r"blue oak model license"),
    ("hippocratic", "hippocratic license", r"hippocratic license"),
    ("gemma", "gemma terms of use", r"gemma terms of use"),
]

#: An address or a sentence that only one licence has.
TEXTS = [
    (0, "mit", "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0),
    (0, "mit", "the above copyright notice and this permission notice shall", r"the above copyright notice and this permission notice shall be included in all copies", 0.9),
    (0, "isc", "permission to use copy modify and", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
    (0, "bsd", "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    (0, "bsd-3", "neither the name of", r"neither the name of [a-z0-9 ]{1,60}nor the names of its contributors may be used", 1.0),
    (0, "bsd-4", "all advertising materials mentioning features", r"all advertising materials mentioning features or use of this software must display", 1.0),
    (0, "zlib", "this software is provided as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 1.0),
    (0, "bsl-boost", "permission is hereby granted free of charge to any person or organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 1.0),
    (0, "apache", "you may not use this file except in compliance", r"you may not use this file except in compliance with the license", 0.9),
    (0, "apache", "apache org licenses", r"(?:www )?apache org licenses(?: license 2 0)?", 1.0),
    (0, "gpl", "under the terms of the gnu general public license", r"redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    (0, "lgpl", "under the terms of the gnu lesser general public license", r"redistribute it and or modify it under the terms of the gnu lesser general public license", 1.0),
    (0, "agpl", "under the terms of the gnu affero general public license", r"redistribute it and or modify it under the terms of the gnu affero general public license", 1.0),
    (0, "gpl", "gnu org licenses gpl", r"(?:www )?gnu org licenses gpl(?: [23] 0)?", 1.0),
    (0, "lgpl", "gnu org licenses lgpl", r"(?:www )?gnu org licenses lgpl(?: [23] [01])?", 1.0),
    (0, "agpl", "gnu org licenses agpl", r"(?:www )?gnu org licenses agpl(?: 3 0)?", 1.0),
    (0, "mpl", "mozilla org mpl", r"mozilla org mpl(?: 2 0)?", 1.0),
    (0, "mpl", "this source code form is subject to the terms of the mozilla", r"this source code form is subject to the terms of the mozilla public license", 1.0),
    (0, "unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain", 1.0),
    (0, "unlicense", "unlicense org", r"unlicense org", 1.0),
    (0, "wtfpl", "do what the fuck you want to public license", r"do what the fuck you want to public license", 1.0),
    (0, "cc-by-nc-nd", "licenses by nc nd", r"creativecommons org licenses by nc nd(?: [1234] 0)?", 1.0),
    (0, "cc-by-nc-sa", "licenses by nc sa", r"creativecommons org licenses by nc sa(?: [1234] 0)?", 1.0),
    (0, "cc-by-nc", "licenses by nc", r"creativecommons org licenses by nc(?: [1234] 0)?", 1.0),
    (0, "cc-by-nd", "licenses by nd", r"creativecommons org licenses by nd(?: [1234] 0)?", 1.0),
    (0, "cc-by-sa", "licenses by sa", r"creativecommons org licenses by sa(?: [1234] 0)?", 1.0),
    (0, "cc-by", "licenses by", r"creativecommons org licenses by(?: [1234] 0)?", 0.9),
    (0, "cc0", "creativecommons org publicdomain zero", r"creativecommons org publicdomain zero(?: 1 0)?", 1.0),
    (3, "public-domain", "public domain", r"(?:released into|placed in|dedicated to|is in) the public domain", 0.6),
    (3, "all-rights-reserved", "all rights reserved", r"all rights reserved", 0.5),
    (3, "proprietary", "confidential and proprietary", r"confidential and proprietary", 0.6),
    (3, "eula", "end user license agreement", r"end user license agreement", 0.6),
]

_VERSION = r"(?: (?:version )?v?[0-9](?: [0-9])?(?: or (?:any )?later(?: version)?| only)?)?"


def rules() -> list[tuple[int, str, str, str, float]]:
    """All rules: a tag, a grant and the plain name for each name, then the texts; each pattern stands at word borders."""
    out = list(TEXTS)
    for label, keyword, name in NAMES:
        out += [
            (1, label, keyword, rf"spdx license identifier {name}{_VERSION}", 1.0),
            (1, label, keyword, rf"(?:licensed|released|distributed|available|published|covered|made available|provided) (?:only )?(?:under|by) (?:the )?(?:terms of |conditions of )?(?:the )?{name}{_VERSION}", 0.95),
            (2, label, keyword, rf"{name}{_VERSION}", 0.7),
        ]
    return [(p, label, keyword, rf"(?<= ){pattern}(?= )", score) for p, label, keyword, pattern, score in out]


#: A normalised text in which none of these stands holds no keyword, so no rule matches.
ANCHORS = tuple(
    f" {a}"
    for a in (
        "licen", "gpl", "agpl", "lgpl", "gfdl", "apache", "bsd", "0bsd", "mpl", "epl", "cddl", "eupl", "cecill", "same terms as perl", "sspl", "unlicense",
        "wtfpl", "ofl 1", "beer", "odbl", "cc0", "cc by", "attribution no", "attribution share", "creative commons attribution", "openrail", "mulan",
        "gemma terms of use", "public domain", "all rights reserved", "confidential and proprietary", "permission is hereby", "the above copyright notice",
        "permission to use", "redistribution and use", "neither the name of", "all advertising materials", "this software is provided", "mozilla org",
        "free and unencumbered", "creativecommons", "you may not use this file", "this source code form", "under the terms of the gnu",
    )
)
