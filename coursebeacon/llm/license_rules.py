"""Signature rules of the license scan.

A rule is (label, keyword, also, priority, confidence, pattern). Patterns are Java regexes over
normalised text: lower-case words parted by one space. The pattern cannot match without the keyword,
a sequence of words, nor without ``also``, the beginning of a word or nothing. Rules of higher priority stand for longer and surer wordings; among equals the earlier
rule wins. SPDX ids, notices and wordings of the licenses' own texts are written out per license; how a
license is granted, named or mentioned is put together from its name, which is written out as well.
"""

TAG, STATEMENT, NAME, MENTION = (4, 1.0), (3, 0.95), (2, 0.8), (1, 0.5)
VERSION = r"(?: version| v)? ?"
GRANT = (
    r"(?:licensed|released|distributed|available|provided|published|redistributed|covered|governed)"
    r"(?: to you)?(?: under| by)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?"
)

#: label, keyword, spelled-out name
NAMED = [
    ("mit", "mit", "mit"),
    ("mit-0", "mit", "mit no attribution"),
    ("x11", "x11", "x11"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib"),
    ("libpng", "libpng", "libpng"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("beerware", "beerware", "beerware"),
    ("0bsd", "bsd", "(?:0|zero) clause bsd"),
    ("bsd-2-clause", "bsd", "(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd)"),
    ("bsd-2-clause", "freebsd", "freebsd"),
    ("bsd-3-clause", "bsd", "(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", "(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd|old bsd)"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("php", "php", "php"),
    ("ruby", "ruby", "ruby"),
    ("vim", "vim", "vim"),
    ("curl", "curl", "curl"),
    ("ntp", "ntp", "ntp"),
    ("tcl", "tcl", "tcl"),
    ("icu", "icu", "icu"),
    ("unicode", "unicode", "unicode"),
    ("ijg", "jpeg", "independent jpeg group"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    ("w3c", "w3c", "w3c(?: software(?: notice)?(?: and document)?)?"),
    ("sleepycat", "sleepycat", "sleepycat"),
    ("mulanpsl", "mulan", "mulan (?:psl|permissive software)"),
    ("sil-ofl", "font", "(?:sil )?open font"),
    ("hippocratic", "hippocratic", "hippocratic"),
    ("json", "json", "json"),
    ("qpl", "qt", "qt public"),
    ("qpl", "q public", "q public"),
    ("afl", "academic", "academic free"),
    ("osl", "open software", "open software"),
    ("ecl", "educational", "educational community"),
    ("rpl", "reciprocal", "reciprocal public"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "microsoft", "microsoft reciprocal"),
    ("npl", "netscape", "netscape public"),
    ("ipl", "ibm", "ibm public"),
    ("apsl", "apple", "apple public source"),
    ("spl", "sun", "sun public"),
    ("eupl", "european", "european union public"),
    ("cecill", "cecill", "cecill(?: [bc])?"),
    ("lppl", "latex", "latex project public"),
    ("odbl", "database", "open (?:data commons open )?database"),
    ("pddl", "public domain", "public domain dedication and"),
    ("odc-by", "data commons", "open data commons attribution"),
    ("bigscience-rail", "rail", "(?:bigscience|creativeml|bigcode)(?: open)? rail(?: m)?"),
    ("bigscience-rail", "openrail", "(?:(?:bigscience|creativeml|bigcode) )?openrail(?: m)?"),
    ("llama-community", "llama", "llama(?: [23])?(?: [123])? community"),
    ("sspl", "server side", "server side public"),
    ("busl", "business source", "business source"),
    ("elastic", "elastic", "elastic"),
    ("polyform", "polyform", "polyform [a-z]+"),
    ("commons-clause", "commons clause", "commons clause"),
]

#: label, keyword, name, version words
VERSIONED = [
    ("apache-1.0", "apache", "apache(?: software)?", "1 0"),
    ("apache-1.1", "apache", "apache(?: software)?", "1 1"),
    ("apache-2", "apache", "apache(?: software)?", "2(?: 0)?"),
    ("artistic-1", "artistic", "artistic", "1(?: 0)?"),
    ("artistic-2", "artistic", "artistic", "2(?: 0)?"),
    ("boost-1", "boost", "boost(?: software)?", "1(?: 0)?"),
    ("epl-1", "eclipse", "eclipse public", "1(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public", "2(?: 0)?"),
    ("mpl-1.0", "mozilla", "mozilla public", "1 0"),
    ("mpl-1.1", "mozilla", "mozilla public", "1 1"),
    ("mpl-2", "mozilla", "mozilla public", "2(?: 0)?"),
    ("cddl-1.0", "common development", "common development and distribution", "1(?: 0)?"),
    ("cddl-1.1", "common development", "common development and distribution", "1 1"),
    ("cpl-1", "common public", "common public", "1(?: 0)?"),
    ("python-2", "python", "python(?: software foundation)?", "2(?: 0)?"),
    ("zpl-2", "zope", "zope public", "2(?: [01])?"),
]

#: label, keyword, full name, short names, version
GNU = [
    ("gpl-1", "general public", "general public", "gpl", "1"),
    ("gpl-2", "general public", "general public", "gpl", "2"),
    ("gpl-3", "general public", "general public", "gpl", "3"),
    ("lgpl-2", "library general public", "library general public", "lgpl", "2"),
    ("lgpl-2.1", "lesser general public", "lesser general public", "lgpl", "2 1"),
    ("lgpl-3", "lesser general public", "lesser general public", "lgpl", "3"),
    ("agpl-3", "affero general public", "affero general public", "agpl", "3"),
    ("gfdl-1", "free documentation", "free documentation", "gfdl", "1(?: [123])?"),
]

#: label, spelled-out elements, short elements
CREATIVE = [
    ("cc-by", "attribution", "by"),
    ("cc-by-sa", "attribution share ?alike", "by sa"),
    ("cc-by-nd", "attribution no ?deriv(?:ative)?s", "by nd"),
    ("cc-by-nc", "attribution non ?commercial", "by nc"),
    ("cc-by-nc-sa", "attribution non ?commercial share ?alike", "by nc sa"),
    ("cc-by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s", "by nc nd"),
]

#: label, keyword, pattern: notices without a name
NOTICES = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", "neither the name", "neither the names? of (?:[^ ]+ ){1,60}?nor the names of (?:(?:its|their|the|any|other) )?contributors"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features"),
    ("zlib", "provided as is", "this software is provided as is without any express or implied warranty"),
    ("unlicense", "public domain", "free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(?:dedicated|released|placed) (?:in )?(?:to|into|in) the public domain"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "creative commons", "creative commons zero(?: v?1 0)?(?: universal)?"),
    ("gpl", "general public", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("proprietary", "confidential", "proprietary and confidential"),
]

#: label, identifiers of the SPDX list in words
SPDX = [
    ("mit", "mit"),
    ("mit-0", "mit 0"),
    ("x11", "x11"),
    ("isc", "isc"),
    ("zlib", "zlib"),
    ("libpng", "libpng(?: 2 0)?"),
    ("unlicense", "unlicense"),
    ("wtfpl", "wtfpl"),
    ("beerware", "beerware"),
    ("0bsd", "0bsd"),
    ("bsd-2-clause", "bsd 2 clause(?: (?:patent|views|freebsd|netbsd))?"),
    ("bsd-3-clause", "bsd 3 clause(?: (?:attribution|clear|lbnl|modification))?"),
    ("bsd-4-clause", "bsd 4 clause(?: (?:uc|shortened))?"),
    ("postgresql", "postgresql"),
    ("openssl", "openssl"),
    ("php", "php(?: 3 01?)?"),
    ("ruby", "ruby"),
    ("vim", "vim"),
    ("curl", "curl"),
    ("ntp", "ntp(?: 0)?"),
    ("tcl", "tcl"),
    ("icu", "icu"),
    ("unicode", "unicode(?: (?:3 0|dfs 201[56]|tou))?"),
    ("ijg", "ijg(?: short)?"),
    ("ncsa", "ncsa"),
    ("w3c", "w3c(?: (?:19980720|20150513))?"),
    ("sleepycat", "sleepycat"),
    ("mulanpsl", "mulanpsl(?: [12] 0)?"),
    ("sil-ofl", "(?:sil )?ofl(?: 1 [01](?: (?:no )?rfn)?)?"),
    ("hippocratic", "hippocratic(?: 2 1)?"),
    ("json", "json"),
    ("qpl", "qpl(?: 1 0)?"),
    ("afl", "afl(?: (?:1 [12]|2 [01]|3 0))?"),
    ("osl", "osl(?: (?:1 [01]|2 [01]|3 0))?"),
    ("ecl", "ecl(?: [12] 0)?"),
    ("rpl", "rpl(?: 1 [15])?"),
    ("ms-pl", "ms pl"),
    ("ms-rl", "ms rl"),
    ("npl", "npl(?: 1 [01])?"),
    ("ipl", "ipl(?: 1 0)?"),
    ("apsl", "apsl(?: (?:1 [012]|2 0))?"),
    ("spl", "spl(?: 1 0)?"),
    ("eupl", "eupl(?: 1 [012])?"),
    ("cecill", "cecill(?: (?:1 [01]|2 [01]|b|c))?"),
    ("lppl", "lppl(?: 1 (?:[012]|3[ac]))?"),
    ("odbl", "odbl(?: 1 0)?"),
    ("pddl", "pddl(?: 1 0)?"),
    ("odc-by", "odc by(?: 1 0)?"),
    ("bigscience-rail", "bigscience rail"),
    ("llama-community", "llama community"),
    ("sspl", "sspl(?: 1 0)?"),
    ("busl", "busl(?: 1 1)?"),
    ("elastic", "elastic(?: 2 0)?"),
    ("polyform", "polyform(?: (?:noncommercial|small business) 1 0 0)?"),
    ("commons-clause", "commons clause"),
    ("cc0", "cc0(?: 1 0)?"),
    ("apache-1.0", "apache 1 0"),
    ("apache-1.1", "apache 1 1"),
    ("apache-2", "apache 2(?: 0)?"),
    ("artistic-1", "artistic 1(?: 0(?: (?:cl8|perl))?)?"),
    ("artistic-2", "artistic 2(?: 0)?"),
    ("boost-1", "(?:bsl|boost) 1(?: 0)?"),
    ("epl-1", "epl 1(?: 0)?"),
    ("epl-2", "epl 2(?: 0)?"),
    ("mpl-1.0", "mpl 1 0"),
    ("mpl-1.1", "mpl 1 1"),
    ("mpl-2", "mpl 2(?: 0(?: no copyleft exception)?)?"),
    ("cddl-1.0", "cddl 1 0"),
    ("cddl-1.1", "cddl 1 1"),
    ("cpl-1", "cpl 1(?: 0)?"),
    ("python-2", "(?:python|psf) 2(?: 0(?: 1)?)?"),
    ("zpl-2", "zpl 2(?: [01])?"),
    ("gpl-1", "gpl 1(?: 0)?(?: only| or later)?"),
    ("gpl-2", "gpl 2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gpl 3(?: 0)?(?: only| or later)?"),
    ("lgpl-2", "lgpl 2(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lgpl 2 1(?: 0)?(?: only| or later)?"),
    ("lgpl-3", "lgpl 3(?: 0)?(?: only| or later)?"),
    ("agpl-3", "agpl 3(?: 0)?(?: only| or later)?"),
    ("gfdl-1", "gfdl 1(?: [123])?(?: (?:no )?invariants)?(?: 0)?(?: only| or later)?"),
    ("cc-by", "cc by(?: [1234] [05])?"),
    ("cc-by-sa", "cc by sa(?: [1234] [05])?"),
    ("cc-by-nd", "cc by nd(?: [1234] [05])?"),
    ("cc-by-nc", "cc by nc(?: [1234] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", "cc by nc nd(?: [1234] [05])?"),
]

#: label, keyword, pattern: wordings that stand in one license's own text or in the notice it asks for
WORDINGS = [
    ("eupl", "european union", "this european union public licence the eupl applies to the work"),
    ("eupl", "eupl", "licensed under the eupl"),
    ("osl", "open software license", "this open software license the license applies to any original work of authorship"),
    ("osl", "open software license", "licensed under the open software license version [123] [01]"),
    ("afl", "academic free license", "this academic free license the license applies to any original work of authorship"),
    ("afl", "academic free license", "licensed under the academic free license version [123] [01]"),
    ("polyform", "licensor grants you", "the licensor grants you a copyright license for the software to do everything you might do with the software that would otherwise infringe the licensor s copyright in it"),
    ("odbl", "use the database", "non exclusive terminable but only under section 9 license to use the database for the duration of any applicable copyright and database rights"),
    ("odbl", "made available under", "is made available under the open database license"),
    ("mulanpsl", "mulan psl", "you can use this software according to the terms and conditions of the mulan psl v[12]"),
    ("apsl", "apple public source", "original code as defined in and that are subject to the apple public source license"),
    ("ms-pl", "microsoft public license", "microsoft public license ms pl this license governs use of the accompanying software"),
    ("ms-rl", "reciprocal grants", "reciprocal grants for any file you distribute that contains code from the software"),
    ("mpl-1.0", "mozilla public license", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("cddl-1.1", "common development", "common development and distribution license cddl version 1 1"),
    ("gpl-1", "gnu general public license", "gnu general public license version 1 february 1989"),
    ("hippocratic", "human rights", "(?:systems activities or other uses that violate any human rights laws|the software shall not be used in violation of human rights laws)"),
    ("ecl", "educational community", "licensed under the educational community license version [12] 0"),
    ("rpl", "reciprocal public license", "unless explicitly acquired and licensed from licensor under another license the contents of this file are subject to the reciprocal public license"),
    ("npl", "netscape public license", "the contents of this file are subject to the netscape public license version 1 [01]"),
    ("mit", "substantial portions", "this permission notice shall be included in all copies or substantial portions of the software"),
    ("x11", "x consortium", "the name of the x consortium shall not be used in advertising"),
    ("isc", "appear in all copies", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "permission to use copy", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("ntp", "permission to use copy", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies"),
    ("zlib", "misrepresented", "(?:origin of this software must not be misrepresented|misrepresented as being the original software)"),
    ("libpng", "libpng", "this code is released under the libpng license"),
    ("unlicense", "anyone is free", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "do what the", "do what the fuck you want to(?: public license)?"),
    ("beerware", "buy me a beer", "(?:this stuff is worth it )?you can buy me a beer in return"),
    ("bsd-2-clause", "freebsd", "official policies either expressed or implied of the freebsd project"),
    ("bsd-3-clause", "endorse or promote", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("postgresql", "postgresql", "postgresql database management system formerly known as postgres"),
    ("openssl", "openssl project", "this product includes software developed by the openssl project"),
    ("php", "php software", "this product includes php software"),
    ("ruby", "verbatim copies", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("vim", "unmodified copies", "there are no restrictions on distributing unmodified copies of vim"),
    ("tcl", "explicitly disclaimed", "the following terms apply to all files associated with the software unless explicitly disclaimed in individual files"),
    ("unicode", "unicode data files", "unicode data files and any associated documentation"),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("ncsa", "deal with the software", "to deal with the software without restriction"),
    ("w3c", "trademarks of copyright holders", "name and trademarks of copyright holders may not be used in advertising or publicity"),
    ("sleepycat", "redistributions in any form", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("sil-ofl", "font software", "this font software is licensed under the sil open font license"),
    ("json", "good not evil", "the software shall be used for good not evil"),
    ("cecill", "french law", "cecill(?: [bc])? license under french law"),
    ("lppl", "latex project", "under the conditions of the latex project public license"),
    ("busl", "non production use", "redistribute and make non production use of the licensed work"),
    ("elastic", "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("sspl", "third parties as a service", "functionality of the program or a modified version available to third parties as a service"),
    ("commons-clause", "right to sell", "does not grant to you the right to sell the software"),
    ("llama-community", "llama", "llama (?:2|3)(?: [123])? is licensed under the llama (?:2|3)(?: [123])? community license"),
    ("apache-2", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "apache org", "apache org licenses license 2 0"),
    ("artistic-1", "intent of this document", "the intent of this document is to state the conditions under which a package may be copied"),
    ("boost-1", "accompanying documentation", "any person or organization obtaining a copy of the software and accompanying documentation"),
    ("epl-1", "eclipse org", "eclipse org legal epl v10"),
    ("epl-2", "eclipse org", "eclipse org legal epl (?:2 0|v20)"),
    ("mpl-1.1", "mozilla public", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", "mozilla public", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cddl-1.0", "common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("python-2", "psf", "psf is making python available to licensee on an as is basis"),
    ("zpl-2", "zope public", "subject to the provisions of the zope public license version 2 [01]"),
    ("gpl-2", "general public", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "general public", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2", "library general public", "gnu library general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl-2.1", "lesser general public", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3", "lesser general public", "gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", "affero general public", "gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("gfdl-1", "free documentation", "distribute and or modify this document under the terms of the gnu free documentation license"),
    ("cc0", "related or neighboring rights", "waived all copyright and related or neighboring rights"),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited"),
]


Rule = tuple[str, str, str, int, float, str]


def rules() -> list[Rule]:
    """All rules in their order."""
    found: list[Rule] = []

    def add(label: str, keyword: str, kind: tuple[int, float], pattern: str, also: str = "") -> None:
        found.append((label, keyword, also, *kind, pattern))

    for label, ids in SPDX:
        add(label, "spdx", TAG, rf"spdx license identifier {ids}")
    for label, keyword, pattern in [*NOTICES, *WORDINGS]:
        add(label, keyword, STATEMENT, pattern)
    for label, keyword, name in NAMED:
        add(label, keyword, STATEMENT, rf"{GRANT} {name} licen[cs]e", "licen")
        add(label, keyword, NAME, rf"{name} licen[cs]e", "licen")
        add(label, keyword, MENTION, rf"licen[cs]e {name}", "licen")
    for label, keyword, name, v in VERSIONED:
        add(label, keyword, STATEMENT, rf"{GRANT} {name} licen[cs]e{VERSION}{v}")
        add(label, keyword, NAME, rf"{name} licen[cs]e{VERSION}{v}")
        add(label, keyword, MENTION, rf"{name}{VERSION}{v}(?: licen[cs]e)?")
    for label, keyword, name, short, v in GNU:
        add(label, keyword, STATEMENT, rf"{GRANT} gnu {name} licen[cs]e(?: as published by the free software foundation)?(?: either)?{VERSION}{v}(?: 0)?")
        add(label, keyword, NAME, rf"(?:gnu )?{name} licen[cs]e{VERSION}{v}(?: 0)?")
        add(label, short, MENTION, rf"(?:gnu )?{short}(?: v| version)? {v}(?: 0)?")
        add(label, f"{short}v", MENTION, rf"{short}v{v}(?: 0)?\+?")
    for label, words, short in CREATIVE:
        add(label, "creativecommons", TAG, rf"creativecommons org licenses {short} [1234] [05]")
        add(label, "creative commons", STATEMENT, rf"{GRANT} creative commons {words}(?: [1234] [05])?")
        add(label, "creative commons", NAME, rf"creative commons {words}(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?")
        add(label, "cc", NAME, rf"cc {short}(?: [1234] [05])?(?: licen[cs]e)?")
    return found
