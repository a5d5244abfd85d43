"""Licence scan: ordered signature rules over lower-cased text, with DataFrame and SQL functions only.

Rules are regular expressions in order of priority: declared identifiers, then clauses of the licence texts and pages, then
titles, then short names. Those of clauses and short names are written one by one; those of titles and identifiers come from
a table of licences. A rule runs only on texts that hold its keyword and its own words, and no rule runs on texts without any of
the few gate words. Detections are intervals of the text; one inside an interval of equal or better priority is suppressed.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, whole_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels; fixed values.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: (label, title, SPDX-like identifiers, page of the text): titles and identifiers as published; fixed values.
LICENSES = (
    ("agpl", "gnu affero general public license", ("agpl-3.0", "agpl-1.0"), "gnu.org/licenses/agpl"),
    ("lgpl", "gnu lesser general public license", ("lgpl-2.1", "lgpl-3.0"), "gnu.org/licenses/lgpl"),
    ("gfdl", "gnu free documentation license", ("gfdl-1.3", "gfdl-1.2"), "gnu.org/licenses/fdl"),
    ("gpl", "gnu general public license", ("gpl-2.0", "gpl-3.0"), "gnu.org/licenses/gpl"),
    ("apache", "apache license", ("apache-2.0", "apache-1.1"), "apache.org/licenses/license"),
    ("mit", "mit license", ("mit-0", "x11-mit"), "opensource.org/licenses/mit"),
    ("bsd", "bsd license", ("bsd-2-clause", "bsd-3-clause"), "opensource.org/licenses/bsd"),
    ("isc", "isc license", ("isc-license",), "opensource.org/licenses/isc"),
    ("mpl", "mozilla public license", ("mpl-2.0", "mpl-1.1"), "mozilla.org/mpl"),
    ("epl", "eclipse public license", ("epl-2.0", "epl-1.0"), "eclipse.org/legal/epl"),
    ("cddl", "common development and distribution license", ("cddl-1.0", "cddl-1.1"), "opensource.org/licenses/cddl"),
    ("cpl", "common public license", ("cpl-1.0",), "opensource.org/licenses/cpl"),
    ("eupl", "european union public licence", ("eupl-1.2", "eupl-1.1"), "joinup.ec.europa.eu/collection/eupl"),
    ("artistic", "artistic license", ("artistic-2.0", "artistic-1.0"), "opensource.org/licenses/artistic"),
    ("zlib", "zlib license", ("zlib-acknowledgement",), "opensource.org/licenses/zlib"),
    ("boost", "boost software license", ("bsl-1.0",), "boost.org/license"),
    ("unlicense", "the unlicense", ("unlicense-1.0",), "unlicense.org"),
    ("wtfpl", "do what the fuck you want to public license", ("wtfpl-2.0",), "wtfpl.net"),
    ("postgresql", "postgresql license", ("postgresql-license",), "opensource.org/licenses/postgresql"),
    ("python", "python software foundation license", ("psf-2.0", "python-2.0"), "docs.python.org/license"),
    ("openssl", "openssl license", ("openssl-license",), "openssl.org/source/license"),
    ("ofl", "sil open font license", ("ofl-1.1", "ofl-1.0"), "scripts.sil.org/ofl"),
    ("osl", "open software license", ("osl-3.0", "osl-2.1"), "opensource.org/licenses/osl"),
    ("afl", "academic free license", ("afl-3.0", "afl-2.1"), "opensource.org/licenses/afl"),
    ("ms-pl", "microsoft public license", ("ms-pl",), "opensource.org/licenses/ms-pl"),
    ("ms-rl", "microsoft reciprocal license", ("ms-rl",), "opensource.org/licenses/ms-rl"),
    ("odbl", "open database license", ("odbl-1.0",), "opendatacommons.org/licenses/odbl"),
    ("odc-by", "open data commons attribution license", ("odc-by-1.0",), "opendatacommons.org/licenses/by"),
    ("pddl", "public domain dedication and license", ("pddl-1.0",), "opendatacommons.org/licenses/pddl"),
    ("cc0", "cc0 1.0 universal", ("cc0-1.0",), "creativecommons.org/publicdomain/zero"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives", ("cc-by-nc-nd", "cc by-nc-nd"), "creativecommons.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike", ("cc-by-nc-sa", "cc by-nc-sa"), "creativecommons.org/licenses/by-nc-sa"),
    ("cc-by-nc", "creative commons attribution noncommercial", ("cc-by-nc", "cc by-nc"), "creativecommons.org/licenses/by-nc"),
    ("cc-by-nd", "creative commons attribution noderivatives", ("cc-by-nd", "cc by-nd"), "creativecommons.org/licenses/by-nd"),
    ("cc-by-sa", "creative commons attribution sharealike", ("cc-by-sa", "cc by-sa"), "creativecommons.org/licenses/by-sa"),
    ("cc-by", "creative commons attribution", ("cc-by", "cc by"), "creativecommons.org/licenses/by"),
    ("openrail", "responsible ai license", ("openrail-m", "bigscience-openrail-m"), "huggingface.co/spaces/bigscience/license"),
    ("busl", "business source license", ("busl-1.1",), "mariadb.com/bsl11"),
    ("sspl", "server side public license", ("sspl-1.0",), "mongodb.com/licensing/server-side-public-license"),
    ("elastic", "elastic license", ("elastic-2.0",), "elastic.co/licensing/elastic-license"),
)
#: Labels that are published identifiers themselves: they count where a text declares them or grants under them, not as bare words.
DECLARED = ("mit", "isc", "zlib", "unlicense", "wtfpl", "postgresql", "openssl")
#: Keywords of clauses and titles, single words, since any marks may stand between two: the first one that a phrase holds is its prefilter.
KEYWORDS = ("licen", "software", "permission", "redistribut", "creative", "copyright", "material", "source", "acceptance", "warrant", "network", "sections", "restrictions", "production", "contribution", "terms", "cc0", "fuck", "mozilla", "mpl", "cddl", "anniversary")
#: Words that the names of many licences share, so that they do not tell them apart.
COMMON = ("license", "licence", "public", "general", "software", "creative", "commons", "attribution", "open", "free", "source", "copyright", "permission", "warranties", "distribute")
#: Sentences of the licence texts: (label, words). "~" stands for up to six words of any kind.
CLAUSES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd", "neither the name of ~ nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd", "this software is provided by the regents and contributors as is and any express or implied warranties"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache", "any contribution intentionally submitted for inclusion in the work by you to the licensor"),
    ("apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "either version ~ of the license or at your option any later version"),
    ("gpl", "see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with"),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu library general public license as published by the free software foundation"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with"),
    ("agpl", "all users interacting with it remotely through a computer network"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "you can obtain one at ~ mozilla org mpl"),
    ("mpl", "this source code form is incompatible with secondary licenses"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl", "this program and the accompanying materials are made available under the terms of the common public license"),
    ("eupl", "licensed under the eupl ~ european union public licence"),
    ("eupl", "you may not use this work except in compliance with the licence eupl"),
    ("artistic", "you may distribute your modified version as source ~ in the form of the standard version"),
    ("artistic", "you can redistribute it and or modify it under the terms of the artistic license"),
    ("artistic", "redistribute it and or modify it under the same terms as perl itself"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "distributed under the boost software license"),
    ("boost", "solely in the form of machine executable object code generated by a source language processor"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("python", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ofl", "this font software is licensed under the sil open font license"),
    ("ofl", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ofl", "neither the font software nor any of its individual components ~ may be sold by itself"),
    ("osl", "licensed under the open software license version"),
    ("afl", "licensed under the academic free license version"),
    ("ms-pl", "this license governs use of the accompanying software ~ microsoft public license"),
    ("odbl", "made available under the open database license"),
    ("odc-by", "made available under the open data commons attribution license"),
    ("pddl", "made available under the public domain dedication and license"),
    ("cc0", "has waived all copyright and related or neighboring rights"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("cc-by", "this work is licensed under a creative commons attribution ~ international license"),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nc", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("openrail", "the use restrictions ~ apply to the model and derivatives of the model"),
    ("busl", "effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("busl", "make non production use of the licensed work"),
    ("sspl", "you must make the service source code available via network download to everyone at no charge"),
    ("elastic", "you may not provide the software to third parties as a hosted or managed service"),
    ("elastic", "you may not move change disable or circumvent the license key functionality in the software"),
    ("elastic", "the licensor grants you a non exclusive royalty free worldwide non sublicensable non transferable license to use copy distribute"),
    ("mit", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd", "the views and conclusions contained in the software and documentation are those of the authors"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache", "the names ~ apache software foundation must not be used to endorse or promote products derived from this software"),
    ("apache", "this product includes software developed by the apache software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty"),
    ("gpl", "this program is free software you can redistribute it and or modify it"),
    ("gpl", "as a special exception the copyright holders of ~ give you permission to link"),
    ("gpl", "additional permission under gnu gpl version 3 section 7"),
    ("lgpl", "this library is free software you can redistribute it and or modify it"),
    ("lgpl", "you may convey a combined work under terms of your choice"),
    ("agpl", "remote network interaction use with the gnu general public license"),
    ("agpl", "prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", "a copy of the license is included in the section entitled gnu free documentation license"),
    ("mpl", "the contents of this file are subject to the mozilla public license version"),
    ("mpl", "if a copy of the mpl was not distributed with this file"),
    ("epl", "a contributor may choose to distribute the program in object code form under its own license agreement"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse distribution license"),
    ("cddl", "you can obtain a copy of the license at ~ opensource org licenses cddl"),
    ("cddl", "when distributing covered code include this cddl header in each file"),
    ("cpl", "the accompanying program is provided under the terms of this common public license"),
    ("eupl", "the licence is governed by the law of the european union country where the licensor resides"),
    ("eupl", "licensed under the eupl version"),
    ("artistic", "you may make and give away verbatim copies of the source form of the standard version of this package"),
    ("artistic", "the intent is to develop and maintain the copyright holder s artistic control over the development"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors"),
    ("zlib", "this notice may not be removed or altered from any source distribution"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("python", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce"),
    ("python", "psf is making python available to licensee on an as is basis"),
    ("python", "provided however that psf s license agreement and psf s notice of copyright"),
    ("openssl", "redistributions of any form whatsoever must retain the following acknowledgment"),
    ("ofl", "no modified version of the font software may use the reserved font name"),
    ("ofl", "original or modified versions of the font software may be bundled redistributed and or sold with any software"),
    ("osl", "licensor hereby grants you a worldwide royalty free non exclusive sublicensable license ~ to reproduce the original work in copies"),
    ("afl", "this academic free license applies to any original work of authorship"),
    ("afl", "licensed under the academic free license"),
    ("ms-pl", "if you bring a patent claim against any contributor over patents that you claim are infringed by the software"),
    ("ms-rl", "for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file"),
    ("ms-rl", "this license governs use of the accompanying software ~ microsoft reciprocal license"),
    ("odbl", "any derivative database that you publicly use must be only under the terms of"),
    ("odbl", "contains information from ~ which is made available here under the open database license"),
    ("odc-by", "contains information from ~ which is made available under the odc attribution license"),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by", "you may not apply legal terms or technological measures that legally restrict others from doing anything the license permits"),
    ("cc-by-sa", "text is available under the creative commons attribution sharealike license"),
    ("cc-by-sa", "the adapter s license you apply must be a creative commons license with the same license elements"),
    ("cc-by-nc", "to the extent ~ exercise the licensed rights for noncommercial purposes only"),
    ("cc-by-nc", "the licensor reserves any right to collect such royalties ~ when the licensed material is used other than for noncommercial purposes"),
    ("cc-by-nc-nd", "produce and reproduce but not share adapted material for noncommercial purposes only"),
    ("openrail", "use based restrictions as referenced in paragraph 5 must be included as an enforceable provision"),
    ("busl", "the business source license is not an open source license"),
    ("busl", "licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("sspl", "service source code means the corresponding source for the program or the modified version"),
    ("mit", "permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software"),
    ("mit", "the software may be used for any purpose provided that this copyright notice is included in all copies of the software"),
    ("bsd", "subject to the limitations in the disclaimer below provided that the following conditions are met redistributions"),
    ("bsd", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("isc", "copyright ~ internet systems consortium inc"),
    ("apache", "this license does not grant permission to use the trade names trademarks service marks or product names of the licensor"),
    ("apache", "if you institute patent litigation against any entity ~ then any patent licenses granted to you under this license"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "there is no warranty for the program to the extent permitted by applicable law"),
    ("gpl", "each licensee is addressed as you licensees and recipients may be individuals or organizations"),
    ("lgpl", "this license the lesser general public license applies to some specially designated software packages typically libraries"),
    ("agpl", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("mpl", "each contributor hereby grants you a world wide royalty free non exclusive license"),
    ("epl", "the eclipse foundation is the initial agreement steward ~ license"),
    ("cddl", "this license shall be governed by the law of the jurisdiction specified in a notice contained within the original software"),
    ("eupl", "the licensor hereby grants you a worldwide royalty free non exclusive sublicensable licence to do the following"),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate"),
    ("openssl", "the openssl toolkit stays under a double license"),
    ("ofl", "the fonts including any derivative works can be bundled embedded redistributed and or sold with any software"),
    ("osl", "this open software license the license applies to any original work of authorship"),
    ("odbl", "the open database license odbl is a license agreement intended to allow users to freely share modify and use"),
    ("cc0", "to the extent possible under law ~ has waived all copyright"),
    ("busl", "the licensor may make an additional use grant above permitting limited production use"),
)
#: Short names as people write them, with or without a version: (label, keyword, pattern).
SHORT = (
    ("agpl", "gpl", r"(?:gnu )?agpl(?:[ -]?v?[13](?:\.0)?)?(?:\+|(?:-only|-or-later| or later))?"),
    ("lgpl", "gpl", r"(?:gnu )?lgpl(?:[ -]?v?[23](?:\.[01])?)?(?:\+|(?:-only|-or-later| or later))?"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl(?:[ -]?v?1\.[123])?(?:\+|(?:-only|-or-later| or later))?"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?:[ -]?v?[123](?:\.0)?)?(?:\+|(?:-only|-or-later| or later))?"),
    ("apache", "apache", r"apache[ -]?(?:v|version )?(?:1\.[01]|2(?:\.0)?)(?: licen[sc]ed?)?"),
    ("apache", "apache", r"apache(?: software)? licen[sc]ed?"),
    ("apache", "asl 2", r"asl 2(?:\.0)?"),
    ("mit", "licen", r"(?:mit|expat|x11)[ /-](?:style |type )?licen[sc]ed?"),
    ("bsd", "licen", r"(?:new |modified |simplified |original )?bsd(?:[ -][234][ -]clause)?[ -](?:style |type )?licen[sc]ed?"),
    ("bsd", "clause bsd", r"(?:two|three|four|[234])[ -]clause bsd"),
    ("isc", "licen", r"isc[ -](?:style |type )?licen[sc]ed?"),
    ("mpl", "mpl 2", r"mpl 2\.0"),
    ("mpl", "mpl 1", r"mpl 1\.[01]"),
    ("epl", "epl 2", r"epl 2\.0"),
    ("epl", "epl 1", r"epl 1\.0"),
    ("cddl", "cddl", r"cddl(?:[ -]?(?:v|version )?1\.[01])?"),
    ("cpl", "cpl 1", r"cpl 1\.0"),
    ("eupl", "eupl", r"eupl(?:[ -]?(?:v|version )?1\.[0-2])?"),
    ("zlib", "licen", r"zlib(?:/libpng)? licen[sc]ed?"),
    ("boost", "licen", r"boost licen[sc]e"),
    ("unlicense", "licen", r"(?:under|by|the) (?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl[ -]?v?2(?:\.0)?"),
    ("postgresql", "licen", r"postgres(?:ql)? licen[sc]e"),
    ("python", "licen", r"psf licen[sc]e"),
    ("python", "licen", r"python(?: software foundation)? licen[sc]e"),
    ("ofl", "ofl 1", r"(?:sil )?ofl 1\.[01]"),
    ("ofl", "sil ofl", r"sil ofl"),
    ("odbl", "odbl", r"odbl(?:[ -]?v?1\.0)?"),
    ("pddl", "pddl", r"pddl(?:[ -]?v?1\.0)?"),
    ("cc0", "cc0", r"cc0(?:[ -]1\.0)?"),
    ("cc0", "cc zero", r"cc zero"),
    ("cc-by-nc-nd", "by-nc", r"(?:cc[ -])?by-nc-nd(?:[ -]?[1-4]\.0)?"),
    ("cc-by-nc-sa", "by-nc", r"(?:cc[ -])?by-nc-sa(?:[ -]?[1-4]\.0)?"),
    ("cc-by-nc", "by-nc", r"(?:cc[ -])?by-nc(?:[ -]?[1-4]\.0)?"),
    ("cc-by-nd", "by-nd", r"(?:cc[ -])?by-nd(?:[ -]?[1-4]\.0)?"),
    ("cc-by-sa", "by-sa", r"(?:cc[ -])?by-sa(?:[ -]?[1-4]\.0)?"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?:\+\+)?(?:-m)?"),
    ("busl", "busl", r"busl(?:[ -]?1\.1)?"),
    ("sspl", "sspl", r"sspl(?:[ -]?v?1(?:\.0)?)?"),
    ("public-domain", "public domain", r"(?:released|dedicated|placed|put) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", r"(?:this|the) (?:work|file|software|code|text|document) is (?:in )?(?:the )?public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("proprietary", "confidential", r"confidential and proprietary"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution)[a-z ,]{0,60}(?:is )?(?:strictly )?prohibited"),
)
def _words(phrase: str) -> str:
    """The phrase's words with any non-word characters between them; ~ for up to six words."""
    words = phrase.replace("-", " ").split()
    parts = [rf"(?:{WORD}{GAP}){{0,6}}?" if w == "~" else "".join("\\" + c if not c.isalnum() else c for c in w) + (GAP if k + 1 < len(words) else "") for k, w in enumerate(words)]
    return "".join(parts)


def keyword(phrase: str) -> str:
    return next(k for k in KEYWORDS if k in phrase)


class Rule(NamedTuple):
    """Runs on texts that hold its keyword, one of few, and its own words, which few rules share; every match holds both."""

    priority: int
    label: str
    keyword: str
    own: str
    pattern: str


def _own(phrase: str) -> str:
    """The longest word of a phrase; words of all licences' names come last."""
    return max((w for w in phrase.replace("-", " ").split() if w != "~"), key=lambda w: (w not in COMMON, len(w)))


def _version(identifier: str) -> str:
    """What identifiers of one version share, -2.0 say, which texts rarely hold otherwise; the whole identifier where it has none."""
    cut = identifier.rfind("-")
    return identifier[cut:] if cut > 0 and identifier[cut + 1 :].replace(".", "").isdigit() and "." in identifier[cut:] else identifier


def signatures() -> list[Rule]:
    """All rules, best first. Priority 0: a declared identifier; 1: a clause, a grant or a page; 2: a title; 3: a short name."""
    edge, end = r"(?<![a-z0-9])", r"(?![a-z0-9])"
    made = [Rule(1, label, keyword(words), _own(words), edge + _words(words) + end) for label, words in CLAUSES]
    for label, title, ids, page in LICENSES:
        key, own = keyword(title), _own(title)
        for i in (*ids, *[label] * (label in DECLARED)):
            esc = i.replace(".", r"\.")
            made.append(Rule(0, label, "licen", i, rf"spdx-license-identifier:\s*{esc}(?:-only|-or-later|\+)?{end}"))
            made.append(Rule(1, label, "licen", i, rf"licen[sc]ed?{GAP}(?:under|as|:){GAP}(?:the{GAP})?{esc}(?:-only|-or-later|\+)?{end}"))
            if i in ids:
                made.append(Rule(3, label, _version(i), i, rf"{edge}{esc}(?:-only|-or-later|\+)?{end}"))
        t = _words(title)
        version = rf"(?:{GAP}(?:version|v){GAP}?[0-9](?:\.[0-9])?)?"
        made.append(Rule(1, label, key, own, rf"(?:licensed|released|distributed|available|published|redistributed){GAP}under{GAP}(?:the{GAP}|a{GAP}|an{GAP})?(?:terms{GAP}of{GAP}(?:the{GAP})?)?{t}{version}"))
        made.append(Rule(1, label, page, page, rf"(?:https?://)?(?:www\.)?{page.replace('.', chr(92) + '.')}[a-z0-9/.#-]*"))
        made.append(Rule(2, label, key, own, rf"{edge}{t}{version}{end}"))
    made += [Rule(3, label, key, key, edge + pattern + end) for label, key, pattern in SHORT]
    return sorted(made, key=lambda r: r.priority)


def rules() -> list[tuple[int, int, str, str, str]]:
    """(priority, rank, label, keyword, pattern) of all signatures, best first."""
    return [(r.priority, k, r.label, r.keyword, r.pattern) for k, r in enumerate(signatures())]


def gate(table: list) -> list[str]:
    """Words of which every rule's keyword holds one, so no rule can match a text without any of them."""
    found: list[str] = []
    for key in sorted({r[3] for r in table}, key=len):
        if not any(g in key for g in found):
            found.append(key)
    return found


#: Stand around a hit while a text is searched; in texts they become blanks before.
OPEN, CLOSE = "\x01", "\x02"


def _detections(text: str) -> Column:
    """array<struct<start, end, priority, label>> of all rules whose words the text in a column holds, unsuppressed.

    Each rule is an expression of its own, compiled once a task, behind its keyword and its own words; it marks its hits, and places are read off the marks.
    """
    by_key: dict[str, dict[str, list]] = {}
    for r in signatures():
        by_key.setdefault(r.keyword, {}).setdefault(r.own, []).append((r.priority, r.label, r.pattern))
    none = "cast(array() AS array<struct<priority:int,label:string,marked:string>>)"
    held = lambda word, found: f"CASE WHEN contains({text}, '{word}') THEN {found} ELSE {none} END"
    every = lambda found: found[0] if len(found) == 1 else f"flatten(array({', '.join(found)}))"

    def searched(rows):
        one = [f"struct({p} AS priority, '{label}' AS label, regexp_replace({text}, r'{pattern}', '{OPEN}$0{CLOSE}') AS marked)" for p, label, pattern in rows]
        return f"array({', '.join(one)})"

    # One SQL expression: so many columns would each be a call to the JVM, which takes longer than planning them.
    found = [held(key, every([searched(rows) if own == key else held(own, searched(rows)) for own, rows in owns.items()])) for key, owns in by_key.items()]
    marked = F.expr(f"filter(flatten(array({', '.join(found)})), r -> contains(r.marked, '{OPEN}'))")
    # Parts between hits and hits in turn; each begins where those before it end. One step a transform, so that each is computed once.
    cut = F.transform(marked, lambda r: F.struct(r["priority"].alias("priority"), r["label"].alias("label"), F.split(F.translate(r["marked"], CLOSE, OPEN), OPEN, -1).alias("parts")))
    add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x)))
    ended = F.transform(cut, lambda r: F.struct(r["priority"].alias("priority"), r["label"].alias("label"), F.aggregate(r["parts"], F.array(F.lit(0)), add).alias("ends")))

    def places(r):
        hit = lambda k: F.struct(r["ends"][2 * k + 1].alias("start"), r["ends"][2 * k + 2].alias("end"), r["priority"].alias("priority"), r["label"].alias("label"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(r["ends"]) - 4) / 2).cast("int")), hit)

    return F.flatten(F.transform(ended, places))


def _unsuppressed(found: Column) -> Column:
    """Detections not inside one of equal or better priority: a sweep by start that keeps the furthest end of each priority."""
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["priority"].alias("priority"), d["label"].alias("label"))))
    none = F.array().cast("array<struct<start:int,back:int,priority:int,label:string>>")
    start = F.struct(*[F.lit(-1).alias(f"e{p}") for p in range(4)], none.alias("out"))

    def step(acc, d):
        end = -d["back"]
        within = reduce(lambda a, b: a | b, [(d["priority"] >= p) & (end <= acc[f"e{p}"]) for p in range(4)])
        ends = [F.when(~within & (d["priority"] == p), F.greatest(acc[f"e{p}"], end)).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in range(4)]
        return F.struct(*ends, F.when(within, acc["out"]).otherwise(F.concat(acc["out"], F.array(d))).alias("out"))

    return F.aggregate(ordered, start, step, lambda acc: F.transform(acc["out"], lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["priority"].alias("priority"), d["label"].alias("label"))))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with: n_words, n_base, first_word, last_word, base_labels (array), detections (array of start, end, priority, label), labels (array), score.

    Null texts count as empty: no words, no detections, null positions, score 0. Only A-Z are lower-cased. All columns
    of docs are kept as they are, but those with a name of the result, which give way. score is the share of the text's
    characters inside detections and base phrases' words, at most 1. Each row is judged alone, repeated ones too, on its
    whole text however long.
    """
    table = rules()
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    out = ("n_words", "n_base", "first_word", "last_word", "base_labels", "detections", "labels", "score")
    df = docs.drop(*out).withColumn("_low", F.translate(whole_text(text_col), upper + OPEN + CLOSE, lower + "  "))
    df = df.withColumn("n_words", F.regexp_count("_low", F.lit(WORD)).cast("long"))
    # Base phrases: in texts that have one's words somewhere, over the words with single blanks between them.
    likely = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.contains("_low", F.lit(w)) for w in phrase.split()]) for phrase, _ in BASE])
    joined = F.concat(F.lit(" "), F.regexp_replace("_low", GAP, " "), F.lit(" "))
    df = df.withColumn("_line", F.when(likely, joined))
    counts = [F.when(F.contains("_line", F.lit(f" {p} ")), F.regexp_count("_line", F.lit(f"(?= {p} )"))).otherwise(0) for p, _ in BASE]
    df = df.withColumn("_n", F.array(*counts)).withColumn("n_base", F.aggregate("_n", F.lit(0), lambda a, x: a + x).cast("long"))
    some = F.col("n_base") > 0
    any_phrase = " (?:" + "|".join(p for p, _ in BASE) + ") "
    # Words before a place: the word starts to its left. _line may begin with two blanks, so words are counted, not blanks.
    before = lambda cut: F.regexp_count(cut, F.lit("[^ ]+")).cast("long")
    first = before(F.expr(f"substring(_line, 1, regexp_instr(_line, '{any_phrase}'))"))
    last = before(F.regexp_extract("_line", f"(?s)^(.*){any_phrase}", 1))
    df = df.withColumn("first_word", F.when(some, first)).withColumn("last_word", F.when(some, last))
    base = F.array_compact(F.array(*[F.when(F.col("_n")[k] > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    df = df.withColumn("base_labels", F.array_sort(F.array_distinct(base)))
    gated = reduce(lambda a, b: a | b, [F.contains("_low", F.lit(w)) for w in gate(table)])
    nothing = F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>")
    df = df.withColumn("detections", F.when(gated, _unsuppressed(_detections("_low"))).otherwise(nothing))
    # Overlapping detections count once: by start, what each adds beyond the furthest end so far.
    covered = F.aggregate(
        "detections", F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda acc, d: F.struct(F.greatest(acc["to"], d["end"]).alias("to"), (acc["n"] + F.greatest(F.lit(0), d["end"] - F.greatest(acc["to"], d["start"]))).alias("n")),
        lambda acc: acc["n"],
    )
    based = F.aggregate(F.zip_with("_n", F.array(*[F.lit(len(p)) for p, _ in BASE]), lambda n, w: n * w), F.lit(0), lambda a, x: a + x)
    share = F.greatest(covered, based) / F.greatest(F.length("_low"), F.lit(1))
    labels = F.array_sort(F.array_union("base_labels", F.transform("detections", lambda d: d["label"])))
    hidden = ("_low", "_line", "_n")
    return df.select(*[c for c in df.columns if c not in hidden], labels.alias("labels"), F.least(F.lit(1.0), share).alias("score"))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
