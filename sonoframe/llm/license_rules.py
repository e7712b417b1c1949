"""Signature rules for licences, as text: expressions over a text's words (lower case, single spaces).

Each rule has a keyword that its expression cannot match without, a label, a priority and a confidence. Families that come
in versions and kinds are written once as templates."""

from __future__ import annotations

import json

#: The phrases that the base detection looks for, and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: A text without any of these, in lower case, matches no rule and no base phrase.
GATES = ("licen", "gpl", "rights", "copyright", "creative", "domain", "spdx", "wtfpl", "cc0", "copyleft", "gfdl", "hereby", "redistribution", "permission", "neither", "advertising",
         "misrepresented", "official", "reserved", "prohibited", "decompile", "commercial", "openstreetmap", "apache", "openssl", "jpeg", "evil", "/mpl", "legal/epl")
GATE_CC = "cc[^0-9a-z]+by"

_L = "licen[sc]e"
#: Names under which a licence is granted, a keyword of each, its label, and its versions.
NAMED = [
    ("apache", "apache", "apache", ["1 0", "1 1", "2 0"]),
    ("mit", " mit ", "mit", []),
    ("expat", "expat", "mit", []),
    ("x11", " x11 ", "x11", []),
    ("isc", " isc ", "isc", []),
    ("zlib", "zlib", "zlib", []),
    ("(?:new |modified |revised )?bsd", " bsd ", "bsd", []),
    ("(?:2|two) clause bsd", "clause bsd", "bsd-2-clause", []),
    ("(?:3|three) clause bsd", "clause bsd", "bsd-3-clause", []),
    ("(?:4|four) clause bsd", "clause bsd", "bsd-4-clause", []),
    ("bsd 2 clause", "bsd 2", "bsd-2-clause", []),
    ("bsd 3 clause", "bsd 3", "bsd-3-clause", []),
    ("bsd 4 clause", "bsd 4", "bsd-4-clause", []),
    ("zero clause bsd", "zero clause", "0bsd", []),
    ("mozilla public", "mozilla", "mpl", ["1 0", "1 1", "2 0"]),
    ("eclipse public", "eclipse", "epl", ["1 0", "2 0"]),
    ("eclipse distribution", "eclipse", "edl", ["1 0"]),
    ("common development and distribution", "common development", "cddl", ["1 0", "1 1"]),
    ("common public", "common public", "cpl", ["1 0"]),
    ("european union public", "european union", "eupl", ["1 0", "1 1", "1 2"]),
    ("boost software", "boost", "boost", ["1 0"]),
    ("artistic", "artistic", "artistic", ["1 0", "2 0"]),
    ("academic free", "academic free", "afl", ["2 0", "2 1", "3 0"]),
    ("open software", "open software", "osl", ["1 0", "2 0", "2 1", "3 0"]),
    ("sil open font", "open font", "ofl", ["1 0", "1 1"]),
    ("microsoft public", "microsoft public", "ms-pl", []),
    ("microsoft reciprocal", "microsoft reciprocal", "ms-rl", []),
    ("python software foundation", "python software", "psf", ["2"]),
    ("php", " php ", "php", ["3 0", "3 01"]),
    ("postgresql", "postgresql", "postgresql", []),
    ("ruby", " ruby ", "ruby", []),
    ("openssl", "openssl", "openssl", []),
    ("university of illinois ncsa open source", "university of illinois", "ncsa", []),
    ("server side public", "server side", "sspl", ["1"]),
    ("business source", "business source", "busl", ["1 1"]),
    ("elastic", " elastic ", "elastic", ["2 0"]),
    ("open database", "open database", "odbl", ["1 0"]),
    ("open data commons attribution", "open data commons", "odc-by", ["1 0"]),
    ("community data", "community data", "cdla", ["1 0", "2 0"]),
    ("open government", "open government", "ogl", ["1 0", "2 0", "3 0"]),
    ("bigscience (?:open )?rail", "bigscience", "rail", ["1 0"]),
    ("llama community", "llama community", "llama-community", ["2", "3"]),
]
#: Short names in SPDX ids, by label, where they aren't the names above.
SHORT = {
    "epl": "epl", "cddl": "cddl", "cpl": "cpl", "eupl": "eupl", "boost": "bsl", "afl": "afl", "osl": "osl", "ofl": "ofl", "ms-pl": "ms pl", "ms-rl": "ms rl",
    "psf": "psf", "ncsa": "ncsa", "sspl": "sspl", "busl": "busl", "odbl": "odbl", "odc-by": "odc by", "cdla": "cdla (?:permissive|sharing)", "ogl": "ogl uk",
}
#: Other SPDX ids and their labels.
IDS = [("mpl 1 0", "mpl-1.0"), ("mpl 1 1", "mpl-1.1"), ("mpl 2 0", "mpl-2.0"), ("lgpl 2 0", "lgpl-2"), ("cecill 2 1", "cecill-2.1"), ("cecill b", "cecill-b"), ("cecill c", "cecill-c"), ("vim", "vim"), ("tcl", "tcl"), ("w3c", "w3c"), ("hpnd", "hpnd"), ("icu", "icu"), ("curl", "curl"), ("blueoak 1 0 0", "blueoak-1.0.0"), ("upl 1 0", "upl-1.0"), ("ecl 2 0", "ecl-2.0"), ("lppl 1 3c", "lppl-1.3c"), ("naist 2003", "naist"), ("ntp", "ntp"), ("qpl 1 0", "qpl-1.0"), ("sleepycat", "sleepycat"), ("watcom 1 0", "watcom-1.0"), ("zpl 2 1", "zpl-2.1"), ("rpl 1 5", "rpl-1.5"), ("mulanpsl 2 0", "mulanpsl-2.0"), ("wtfpl", "wtfpl"), ("beerware", "beerware"), ("cc0 1 0", "cc0"), ("cc by 4 0", "cc-by-4.0"), ("cc by sa 4 0", "cc-by-sa-4.0"), ("mit 0", "mit-0"), ("bsd 1 clause", "bsd-1-clause"), ("bsd 3 clause clear", "bsd-3-clause-clear"), ("0bsd", "0bsd"), ("unlicense", "unlicense"), ("python 2 0", "psf-2")]
#: (name, short name, label, versions).
GNU = [
    ("general public", "gpl", "gpl", ["1", "2", "3"]),
    ("lesser general public", "lgpl", "lgpl", ["2 1", "3"]),
    ("library general public", "lgpl", "lgpl", ["2"]),
    ("affero general public", "agpl", "agpl", ["1", "3"]),
    ("free documentation", "gfdl", "gfdl", ["1 1", "1 2", "1 3"]),
]
CC_KINDS = [("by", ""), ("by sa", " share ?alike"), ("by nd", " no ?deriv(?:ative|ative work)?s"), ("by nc", " non ?commercial"), ("by nc sa", " non ?commercial share ?alike"), ("by nc nd", " non ?commercial no ?deriv(?:ative|ative work)?s")]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
#: One signature a line: label | keyword that it cannot match without | confidence | expression.
SIGNATURES = r"""
# Grants, conditions and disclaimers of permissive licences
mit | permission is hereby granted | 0.95 | permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?
mit | sublicen | 0.9 | without limitation the rights to use copy modify merge publish distribute sublicen[sc]e and or sell copies
mit | substantial portions | 0.9 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | no attribution | 0.6 | mit no attribution licen[sc]e
x11 | x consortium | 0.8 | except as contained in this notice the name of the x consortium shall not be used in advertising
x11 | advertising or otherwise | 0.6 | shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written
isc | permission to use | 0.8 | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
isc | permission to use | 0.6 | permission to use copy modify and (?:or )?distribute this software
0bsd | permission to use | 0.4 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
hpnd | permission to use | 0.8 | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
ntp | permission to use | 0.7 | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
bsd | redistribution | 0.9 | redistribution and use in source and binary forms(?: with or without modification are permitted)?
bsd | redistributions of source | 0.8 | redistributions of source code must retain the (?:above )?copyright notice
bsd | redistributions in binary | 0.8 | redistributions in binary form must reproduce the (?:above )?copyright notice
bsd-3-clause | neither the name | 0.9 | neither the name of [^.]{1,160} may be used
bsd-4-clause | advertising materials | 0.9 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | official policies | 0.6 | the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies
zlib | permission is granted to anyone | 0.95 | permission is granted to anyone to use this software for any purpose including commercial applications
zlib | misrepresented | 0.85 | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered source versions | 0.7 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
boost-1.0 | permission is hereby granted | 0.95 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
boost-1.0 | boost software | 0.9 | distributed under the boost software licen[sc]e version 1 0
apache-2.0 | apache org | 0.95 | (?:www )?apache org licenses license 2 0(?: html| txt)?
apache-2.0 | apache licen | 0.9 | licensed under the apache licen[sc]e version 2 0
apache-2.0 | in compliance with the licen | 0.7 | you may not use this file except in compliance with the licen[sc]e
apache-2.0 | perpetual worldwide | 0.6 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e
apache-2.0 | limitations under the licen | 0.6 | see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e
apache-1.1 | apache software foundation | 0.8 | this product includes software developed by the apache software foundation
mit | opensource org | 0.9 | opensource org licenses mit(?: licen[sc]e)?(?: php| html)?
bsd-2-clause | opensource org | 0.9 | opensource org licenses bsd 2 clause
bsd-3-clause | opensource org | 0.9 | opensource org licenses bsd 3 clause
isc | opensource org | 0.9 | opensource org licenses isc(?: licen[sc]e)?
artistic-2.0 | opensource org | 0.9 | opensource org licenses artistic(?: license)? 2 0
mpl-2.0 | opensource org | 0.9 | opensource org licenses mpl 2 0
curl | curl | 0.6 | curl and libcurl are licensed under
icu | icu licen | 0.9 | icu licen[sc]e icu 1 8 1 and later
unicode | unicode inc | 0.9 | unicode inc licen[sc]e agreement data files and software
unicode | unicode data files | 0.7 | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
libpng | png | 0.9 | (?:png reference library|libpng) licen[sc]e(?: version 2)?
ijg | independent jpeg group | 0.9 | this software is based in part on the work of the independent jpeg group
freetype | freetype | 0.9 | (?:the )?freetype (?:project )?licen[sc]e
freetype | freetype project | 0.8 | portions of this software are copyright (?:c )?(?:[0-9]{4} )?the freetype project
vim | vim licen | 0.9 | vim licen[sc]e
tcl | tcl | 0.8 | tcl tk licen[sc]e(?: terms)?
info-zip | info zip | 0.9 | info zip licen[sc]e
bzip2 | bzip2 | 0.8 | bzip2 and libbzip2 licen[sc]e
blueoak-1.0.0 | blue oak | 0.9 | blue oak model licen[sc]e(?: 1 0 0)?
upl-1.0 | universal permissive | 0.9 | universal permissive licen[sc]e(?: upl)?(?: version)?(?: 1 0)?
mulanpsl-2.0 | mulan | 0.9 | mulan psl ?v?2 licen[sc]e
mulanpsl | mulan | 0.8 | mulan permissive software licen[sc]e(?: v(?:ersion )?[12])?
ecl-2.0 | educational community | 0.9 | educational community licen[sc]e version 2 0
ecl | educational community | 0.8 | educational community licen[sc]e
lppl-1.3c | latex project public | 0.9 | latex project public licen[sc]e(?: either)? version 1 3c?
lppl | latex project public | 0.8 | latex project public licen[sc]e
zpl-2.1 | zope public | 0.9 | zope public licen[sc]e(?: zpl)? version 2 1
zpl | zope public | 0.8 | zope public licen[sc]e
w3c | w3c | 0.9 | w3c software (?:notice and|and document)(?: notice and)? licen[sc]e
w3c | w3c document | 0.8 | w3c document licen[sc]e
psf-2 | psf licen | 0.9 | psf licen[sc]e agreement for python [0-9]
cnri | cnri | 0.9 | cnri (?:open source )?licen[sc]e agreement
openssl | openssl toolkit | 0.8 | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | ssleay | 0.9 | original ssleay licen[sc]e
ncsa | deal with the software | 0.9 | to deal with the software without restriction including without limitation the rights to use
postgresql | this paragraph | 0.8 | without a written agreement is hereby granted provided that the above copyright notice and this paragraph
sqlite | in place of a legal notice | 0.9 | the author disclaims copyright to this source code in place of a legal notice here is a blessing
beerware | beer ware | 0.95 | the beer ware licen[sc]e(?: revision 42)?
wtfpl | wtfpl | 0.9 | wtfpl
wtfpl | public licen | 0.95 | do what the fuck you want to public licen[sc]e
unlicense | unlicen | 0.95 | (?:the unlicen[sc]e|unlicen[sc]e org)
unlicense | free and unencumbered | 0.95 | this is free and unencumbered software released into the public domain
jsmin | good not evil | 0.9 | the software shall be used for good not evil
watcom-1.0 | open watcom | 0.9 | sybase open watcom public licen[sc]e(?: version 1 0)?
# Copyleft notices
gpl | you can redistribute | 0.9 | (?:is free software )?you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
lgpl | lesser general public | 0.9 | redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e
agpl | affero general public | 0.9 | redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e
gpl | should have received a copy | 0.8 | you should have received a copy of the gnu general public licen[sc]e along with this program
lgpl | should have received a copy | 0.8 | you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this (?:library|program)
agpl | should have received a copy | 0.8 | you should have received a copy of the gnu affero general public licen[sc]e along with this program
gfdl | free documentation | 0.9 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
mpl-2.0 | mozilla org | 0.95 | mozilla org mpl 2 0
mpl-2.0 | source code form | 0.95 | this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-1.1 | mozilla org | 0.9 | mozilla org mpl mpl 1 1(?: html)?
mpl | contents of this file | 0.8 | the contents of this file are subject to the mozilla public licen[sc]e
epl-2.0 | eclipse org | 0.95 | (?:www )?eclipse org legal epl 2 0
epl-1.0 | eclipse org | 0.95 | (?:www )?eclipse org legal epl v10(?: html)?
epl | accompanying materials | 0.8 | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
cddl | contents of this file | 0.85 | the contents of this file are subject to the terms of the common development and distribution licen[sc]e
eupl | eupl | 0.8 | licensed under the eupl
cecill-2.1 | cecill | 0.9 | cecill (?:free software )?licen[sc]e(?: agreement)?(?: version)? 2 1
cecill | cecill | 0.8 | cecill (?:free software )?licen[sc]e
cecill-b | cecill b | 0.9 | cecill b (?:free software )?licen[sc]e
cecill-c | cecill c | 0.9 | cecill c (?:free software )?licen[sc]e
osl-3.0 | open software licen | 0.8 | licensed under the open software licen[sc]e version 3 0
rpl-1.5 | reciprocal public | 0.9 | reciprocal public licen[sc]e(?: 1 5)?
qpl-1.0 | q public | 0.9 | q public licen[sc]e(?: version 1 0)?
sleepycat | sleepycat | 0.9 | sleepycat (?:software )?licen[sc]e
ipl | ibm public | 0.9 | ibm public licen[sc]e(?: version)?(?: 1 0)?
cpal | common public attribution | 0.9 | common public attribution licen[sc]e(?: version)?(?: 1 0)?
apsl | apple public source | 0.9 | apple public source licen[sc]e(?: version)?(?: 2 0)?
ms-pl | ms pl | 0.8 | ms pl licen[sc]e
ms-ll | microsoft limited | 0.9 | microsoft limited public licen[sc]e
copyleft | copyleft | 0.5 | copyleft
share-alike | share alike | 0.5 | share alike licen[sc]e
# Creative works, data and models
cc0 | cc0 | 0.9 | cc0(?: 1 0)?(?: universal)?
cc0 | creative commons | 0.9 | creative commons (?:zero|0|cc0)
cc0 | creativecommons | 0.95 | creativecommons org publicdomain zero 1 0
cc0 | waived all copyright | 0.9 | (?:has|have) waived all copyright and related or neighboring rights
public-domain | creativecommons | 0.95 | creativecommons org publicdomain mark 1 0
public-domain | public domain | 0.8 | (?:dedicated|released|placed|is|are) (?:to|in|into) the public domain
public-domain | public domain | 0.6 | public domain (?:work|text|book|notice|dedication)
public-domain | no rights reserved | 0.7 | no rights reserved
public-domain | no copyright | 0.5 | no copyright
public-domain | copyright has expired | 0.7 | copyright has expired
us-government | government | 0.7 | works? of the (?:united states|u s) (?:federal )?government [^.]{0,80}copyright
cc | creative commons | 0.6 | (?:licensed )?under a creative commons licen[sc]e
cc | creative commons | 0.5 | creative commons licen[sc]es?
cc-sampling | sampling plus | 0.9 | creative commons sampling plus 1 0
free-art | free art | 0.9 | free art licen[sc]e(?: 1 3)?
odbl-1.0 | opendatacommons | 0.95 | opendatacommons org licenses odbl(?: 1 0)?
odc-by-1.0 | opendatacommons | 0.95 | opendatacommons org licenses by(?: 1 0)?
pddl-1.0 | opendatacommons | 0.95 | opendatacommons org licenses pddl(?: 1 0)?
pddl-1.0 | public domain dedication | 0.9 | (?:open data commons )?public domain dedication and licen[sc]e
odbl-1.0 | openstreetmap | 0.7 | openstreetmap contributors
cdla-permissive-2.0 | cdla permissive | 0.9 | cdla permissive 2 0 licen[sc]e
ogl | contains public sector | 0.9 | contains public sector information licensed under the open government licen[sc]e
ofl-1.1 | font software | 0.9 | this font software is licensed under the sil open font licen[sc]e version 1 1
ofl | reserved font name | 0.7 | with reserved font name
bitstream-vera | bitstream vera | 0.9 | bitstream vera fonts copyright
rail | responsible ai | 0.8 | (?:open )?responsible ai licen[sc]e
rail | openrail | 0.8 | (?:creativeml|bigcode|bigscience)? ?openrail(?: m)?(?: licen[sc]e)
llama-community | llama | 0.9 | llama [0-9]+(?: [0-9])? community licen[sc]e(?: agreement)?
gutenberg | project gutenberg | 0.9 | project gutenberg tm? ?licen[sc]e
gutenberg | project gutenberg | 0.8 | terms of the project gutenberg licen[sc]e
wikipedia | text is available under | 0.6 | text is available under the creative commons attribution share ?alike licen[sc]e
arxiv | arxiv org | 0.9 | arxiv org licen[sc]es? nonexclusive distrib(?: 1 0)?
# Proprietary, commercial and restricted terms
proprietary | reserved without | 0.9 | (?:all )?rights (?:are )?reserved without (?:a )?licen[sc]e
proprietary | proprietary | 0.8 | proprietary licen[sc]e
proprietary | confidential | 0.7 | confidential and proprietary [^.]{0,80}(?:rights|copyright)
proprietary | may be reproduced | 0.8 | no part of this (?:publication|book|work|document|site|website|article) may be reproduced [^.]{0,160}permission
proprietary | written permission | 0.6 | without (?:the )?(?:express |prior )*written permission of the (?:publisher|author|owner|copyright holder)
proprietary | commercial licen | 0.7 | (?:subject to|under|requires) a commercial licen[sc]e
proprietary | end user | 0.8 | end user licen[sc]e agreement
proprietary | prohibited | 0.6 | unauthori[sz]ed (?:copying|reproduction|use|distribution) [^.]{0,100}prohibited
proprietary | licensed not sold | 0.8 | (?:software|product) is licensed not sold
proprietary | trade secret | 0.6 | trade secrets? [^.]{0,80}(?:copyright|licen[sc]e)
proprietary | reverse engineer | 0.6 | reverse engineer decompile or disassemble
non-commercial | non commercial use only | 0.7 | (?:licen[sc]ed )?for (?:personal and )?non commercial use only
academic | only | 0.6 | for (?:academic|research) (?:use|purposes) only [^.]{0,80}(?:licen[sc]e|permission|copyright)
evaluation | evaluation licen | 0.7 | evaluation licen[sc]e
shareware | shareware | 0.7 | shareware licen[sc]e
freeware | freeware | 0.7 | freeware licen[sc]e
fair-use | fair use | 0.4 | fair use [^.]{0,60}copyright
royalty-free | royalty free | 0.6 | royalty free licen[sc]e
site-licence | site licen | 0.6 | site licen[sc]e
dual | dual licen | 0.6 | dual licen[sc]ed?
some-rights | some rights reserved | 0.7 | some rights reserved
elastic-2.0 | elastic licen | 0.9 | elastic licen[sc]e 2 0
sspl-1 | server side public | 0.9 | server side public licen[sc]e(?: version 1| v 1| v1)
busl-1.1 | change date | 0.7 | change date [a-z0-9 ]{0,60}change licen[sc]e
commons-clause | commons clause | 0.9 | commons clause licen[sc]e condition(?: v ?1 0)?
polyform | polyform | 0.9 | polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) licen[sc]e(?: 1 0 0)?
prosperity | prosperity | 0.9 | prosperity public licen[sc]e(?: 3 0 0)?
parity | parity public | 0.9 | parity public licen[sc]e(?: 7 0 0)?
confluent | confluent community | 0.9 | confluent community licen[sc]e(?: agreement)?
redis | redis source available | 0.9 | redis source available licen[sc]e
jrl | java research | 0.9 | java research licen[sc]e
bcl | binary code | 0.9 | (?:sun|oracle) binary code licen[sc]e(?: agreement)?
nvidia | nvidia | 0.8 | nvidia software licen[sc]e(?: agreement)?
intel | intel | 0.8 | intel (?:simplified )?software licen[sc]e
terms | terms of | 0.4 | terms of (?:use|service) and licen[sc]e
licence-file | licen | 0.4 | see (?:the )?(?:accompanying )?licen[sc]e(?: txt| md)? file(?: for details)?
licence-file | found in the licen | 0.5 | (?:that )?can be found in the licen[sc]e file
copyright | copyright | 0.5 | copyright (?:c )?(?:19|20)[0-9]{2}
copyright | copyright by | 0.4 | (?:c )?copyright by [^ ]+
"""


def signature_rules() -> list[dict]:
    """All rules in order: the first ones have the higher priority among equal spans."""
    out: list[dict] = []

    def add(expression: str, keyword: str, label: str, priority: int, confidence: float) -> None:
        out.append({"pattern": f"(?<= ){expression}(?= )", "keyword": keyword, "label": label, "priority": priority, "confidence": confidence})

    for kind, words in CC_KINDS:
        label = "cc-" + kind.replace(" ", "-")
        for v in ["", *CC_VERSIONS]:
            end, tag, sure = (f" {v}", "-" + v.replace(" ", "."), 0.97) if v else ("", "", 0.85)
            add(f"cc {kind}{end}", "cc by", label + tag, 3 if v else 2, sure)
            add(f"creative commons attribution{words}{end}(?: international| unported| generic)?(?: public)?(?: {_L})?", "creative commons", label + tag, 3 if v else 2, sure)
            add(f"creativecommons org licenses {kind}{end}", "creativecommons", label + tag, 3 if v else 2, sure)
    for name, short, label, versions in GNU:
        for v in ["", *versions]:
            number = v.replace(" ", ".")
            zero = f"{v}(?: 0)?" if " " not in v else v
            if not v:
                add(f"(?:gnu )?{name} {_L}", name, label, 2, 0.85)
                add(f"(?:gnu )?{short}", short, label, 1, 0.6)
                continue
            tag = f"{label}-{number}"
            add(f"(?:gnu )?{name} {_L}(?: as published by the free software foundation either)? v(?:ersion)? ?{zero}(?: or(?: at your option)? any later version| or later| only)?", name, tag, 4, 0.97)
            add(f"version {zero} of the (?:gnu )?{name} {_L}", name, tag, 4, 0.97)
            add(f"(?:gnu )?{short} ?v?(?:ersion )?{zero}(?: or later| only)?", short, tag, 3, 0.9)
            add(f"spdx {_L} identifier {short} {zero}(?: or later| only)?", "spdx", tag, 5, 0.99)
            add(f"gnu org licenses (?:old licenses )?{short} {zero}", "gnu org", tag, 4, 0.95)
    for name, keyword, label, versions in NAMED:
        add(f"{name} (?:software |open source )?{_L}", keyword, label, 2, 0.85)
        add(f"(?:licensed under (?:the )?(?:terms of the )?{name}(?: {_L})?|(?:released|distributed|available|published|provided) under (?:the )?(?:terms of the )?{name} {_L})", keyword, label, 3, 0.9)
        add(f"spdx {_L} identifier {name}", "spdx", label, 4, 0.97)
        for v in versions:
            tag = label + "-" + v.replace(" ", ".")
            add(f"{name} (?:software )?{_L}(?: v(?:ersion)?)? ?{v}", keyword, tag, 4, 0.97)
            add(f"spdx {_L} identifier {name} {v}", "spdx", tag, 5, 0.99)
            if label in SHORT:
                add(f"spdx {_L} identifier {SHORT[label]} {v}", "spdx", tag, 5, 0.99)
        if label in SHORT:
            add(f"spdx {_L} identifier {SHORT[label]}", "spdx", label, 4, 0.97)
    for name, label in IDS:
        add(f"spdx {_L} identifier {name}", "spdx", label, 5, 0.99)
    for line in SIGNATURES.strip().split("\n"):
        if not line.startswith("#"):
            label, keyword, confidence, expression = line.split(" | ")
            add(expression, keyword, label, 2, float(confidence))
    return out


def rules_json() -> str:
    return json.dumps(signature_rules())
