"""Signatures of licenses over a text's lower-case words, written out one by one; tags of identifiers are made from a list."""

from __future__ import annotations

# Fixed values. Each line: label, confidence, words of the signature as a regular expression. A signature begins with a
# plain word, its keyword, which is none of those that most texts have; words that must come before it follow after "<".
# Those of more words win over those that they contain.
#: Names, heads and grants of each license, as notices and readme files word them.
NAMED = """
mit | 0.8 | mit licen[sc]ed?
mit | 0.9 | mit license(?: mit)? copyright
mit | 0.9 | mit < under (?:the )?
mit | 0.8 | expat license
mit | 0.9 | mit style licen[sc]e
mit | 1.0 | permission is hereby granted free of charge to any person obtaining a copy
mit-0 | 0.9 | mit no attribution
mit-0 | 0.9 | mit 0 license
x11 | 0.8 | x11 license
x11 | 0.9 | mit x11 license
isc | 0.8 | isc licen[sc]ed?
isc | 0.9 | isc < under (?:the )?
isc | 1.0 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd | 0.8 | permission to use copy modify and distribute this software and its documentation for any purpose
apache | 0.7 | apache licen[sc]ed?
apache | 0.7 | apache software license
apache-1.1 | 0.9 | apache(?: software)? license(?: version)? v?1 1
apache-2.0 | 0.95 | apache(?: software)? license(?: version)? v?2(?: 0)?
apache-2.0 | 0.95 | apache v?2(?: 0)? licen[sc]ed?
apache-2.0 | 0.9 | apache 2 0
apache-2.0 | 0.9 | apache license 2 0 january 2004
apache-2.0 | 1.0 | apache license version 2 0 the license you may not use this file except in compliance < licensed under the 
apache-2.0 | 0.9 | alv2 license
gpl | 0.7 | gnu general public license
gpl | 0.7 | gnu gpl
gpl | 0.7 | gpl licen[sc]ed?
gpl | 0.8 | gpl < released under (?:the )?(?:gnu )?
gpl | 0.8 | gpl < licensed under (?:the )?(?:gnu )?
gpl | 0.8 | gnu (?:gpl|general public license) < terms of the 
gpl-1.0 | 0.9 | gnu general public license(?: as published by the free software foundation)?(?: either)? version 1
gpl-2.0 | 0.9 | gnu general public license(?: as published by the free software foundation)?(?: either)? version 2
gpl-2.0 | 0.9 | gnu gpl(?: version)? v?2(?: 0)?
gpl-2.0 | 0.9 | gpl(?: version)? v?2(?: 0)?
gpl-2.0 | 0.9 | gplv2(?: 0)?
gpl-2.0 | 0.95 | gpl(?: version)? v?2(?: 0)? only
gpl-2.0 | 0.95 | gplv2(?: 0)? only
gpl-2.0 | 0.95 | gpl(?: version)? v?2(?: 0)? or (?:any )?(?:later|newer)
gpl-2.0 | 0.95 | gplv2(?: 0)? or (?:any )?(?:later|newer)
gpl-2.0 | 1.0 | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0 | 0.9 | gnu general public license(?: as published by the free software foundation)?(?: either)? version 3
gpl-3.0 | 0.9 | gnu gpl(?: version)? v?3(?: 0)?
gpl-3.0 | 0.9 | gpl(?: version)? v?3(?: 0)?
gpl-3.0 | 0.9 | gplv3(?: 0)?
gpl-3.0 | 0.95 | gpl(?: version)? v?3(?: 0)? only
gpl-3.0 | 0.95 | gplv3(?: 0)? only
gpl-3.0 | 0.95 | gpl(?: version)? v?3(?: 0)? or (?:any )?(?:later|newer)
gpl-3.0 | 0.95 | gplv3(?: 0)? or (?:any )?(?:later|newer)
gpl-3.0 | 1.0 | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-exception | 0.6 | classpath exception
gpl-exception | 0.6 | gcc runtime library exception
lgpl | 0.7 | gnu (?:lesser|library) general public license
lgpl | 0.7 | gnu lgpl
lgpl | 0.7 | lgpl licen[sc]ed?
lgpl-2.0 | 0.9 | gnu library general public license(?: as published by the free software foundation)?(?: either)? version 2
lgpl-2.1 | 0.9 | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 2 1
lgpl-2.1 | 0.9 | lgpl(?: version)? v?2 1
lgpl-2.1 | 0.9 | lgplv2 1
lgpl-2.1 | 0.95 | lgpl(?: version)? v?2 1 or (?:any )?(?:later|newer)
lgpl-2.1 | 1.0 | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0 | 0.9 | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 3
lgpl-3.0 | 0.9 | lgpl(?: version)? v?3(?: 0)?
lgpl-3.0 | 0.9 | lgplv3
agpl | 0.7 | gnu affero general public license
agpl | 0.7 | gnu agpl
agpl | 0.7 | agpl licen[sc]ed?
agpl | 0.7 | affero general public license
agpl-3.0 | 0.9 | gnu affero general public license(?: as published by the free software foundation)?(?: either)? version 3
agpl-3.0 | 0.9 | agpl(?: version)? v?3(?: 0)?
agpl-3.0 | 0.9 | agplv3
gfdl | 0.8 | gnu free documentation license
gfdl | 0.9 | gfdl licen[sc]ed?
bsd | 0.7 | bsd licen[sc]ed?
bsd | 0.7 | bsd style licen[sc]e
bsd | 0.8 | bsd < under (?:the )?
bsd | 1.0 | redistribution and use in source and binary forms with or without modification
bsd-2-clause | 0.9 | bsd 2 clause
bsd-2-clause | 0.9 | bsd two clause
bsd-2-clause | 0.9 | bsd < 2 clause 
bsd-2-clause | 0.9 | bsd < two clause 
bsd-2-clause | 0.9 | bsd < simplified 
bsd-2-clause | 0.9 | freebsd license
bsd-3-clause | 0.9 | bsd 3 clause
bsd-3-clause | 0.9 | bsd three clause
bsd-3-clause | 0.9 | bsd < 3 clause 
bsd-3-clause | 0.9 | bsd < three clause 
bsd-3-clause | 0.9 | bsd < new 
bsd-3-clause | 0.9 | bsd < revised 
bsd-3-clause | 0.9 | bsd < modified 
bsd-3-clause | 0.9 | contributors may be used to endorse < nor the names of its 
bsd-4-clause | 0.9 | bsd < original 
bsd-4-clause | 0.9 | bsd 4 clause
bsd-4-clause | 0.9 | advertising materials mentioning features or use of this software must display
0bsd | 0.9 | 0bsd licen[sc]ed?
0bsd | 0.9 | bsd < zero clause 
mpl | 0.7 | mozilla public licen[sc]e
mpl-1.1 | 0.95 | mozilla public license(?: version)? v?1 1
mpl-1.1 | 0.9 | mpl(?: version)? v?1 1
mpl-2.0 | 0.95 | mozilla public license(?: version)?(?: v)? v?2(?: 0)?
mpl-2.0 | 0.9 | mpl(?: version)? v?2(?: 0)?
mpl-2.0 | 1.0 | mozilla public license v 2 0 < subject to the terms of the 
epl | 0.7 | eclipse public licen[sc]e
epl-1.0 | 0.95 | eclipse public license(?: version)? v?1(?: 0)?
epl-1.0 | 0.9 | epl v?1 0
epl-2.0 | 0.95 | eclipse public license(?: version)? v?2(?: 0)?
epl-2.0 | 0.9 | epl v?2 0
edl-1.0 | 0.9 | eclipse distribution license
cddl | 0.8 | distribution license < common development and 
cddl-1.0 | 0.9 | distribution license(?: cddl)?(?: version)? v?1 0 < common development and 
cddl-1.0 | 0.9 | cddl v?1 0
cpl-1.0 | 0.8 | license < common public 
cpal-1.0 | 0.8 | attribution license < common public 
ipl-1.0 | 0.8 | ibm public license
apsl-2.0 | 0.8 | apple public source license
npl-1.1 | 0.8 | netscape public license
spl-1.0 | 0.8 | license < sun public 
qpl-1.0 | 0.8 | q public license
artistic | 0.8 | artistic licen[sc]e
artistic-1.0 | 0.9 | artistic license(?: version)? 1(?: 0)?
artistic-2.0 | 0.9 | artistic license(?: version)? 2(?: 0)?
perl | 0.8 | perl itself < same terms as 
bsl-1.0 | 0.9 | boost software license
bsl-1.0 | 1.0 | boost software license version 1 0 < distributed under the 
busl-1.1 | 0.8 | license < business source 
sspl-1.0 | 0.9 | license < server side public 
elastic-2.0 | 0.9 | elastic license(?: version)? v?2(?: 0)?
elastic | 0.7 | elastic license
zlib | 0.8 | zlib licen[sc]ed?
zlib | 0.9 | zlib libpng license
zlib | 0.9 | warranty in no event will the authors be held liable < without any express or implied 
libpng | 0.8 | libpng license
unlicense | 0.8 | unlicense licen[sc]e
unlicense | 0.9 | unlicense < the 
unlicense | 1.0 | unencumbered software released into the public domain
wtfpl | 0.9 | wtfpl licen[sc]ed?
wtfpl | 0.9 | license < what the fuck you want to public 
beerware | 0.8 | beerware license
ms-pl | 0.9 | microsoft public license
ms-rl | 0.9 | microsoft reciprocal license
eupl | 0.8 | european union public licen[sc]e
eupl-1.1 | 0.9 | european union public licen[sc]e(?: version)? v?1 1
eupl-1.2 | 0.9 | european union public licen[sc]e(?: version)? v?1 2
eupl-1.2 | 0.9 | eupl v?1 2
ofl-1.1 | 0.9 | sil open font license
ofl-1.1 | 0.9 | font license(?: version)? 1 1 < open 
python-2.0 | 0.9 | python software foundation license
python-2.0 | 0.8 | psf license
ruby | 0.8 | ruby licen[sc]e
php | 0.8 | php licen[sc]e
php-3.01 | 0.9 | php license(?: version)? 3 01
openssl | 0.8 | openssl licen[sc]e
postgresql | 0.8 | postgresql licen[sc]e
vim | 0.8 | vim licen[sc]e
curl | 0.8 | curl licen[sc]e
ncsa | 0.8 | illinois ncsa open source license
ncsa | 0.8 | ncsa licen[sc]e
w3c | 0.8 | w3c software (?:notice|license)
afl-3.0 | 0.8 | license < academic free 
osl-3.0 | 0.8 | license < open software 
rpl-1.5 | 0.8 | license < reciprocal public 
upl-1.0 | 0.8 | license < universal permissive 
lppl | 0.8 | latex project public license
mulanpsl-2.0 | 0.8 | mulan permissive software license
odbl | 0.8 | database license < open 
odbl | 0.9 | commons open database license < open data 
odc-by | 0.9 | commons attribution license < open data 
pddl | 0.9 | domain dedication and license < public 
cc0-1.0 | 0.9 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 0.9 | creative commons zero
cc-by | 0.9 | cc by(?: [1-4] [05])?
cc-by-sa | 0.9 | cc by sa(?: [1-4] [05])?
cc-by-nc | 0.9 | cc by nc(?: [1-4] [05])?
cc-by-nd | 0.9 | cc by nd(?: [1-4] [05])?
cc-by-nc-sa | 0.9 | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | 0.9 | cc by nc nd(?: [1-4] [05])?
cc-by | 0.8 | creative commons attribution(?: [1-4] [05])?(?: international)?(?: license)?
cc-by-sa | 0.9 | creative commons attribution share ?alike(?: [1-4] [05])?
cc-by-nc | 0.9 | creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nd | 0.9 | creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?
cc-by-nc-sa | 0.9 | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc-nd | 0.9 | creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?
creative-commons | 0.6 | creative commons licen[sc]ed?
"""
#: What tells of a license without a name of its own.
UNNAMED = """
public-domain | 0.6 | domain < public 
public-domain | 0.9 | domain < dedicated to the public 
public-domain | 0.9 | domain < released into the public 
proprietary | 0.5 | reserved < all rights 
proprietary | 0.8 | proprietary and confidential
proprietary | 0.8 | unauthorized copying of this file via any medium is strictly prohibited
copyright | 0.4 | copyright(?: c)? (?:19|20)[0-9][0-9]
copyleft | 0.3 | copyleft licen[sc]e
warranty | 0.4 | warranty of any kind < without 
warranty | 0.5 | warranty of any kind < software is provided as is without 
warranty | 0.4 | warranty of merchantability < without even the implied 
"""
#: Names after words that say they do not hold; such a signature is of higher priority and so suppresses the name.
DENIED = """
none | 0.0 | gnu (?:l|a)?gpl(?: licen[sc]ed?)? < not (?:licensed |released |available |distributed )?under (?:the )?(?:terms of the )?
none | 0.0 | gpl(?: licen[sc]ed?)? < not (?:licensed |released |available |distributed )?under (?:the )?(?:terms of the )?
none | 0.0 | mit(?: licen[sc]ed?)? < not (?:licensed |released |available |distributed )?under (?:the )?(?:terms of the )?
none | 0.0 | bsd(?: licen[sc]ed?)? < not (?:licensed |released |available |distributed )?under (?:the )?(?:terms of the )?
none | 0.0 | apache(?: licen[sc]ed?)? < not (?:licensed |released |available |distributed )?under (?:the )?(?:terms of the )?
none | 0.0 | incompatible with (?:the )?(?:gnu )?(?:gpl|agpl|lgpl|mit|bsd|isc|apache)(?: licen[sc]e)?
"""
#: Identifiers of the SPDX list; a tag is the words "spdx license identifier" and one of them, or several joined by and, or, with.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 "
    "CC-BY-SA-4.0 CC-BY-NC-4.0 CC0-1.0 CDDL-1.0 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 HPND ICU ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 "
    "Libpng LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0 "
    "TCL Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
#: What may stand before an identifier in a tag: the tag's own words, and other identifiers with what joins them.
TAG = r"spdx license identifier (?:(?:[a-z0-9]+ ){1,7}(?:or|and|with) )*"
FAMILIES = ("gpl", "lgpl", "agpl", "gfdl")


def spdx_rules() -> list[tuple[str, float, str, str]]:
    """(label, confidence, pattern, before) of each identifier in a tag; those of the GNU family with what follows them too."""
    found = []
    for ident in SPDX:
        label = ident.lower()
        words = label.replace("-", " ").replace(".", " ")
        found.append((label, 1.0, words, TAG))
        if label.split("-")[0] in FAMILIES:
            found += [(label, 1.0, f"{words} only", TAG), (label, 1.0, f"{words} or later", TAG)]
    return found


def written_rules(table: str) -> list[tuple[str, float, str, str]]:
    """(label, confidence, pattern, before) of each line of a table."""
    found = []
    for line in table.strip().splitlines():
        label, confidence, words = line.split(" | ", 2)
        pattern, _, before = words.partition(" < ")
        before = before.rstrip()  # a word is followed by a space; a group that may be absent has its own
        found.append((label, float(confidence), pattern, before + " " * (before != "" and not before.endswith(")?"))))
    return found
