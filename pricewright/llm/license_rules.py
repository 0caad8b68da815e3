"""Signatures of licences, one rule a line: label | priority | keyword | pattern.

Patterns are regular expressions over the words of a text, lower-case and one blank apart, with punctuation gone, and
match from word border to word border; ``_`` stands for up to three words that may stand between.  A rule is tried
only on texts that hold its keyword, which is part of every match.  Priorities: 9 identifiers and
sentences of the licence itself, 7 a name with its version, 5 a name, 3 a short form, 1 (``HINT``) a hint
that names no licence and stands only where nothing else is found.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_VERSION = r"(?:version |v|ver )?"
_LICENCE = r"licen[sc]es?"
HINT = 1


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


_TEXT = r"""
mit | 9 | spdx license identifier mit | spdx license identifier mit
mit | 9 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 7 | the mit licen | (?:under|by|with)(?: the terms of)? the mit LICENCE
mit | 5 | mit licen | mit LICENCE
mit | 5 | expat licen | expat LICENCE
mit | 3 | license mit | license mit
mit-0 | 9 | spdx license identifier mit 0 | spdx license identifier mit 0
mit-0 | 7 | mit no attribution | mit no attribution(?: LICENCE)?
x11 | 5 | x11 licen | x11 LICENCE
x11 | 5 | mit x11 | mit x11(?: LICENCE)?
apache-2 | 9 | spdx license identifier apache 2 0 | spdx license identifier apache 2 0
apache-2 | 9 | you may not use this file except in compliance with the license | you may not use this file except in compliance with the license
apache-2 | 9 | www apache org licenses license 2 0 | www apache org licenses license 2 0
apache-2 | 7 | apache license | apache license (?:version |v|ver )?2(?: 0)?
apache-2 | 7 | apache software license | apache software license (?:version |v)?2(?: 0)?
apache-2 | 7 | apache 2 0 | apache 2 0(?: LICENCE)?
apache-2 | 3 | apache2 | apache2(?: LICENCE)?
apache-2 | 3 | apache v2 | apache v2(?: LICENCE)?
apache-1.1 | 9 | spdx license identifier apache 1 1 | spdx license identifier apache 1 1
apache-1.1 | 7 | apache software license | apache software license (?:version |v)?1 1
apache-1.0 | 7 | apache software license | apache software license (?:version |v)?1 0
apache | 5 | apache licen | apache LICENCE
apache | 5 | apache software licen | apache software LICENCE
gpl-1 | 7 | gnu general public license | gnu general public license (?:version |v)1(?: 0)?
gpl-2 | 9 | spdx license identifier gpl 2 0 | spdx license identifier gpl 2 0(?: only)?
gpl-2-or-later | 9 | spdx license identifier gpl 2 0 or later | spdx license identifier gpl 2 0 or later
gpl-2-or-later | 9 | either version 2 of the license or | either version 2 of the license or at your option any later version
gpl-2 | 7 | gnu general public licen | gnu general public LICENCE _ (?:version |v)2(?: 0)?
gpl-2 | 7 | gpl version 2 | gpl version 2(?: 0)?
gpl-2 | 7 | gpl v2 | gpl v2(?: 0)?
gpl-2 | 3 | gplv2 | gplv2
gpl-2 | 3 | gpl 2 0 | gpl 2 0(?: only)?
gpl-3 | 9 | spdx license identifier gpl 3 0 | spdx license identifier gpl 3 0(?: only)?
gpl-3-or-later | 9 | spdx license identifier gpl 3 0 or later | spdx license identifier gpl 3 0 or later
gpl-3-or-later | 9 | either version 3 of the license or | either version 3 of the license or at your option any later version
gpl-3 | 7 | gnu general public licen | gnu general public LICENCE _ (?:version |v)3(?: 0)?
gpl-3 | 7 | gpl version 3 | gpl version 3(?: 0)?
gpl-3 | 7 | gpl v3 | gpl v3(?: 0)?
gpl-3 | 3 | gplv3 | gplv3
gpl-3 | 3 | gpl 3 0 | gpl 3 0(?: only)?
gpl | 9 | gnu general public license as published by | gnu general public license as published by the free software foundation
gpl | 5 | gnu general public licen | gnu general public LICENCE
gpl | 5 | gnu gpl | gnu gpl
gpl | 5 | under the gpl | under the gpl
gpl | 5 | gpl licen | gpl licen[sc]ed?
lgpl-2 | 9 | spdx license identifier lgpl 2 0 | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2 | 7 | gnu library general public license | gnu library general public license(?: (?:version |v)2(?: 0)?)?
lgpl-2.1 | 9 | spdx license identifier lgpl 2 1 | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 | 7 | gnu lesser general public licen | gnu lesser general public LICENCE _ (?:version |v)2 1
lgpl-2.1 | 7 | lgpl v2 1 | lgpl v2 1
lgpl-2.1 | 7 | lgpl version 2 1 | lgpl version 2 1
lgpl-2.1 | 3 | lgplv2 1 | lgplv2 1
lgpl-2.1 | 3 | lgpl 2 1 | lgpl 2 1
lgpl-3 | 9 | spdx license identifier lgpl 3 0 | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3 | 7 | gnu lesser general public licen | gnu lesser general public LICENCE _ (?:version |v)3(?: 0)?
lgpl-3 | 7 | lgpl v3 | lgpl v3
lgpl-3 | 7 | lgpl version 3 | lgpl version 3
lgpl-3 | 3 | lgplv3 | lgplv3
lgpl-3 | 3 | lgpl 3 0 | lgpl 3 0
lgpl | 5 | lesser general public licen | (?:gnu )?lesser general public LICENCE
lgpl | 5 | gnu lgpl | gnu lgpl
lgpl | 5 | under the lgpl | under the lgpl
agpl-3 | 9 | spdx license identifier agpl 3 0 | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 | 7 | affero general public licen | (?:gnu )?affero general public LICENCE _ (?:version |v)3(?: 0)?
agpl-3 | 7 | agpl v3 | agpl v3
agpl-3 | 3 | agplv3 | agplv3
agpl-3 | 3 | agpl 3 0 | agpl 3 0
agpl | 5 | affero general public licen | (?:gnu )?affero general public LICENCE
agpl | 5 | under the agpl | under the agpl
gfdl-1.3 | 9 | spdx license identifier gfdl 1 3 | spdx license identifier gfdl 1 3(?: only| or later)?
gfdl-1.3 | 7 | gnu free documentation licen | gnu free documentation LICENCE _ (?:version |v)1 3
gfdl-1.2 | 7 | gnu free documentation licen | gnu free documentation LICENCE _ (?:version |v)1 2
gfdl | 5 | gnu free documentation licen | gnu free documentation LICENCE
gfdl | 3 | gfdl | gfdl
bsd-2 | 9 | spdx license identifier bsd 2 clause | spdx license identifier bsd 2 clause
bsd-2 | 7 | bsd 2 clause | bsd 2 clause(?: LICENCE)?
bsd-2 | 7 | 2 clause bsd | 2 clause bsd(?: LICENCE)?
bsd-2 | 7 | two clause bsd | two clause bsd(?: LICENCE)?
bsd-2 | 7 | simplified bsd | simplified bsd(?: LICENCE)?
bsd-2 | 5 | freebsd licen | freebsd LICENCE
bsd-3 | 9 | spdx license identifier bsd 3 clause | spdx license identifier bsd 3 clause
bsd-3 | 9 | may be used to endorse or promote products derived from this software | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3 | 7 | bsd 3 clause | bsd 3 clause(?: LICENCE)?
bsd-3 | 7 | 3 clause bsd | 3 clause bsd(?: LICENCE)?
bsd-3 | 7 | three clause bsd | three clause bsd(?: LICENCE)?
bsd-3 | 7 | new bsd licen | new bsd LICENCE
bsd-3 | 7 | modified bsd licen | modified bsd LICENCE
bsd-3 | 7 | revised bsd licen | revised bsd LICENCE
bsd-4 | 9 | all advertising materials mentioning features or use of this software | all advertising materials mentioning features or use of this software must display
bsd-4 | 7 | bsd 4 clause | bsd 4 clause(?: LICENCE)?
bsd-4 | 7 | original bsd licen | original bsd LICENCE
bsd-0 | 9 | spdx license identifier 0bsd | spdx license identifier 0bsd
bsd-0 | 7 | zero clause bsd | (?:bsd )?zero clause bsd(?: LICENCE)?
bsd | 9 | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification
bsd | 5 | bsd licen | bsd LICENCE
bsd | 5 | bsd style licen | bsd style LICENCE
isc | 9 | spdx license identifier isc | spdx license identifier isc
isc | 9 | permission to use copy modify and or distribute this software | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 5 | isc licen | isc LICENCE
mpl-1.0 | 7 | mozilla public licen | mozilla public LICENCE _ (?:version |v)1 0
mpl-1.1 | 9 | spdx license identifier mpl 1 1 | spdx license identifier mpl 1 1
mpl-1.1 | 7 | mozilla public licen | mozilla public LICENCE _ (?:version |v)1 1
mpl-1.1 | 3 | mpl 1 1 | mpl 1 1
mpl-2 | 9 | spdx license identifier mpl 2 0 | spdx license identifier mpl 2 0
mpl-2 | 9 | subject to the terms of the mozilla public license | subject to the terms of the mozilla public license v 2 0
mpl-2 | 7 | mozilla public licen | mozilla public LICENCE _ (?:version |v)2(?: 0)?
mpl-2 | 3 | mpl 2 0 | mpl 2 0
mpl | 5 | mozilla public licen | mozilla public LICENCE
epl-1 | 9 | spdx license identifier epl 1 0 | spdx license identifier epl 1 0
epl-1 | 7 | eclipse public licen | eclipse public LICENCE _ (?:version |v)1(?: 0)?
epl-2 | 9 | spdx license identifier epl 2 0 | spdx license identifier epl 2 0
epl-2 | 7 | eclipse public licen | eclipse public LICENCE _ (?:version |v)2(?: 0)?
epl | 5 | eclipse public licen | eclipse public LICENCE
edl-1 | 7 | eclipse distribution licen | eclipse distribution LICENCE(?: _ (?:version |v)1 0)?
cddl-1 | 9 | spdx license identifier cddl 1 | spdx license identifier cddl 1 [01]
cddl-1 | 7 | common development and distribution licen | common development and distribution LICENCE(?: _ (?:version |v)?1 [01])?
cddl | 3 | cddl | cddl
cpl-1 | 7 | common public licen | common public LICENCE(?: _ (?:version |v)?1 0)?
ipl-1 | 7 | ibm public licen | ibm public LICENCE(?: _ (?:version |v)?1 0)?
eupl-1.1 | 7 | european union public licen | european union public LICENCE _ (?:version |v)?1 1
eupl-1.2 | 9 | spdx license identifier eupl 1 2 | spdx license identifier eupl 1 2
eupl-1.2 | 7 | european union public licen | european union public LICENCE _ (?:version |v)?1 2
eupl | 5 | european union public licen | european union public LICENCE
eupl | 3 | eupl | eupl
artistic-1 | 7 | artistic licen | artistic LICENCE (?:version |v)?1(?: 0)?
artistic-2 | 9 | spdx license identifier artistic 2 0 | spdx license identifier artistic 2 0
artistic-2 | 7 | artistic licen | artistic LICENCE (?:version |v)?2(?: 0)?
artistic | 5 | artistic licen | artistic LICENCE
perl | 7 | same terms as perl itself | under the same terms as perl itself
bsl-1 | 9 | spdx license identifier bsl 1 0 | spdx license identifier bsl 1 0
bsl-1 | 7 | boost software licen | boost software LICENCE(?: (?:version |v)?1 0)?
busl-1.1 | 9 | spdx license identifier busl 1 1 | spdx license identifier busl 1 1
busl-1.1 | 7 | business source licen | business source LICENCE(?: (?:version |v)?1 1)?
zlib | 9 | spdx license identifier zlib | spdx license identifier zlib
zlib | 9 | this software is provided as is without any express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 5 | zlib licen | zlib LICENCE
zlib | 5 | zlib libpng | zlib libpng(?: LICENCE)?
libpng | 5 | libpng licen | libpng LICENCE
unlicense | 9 | spdx license identifier unlicense | spdx license identifier unlicense
unlicense | 9 | free and unencumbered software released into the public domain | this is free and unencumbered software released into the public domain
unlicense | 5 | the unlicense | the unlicense
wtfpl | 7 | do what the fuck you want to public licen | do what the fuck you want to public LICENCE
wtfpl | 3 | wtfpl | wtfpl
python-2 | 9 | spdx license identifier python 2 0 | spdx license identifier python 2 0
python-2 | 7 | python software foundation licen | python software foundation LICENCE(?: (?:version |v)?2)?
python-2 | 3 | psf licen | psf LICENCE
php-3 | 7 | php licen | php LICENCE(?: (?:version |v)?3(?: 0(?: 1)?)?)?
ruby | 5 | ruby licen | ruby LICENCE
postgresql | 5 | postgresql licen | postgresql LICENCE
openssl | 5 | openssl licen | openssl LICENCE
curl | 5 | curl licen | curl LICENCE
w3c | 7 | w3c software | w3c software (?:and document )?(?:notice and )?LICENCE
ncsa | 7 | university of illinois | university of illinois (?:ncsa )?open source LICENCE
ncsa | 3 | ncsa licen | ncsa LICENCE
afl-3 | 7 | academic free licen | academic free LICENCE (?:version |v)?3 0
afl | 5 | academic free licen | academic free LICENCE
osl-3 | 7 | open software licen | open software LICENCE (?:version |v)?3 0
osl | 5 | open software licen | open software LICENCE
ms-pl | 7 | microsoft public licen | microsoft public LICENCE
ms-pl | 3 | ms pl | ms pl
ms-rl | 7 | microsoft reciprocal licen | microsoft reciprocal LICENCE
ofl-1.1 | 9 | spdx license identifier ofl 1 1 | spdx license identifier ofl 1 1
ofl-1.1 | 7 | sil open font licen | sil open font LICENCE(?: (?:version |v)?1 1)?
ofl-1.1 | 5 | open font licen | open font LICENCE
sspl-1 | 9 | spdx license identifier sspl 1 0 | spdx license identifier sspl 1 0
sspl-1 | 7 | server side public licen | server side public LICENCE(?: (?:version |v)?1)?
elastic-2 | 7 | elastic licen | elastic LICENCE(?: (?:version |v)?2(?: 0)?)?
ecl-2 | 7 | educational community licen | educational community LICENCE(?: (?:version |v)?2 0)?
cecill-2.1 | 7 | cecill | cecill (?:free software )?(?:licen[sc]e )?(?:agreement )?(?:version |v)?2 1
cecill-b | 5 | cecill b | cecill b(?: LICENCE)?
cecill-c | 5 | cecill c | cecill c(?: LICENCE)?
cecill | 3 | cecill | cecill
mulan-2 | 7 | mulan permissive software licen | mulan permissive software LICENCE(?: (?:version |v)?2)?
upl-1 | 7 | universal permissive licen | universal permissive LICENCE(?: (?:version |v)?1 0)?
unicode | 7 | unicode licen | unicode LICENCE(?: agreement)?
vim | 5 | vim licen | vim LICENCE
beerware | 5 | beer ware licen | beer ware LICENCE
beerware | 5 | beerware licen | beerware LICENCE
json | 9 | shall be used for good not evil | the software shall be used for good not evil
sleepycat | 5 | sleepycat licen | sleepycat LICENCE
qpl-1 | 7 | q public licen | q public LICENCE(?: (?:version |v)?1 0)?
lppl-1.3 | 7 | latex project public licen | latex project public LICENCE(?: (?:version |v)?1 3[abc]?)?
odbl-1 | 9 | spdx license identifier odbl 1 0 | spdx license identifier odbl 1 0
odbl-1 | 7 | open database licen | (?:open data commons )?open database LICENCE(?: (?:version |v)?1 0)?
odbl-1 | 3 | odbl | odbl
odc-by-1 | 7 | open data commons attribution licen | open data commons attribution LICENCE(?: (?:version |v)?1 0)?
odc-by-1 | 3 | odc by | odc by
pddl-1 | 7 | public domain dedication and licen | (?:open data commons )?public domain dedication and LICENCE
cdla-permissive | 7 | community data license agreement permissive | community data license agreement permissive(?: (?:version |v)?[12] 0)?
cdla-sharing | 7 | community data license agreement sharing | community data license agreement sharing(?: (?:version |v)?1 0)?
ogl-3 | 7 | open government licen | open government LICENCE (?:version |v)?3(?: 0)?
ogl | 5 | open government licen | open government LICENCE
etalab-2 | 7 | licence ouverte | licence ouverte(?: open licence)?(?: (?:version |v)?2 0)?
cc0-1 | 9 | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0
cc0-1 | 9 | spdx license identifier cc0 1 0 | spdx license identifier cc0 1 0
cc0-1 | 7 | cc0 1 0 | cc0 1 0(?: universal)?
cc0-1 | 5 | cc0 | cc0(?: LICENCE)?
cc0-1 | 7 | creative commons zero | creative commons zero(?: (?:version |v)?1 0)?
cc-by | 7 | creative commons attribution | creative commons attribution(?: LICENCE)?
cc-by | 5 | licensed under cc by | licensed under cc by(?! (?:nc|sa|nd|[0-9]) )
cc-by-4 | 9 | creativecommons org licenses by 4 0 | creativecommons org licenses by 4 0
cc-by-4 | 9 | spdx license identifier cc by 4 0 | spdx license identifier cc by 4 0
cc-by-4 | 7 | cc by 4 0 | cc by 4 0
cc-by-4 | 7 | creative commons attribution 4 0 | creative commons attribution 4 0(?: international)?(?: LICENCE)?
cc-by-3 | 9 | creativecommons org licenses by 3 0 | creativecommons org licenses by 3 0
cc-by-3 | 7 | cc by 3 0 | cc by 3 0
cc-by-3 | 7 | creative commons attribution 3 0 | creative commons attribution 3 0(?: unported)?(?: LICENCE)?
cc-by-2 | 7 | cc by 2 | cc by 2 [05]
cc-by-sa | 7 | creative commons attribution share | creative commons attribution share ?alike(?: LICENCE)?
cc-by-sa | 5 | cc by sa | cc by sa
cc-by-sa-4 | 9 | creativecommons org licenses by sa 4 0 | creativecommons org licenses by sa 4 0
cc-by-sa-4 | 7 | cc by sa 4 0 | cc by sa 4 0
cc-by-sa-4 | 7 | creative commons attribution share | creative commons attribution share ?alike 4 0(?: international)?(?: LICENCE)?
cc-by-sa-3 | 9 | creativecommons org licenses by sa 3 0 | creativecommons org licenses by sa 3 0
cc-by-sa-3 | 7 | cc by sa 3 0 | cc by sa 3 0
cc-by-sa-3 | 7 | creative commons attribution share | creative commons attribution share ?alike 3 0(?: unported)?(?: LICENCE)?
cc-by-nd | 5 | cc by nd | cc by nd
cc-by-nd-4 | 9 | creativecommons org licenses by nd 4 0 | creativecommons org licenses by nd 4 0
cc-by-nd-4 | 7 | cc by nd 4 0 | cc by nd 4 0
cc-by-nc | 7 | creative commons attribution non | creative commons attribution non ?commercial(?: LICENCE)?
cc-by-nc | 5 | cc by nc | cc by nc
cc-by-nc-4 | 9 | creativecommons org licenses by nc 4 0 | creativecommons org licenses by nc 4 0
cc-by-nc-4 | 7 | cc by nc 4 0 | cc by nc 4 0
cc-by-nc-4 | 7 | creative commons attribution non | creative commons attribution non ?commercial 4 0(?: international)?(?: LICENCE)?
cc-by-nc-3 | 7 | cc by nc 3 0 | cc by nc 3 0
cc-by-nc-sa | 7 | creative commons attribution non | creative commons attribution non ?commercial share ?alike(?: LICENCE)?
cc-by-nc-sa | 5 | cc by nc sa | cc by nc sa
cc-by-nc-sa-4 | 9 | creativecommons org licenses by nc sa 4 0 | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-4 | 7 | cc by nc sa 4 0 | cc by nc sa 4 0
cc-by-nc-sa-3 | 7 | cc by nc sa 3 0 | cc by nc sa 3 0
cc-by-nc-nd | 7 | creative commons attribution non | creative commons attribution non ?commercial no ?derivatives(?: LICENCE)?
cc-by-nc-nd | 5 | cc by nc nd | cc by nc nd
cc-by-nc-nd-4 | 9 | creativecommons org licenses by nc nd 4 0 | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-4 | 7 | cc by nc nd 4 0 | cc by nc nd 4 0
cc | 3 | creative commons | creative commons LICENCE
cc | 3 | creativecommons org | creativecommons org
rail-m | 7 | openrail m | (?:bigscience |creativeml )?openrail m(?: LICENCE)?
rail | 5 | responsible ai licen | responsible ai LICENCE
public-domain | 9 | has been dedicated to the public domain | (?:work )?has been dedicated to the public domain
public-domain | 7 | released into the public domain | released into the public domain
public-domain | 5 | in the public domain | in the public domain
public-domain | 3 | public domain | public domain
all-rights-reserved | 7 | all rights reserved | (?:copyright|c) (?:[0-9]{4} )?(?:[^ ]+ ){0,6}all rights reserved
all-rights-reserved | 5 | all rights reserved | all rights reserved
all-rights-reserved | 5 | alle rechte vorbehalten | alle rechte vorbehalten
all-rights-reserved | 5 | tous droits réservés | tous droits réservés
all-rights-reserved | 5 | todos los derechos reservados | todos los derechos reservados
proprietary | 7 | proprietary and confidential | proprietary and confidential
proprietary | 7 | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
proprietary | 5 | may not be reproduced | may not be reproduced (?:[^ ]+ ){0,6}without (?:the )?(?:prior )?(?:express )?(?:written )?permission
proprietary | 5 | end user licen | end user LICENCE agreement
proprietary | 5 | proprietary licen | proprietary LICENCE
non-commercial | 5 | for non commercial use only | for non commercial use only
non-commercial | 5 | for personal use only | for personal use only
non-commercial | 5 | noncommercial use | (?:for )?noncommercial use(?: only)?
research-only | 5 | for research purposes only | for research purposes only
research-only | 5 | research use only | (?:for )?research use only
unknown-license | 1 | licensed under | licensed under (?:the )?(?:terms of )?(?:the )?[^ ]+
unknown-license | 1 | released under | released under (?:the )?(?:terms of )?(?:the )?(?:[^ ]+ ){1,4}LICENCE
unknown-license | 1 | spdx license identifier | spdx license identifier [^ ]+
unknown-license | 1 | see the license | see the license for the specific language governing permissions
unknown-license | 1 | terms of the licen | terms of the LICENCE
copyright | 1 | copyright | copyright (?:c )?[0-9]{4}
"""


def _rules(text: str) -> tuple[Rule, ...]:
    found = []
    for line in text.strip().splitlines():
        label, priority, keyword, pattern = (x.strip() for x in line.split(" | "))
        pattern = pattern.replace("LICENCE", _LICENCE).replace("(?:version |v|ver )?", _VERSION).replace(" _ ", r" (?:[^ ]+ ){0,3}?")
        found.append(Rule(label, int(priority), keyword, pattern))
    return tuple(found)


RULES = _rules(_TEXT)

# Fixed by the contract of the query: label and phrase of what is always reported.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))


def compiled(pattern: str) -> re.Pattern:
    """The pattern over UTF-8, from word border to word border."""
    return re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )")
