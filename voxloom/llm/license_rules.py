"""The signature rules of the licence scan.

One rule a line: label, priority, score, keyword and expression. Expressions read lower-case words joined by single blanks; the keyword
stands in every text that the expression matches. Priorities: 4 sentences of licence texts and notices, and identifiers; 3 grants under a
named licence; 2 addresses; 1 names; 0 mentions. {v} stands for an optional word for "version", {under} for the verbs of a grant.
"""

from __future__ import annotations

VERSION = "(?: version| v)?"
UNDER = "(?:licensed|released|distributed|published|provided|available|covered)(?: to you)? under (?:the )?(?:terms of )?(?:the |a |an )?"

SENTENCES = """
agpl-3.0 | 4 | 1.0 | affero | under the terms of the gnu affero general public license as published by the free software foundation{v} 3
agpl | 4 | 0.95 | affero | you should have received a copy of the gnu affero general public license along with this program
agpl | 4 | 0.95 | remotely | your modified version must prominently offer all users interacting with it remotely
apache-2.0 | 4 | 1.0 | compliance | you may not use this file except in compliance with the license
apache-2.0 | 4 | 1.0 | apache | licensed under the apache license{v} 2 0 the license
apache-2.0 | 4 | 1.0 | contributor | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0 | 4 | 0.9 | agreed | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-1.1 | 4 | 0.95 | acknowledgment | this product includes software developed by the apache software foundation(?: http www apache org)? alternately this acknowledgment
artistic | 4 | 0.95 | artistic | you may distribute under the terms of either the gnu general public license or the artistic license
artistic-2.0 | 4 | 0.95 | standard version | you are permitted to use the standard version and create and use modified versions for any purpose without restriction|you may distribute verbatim copies of the source form of the standard version of this package
beerware | 4 | 1.0 | beer | if we meet some day and you think this stuff is worth it you can buy me a beer in return
blueoak-1.0.0 | 4 | 0.95 | contributor | each contributor licenses you to do everything with this software that would otherwise infringe
bsd | 4 | 0.95 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 4 | 0.9 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 4 | 0.9 | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd-3-clause | 4 | 0.95 | endorse | neither the name of [a-z0-9 ]{1,60}nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | 4 | 0.95 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledg?ement
bsl-1.0 | 4 | 1.0 | obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
busl-1.1 | 4 | 0.95 | licensor | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
cc0-1.0 | 4 | 1.0 | waived | has waived all copyright and related or neighboring rights
cc0-1.0 | 4 | 0.95 | deed | the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0 | 4 | 0.95 | cc0 | to the extent possible under law [a-z0-9 ]{1,60}cc0
cc-by-4.0 | 4 | 1.0 | creative | this work is licensed under (?:a |the )?creative commons attribution 4 0 international(?: license)?
cc-by-nc-4.0 | 4 | 1.0 | creative | this work is licensed under (?:a |the )?creative commons attribution non ?commercial 4 0 international(?: license)?
cc-by-sa-4.0 | 4 | 1.0 | creative | this work is licensed under (?:a |the )?creative commons attribution share ?alike 4 0 international(?: license)?
cc-by-nd-4.0 | 4 | 1.0 | creative | this work is licensed under (?:a |the )?creative commons attribution no ?deriv(?:ative|atives|s) 4 0 international(?: license)?
cc-by-nc-sa-4.0 | 4 | 1.0 | creative | this work is licensed under (?:a |the )?creative commons attribution non ?commercial share ?alike 4 0 international(?: license)?
cc-by-nc-nd-4.0 | 4 | 1.0 | creative | this work is licensed under (?:a |the )?creative commons attribution non ?commercial no ?deriv(?:ative|atives|s) 4 0 international(?: license)?
cddl-1.0 | 4 | 1.0 | development | the contents of this file are subject to the terms of the common development and distribution license
cecill | 4 | 0.95 | cecill | this software is governed by the cecill(?: [abc])? license under french law
cpl-1.0 | 4 | 0.95 | common public | this program and the accompanying materials are made available under the terms of the common public license
elastic-2.0 | 4 | 0.95 | managed | you may not provide the software to third parties as a hosted or managed service
epl-1.0 | 4 | 1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license{v} 1 0
epl-2.0 | 4 | 1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license{v} 2 0
eupl-1.2 | 4 | 0.95 | eupl | licensed under the eupl(?:{v} 1 2)?
gfdl | 4 | 1.0 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gpl | 4 | 0.95 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0-or-later | 4 | 1.0 | version 2 | gnu general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version
gpl-3.0-or-later | 4 | 1.0 | version 3 | gnu general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
gpl-2.0-only | 4 | 1.0 | version 2 | gnu general public license version 2 (?:only )?as published by the free software foundation
gpl | 4 | 0.95 | received | you should have received a copy of the gnu general public license along with this program
gpl | 4 | 0.85 | warranty | this program is distributed in the hope that it will be useful but without any warranty
gpl | 4 | 0.9 | copyleft | the gnu general public license is a free copyleft license for software
hpnd | 4 | 0.9 | supporting | that both that copyright notice and this permission notice appear in supporting documentation
icu | 4 | 0.9 | appear | provided that the above copyright notice s and this permission notice appear in all copies of the software
isc | 4 | 1.0 | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
jpeg | 4 | 0.9 | jpeg | this software is based in part on the work of the independent jpeg group
json | 4 | 1.0 | evil | the software shall be used for good not evil
lgpl | 4 | 0.95 | redistribute | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl-2.1-or-later | 4 | 1.0 | version 2 1 | lesser general public license as published by the free software foundation either version 2 1 of the license or(?: at your option)? any later version
lgpl-3.0-or-later | 4 | 1.0 | version 3 | lesser general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
lgpl | 4 | 0.95 | received | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)
libpng | 4 | 0.95 | png | this copy of the libpng notices is provided for your convenience|the png reference library is supplied as is
lppl | 4 | 0.95 | latex | this work may be distributed and or modified under the conditions of the latex project public license
mit | 4 | 1.0 | hereby | permission is hereby granted free of charge to any person obtaining a copy
mit | 4 | 0.95 | shall be | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 4 | 0.85 | infringement | fitness for a particular purpose and non ?infringement in no event shall the authors or copyright holders be liable|the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit-0 | 4 | 1.0 | furnished | to permit persons to whom the software is furnished to do so the software is provided as is
mpl-1.1 | 4 | 1.0 | mozilla | the contents of this file are subject to the mozilla public license{v} 1 1
mpl-2.0 | 4 | 1.0 | mozilla | this source code form is subject to the terms of the mozilla public license{v} 2 0
mpl-2.0 | 4 | 0.9 | secondary | this source code form is incompatible with secondary licenses as defined by the mozilla public license
ms-pl | 4 | 0.95 | microsoft | this software is (?:licensed|released|distributed) under the microsoft public license
npl | 4 | 0.95 | netscape | the contents of this file are subject to the netscape public license
ofl-1.1 | 4 | 1.0 | font | this font software is licensed under the sil open font license
ofl-1.1 | 4 | 0.9 | font | the font software may be sold as part of a larger software package|fonts? may not be sold by itself
openssl | 4 | 0.95 | openssl | this product includes software developed by the openssl project
php-3.01 | 4 | 0.95 | php | this source file is subject to version 3 0?1 of the php license
postgresql | 4 | 0.9 | written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
public-domain | 4 | 0.9 | disclaim | the authors? (?:hereby )?disclaims? copyright to this source code
public-domain | 4 | 0.9 | domain | i the copyright holder of this work (?:hereby )?release this work into the public domain
python-2.0 | 4 | 0.95 | psf | psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly
qpl-1.0 | 4 | 0.9 | q public | this file is part of [a-z0-9 ]{1,40}and may be distributed under the terms of the q public license
sspl-1.0 | 4 | 0.95 | server side | under the terms of the server side public license{v} 1
unicode | 4 | 0.9 | unicode | unicode data files and software provided under the unicode terms of use|distributed under the terms of use in http www unicode org copyright html
unlicense | 4 | 1.0 | unencumbered | this is free and unencumbered software released into the public domain
vim | 4 | 0.9 | vim | there are no restrictions on distributing unmodified copies of vim
w3c | 4 | 0.95 | w3c | copyright(?: c)? (?:19|20)[0-9]{2} w3c|this work is being provided by the copyright holders under the w3c
wtfpl | 4 | 1.0 | what the | you just do what the f[a-z]{1,6} you want to
zlib | 4 | 0.95 | misrepresented | the origin of this software must not be misrepresented
zlib | 4 | 0.9 | plainly | altered source versions must be plainly marked as such
proprietary | 2 | 0.7 | proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | 2 | 0.6 | permission | without (?:the )?(?:express |prior )*(?:written )?permission
proprietary | 2 | 0.6 | consent | without (?:the )?(?:express |prior )*(?:written )?consent
proprietary | 2 | 0.7 | trade | (?:contains|constitutes) (?:confidential |proprietary )*trade secrets? (?:and|or) (?:may not|must not) be|trade secret information copyright
proprietary | 2 | 0.7 | reproduc | no part of this (?:publication|book|work|document) may be reproduced|unauthori[sz]ed reproduction (?:or|and) (?:distribution|use)
copyright | 1 | 0.4 | copyright | copyright(?: c)? (?:19|20)[0-9]{2}
copyright | 1 | 0.4 | copyright | copyright(?: c)? by [a-z]+
copyright | 0 | 0.3 | copyright | all copyrights? (?:is|are) reserved|subject to copyright|protected by copyright(?: law)?
license-mention | 0 | 0.2 | licensed | licensed under
license-mention | 0 | 0.2 | license | see (?:the )?(?:file )?license(?: txt| md| file)? (?:for|in) (?:more |the |full )?(?:details|information|project root)
"""

GRANTS = """
agpl-3.0 | 3 | 0.95 | affero | {under}(?:gnu )?affero general public license{v} 3(?: 0)?
agpl | 3 | 0.95 | affero | {under}(?:gnu )?affero general public license
apache-2.0 | 3 | 0.95 | apache | {under}apache(?: software)? license{v} 2(?: 0)?
apache-2.0 | 3 | 0.95 | apache 2 | {under}apache 2(?: 0)?(?: license)?
apache | 3 | 0.95 | apache | {under}apache(?: software)? license
artistic | 3 | 0.95 | artistic | {under}(?:perl |clarified )?artistic license
bsd-2-clause | 3 | 0.95 | bsd | {under}(?:(?:2|two) clause bsd|bsd 2 clause|simplified bsd)(?: licen[sc]e)?
bsd-3-clause | 3 | 0.95 | bsd | {under}(?:(?:3|three) clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd | 3 | 0.95 | bsd | {under}bsd(?: style)? licen[sc]e
bsl-1.0 | 3 | 0.95 | boost | {under}boost software license{v}(?: 1 0)?
busl-1.1 | 3 | 0.95 | business | {under}business source license{v}(?: 1 1)?
cc-by-2.0 | 3 | 0.95 | 2 0 | {under}(?:cc by|creative commons attribution) 2 0
cc-by-3.0 | 3 | 0.95 | 3 0 | {under}(?:cc by|creative commons attribution) 3 0
cc-by-4.0 | 3 | 0.95 | 4 0 | {under}(?:cc by|creative commons attribution) 4 0
cc-by-sa | 3 | 0.95 | sa | {under}cc by sa(?: [234] [05])?
cc-by-sa | 3 | 0.95 | alike | {under}creative commons attribution share ?alike(?: [234] [05])?
cc-by-nc | 3 | 0.95 | nc | {under}cc by nc(?: [234] [05])?
cc-by-nc | 3 | 0.95 | commercial | {under}creative commons attribution non ?commercial(?: [234] [05])?
cc-by-nc-sa | 3 | 0.95 | alike | {under}creative commons attribution non ?commercial share ?alike(?: [234] [05])?
cc-by-nc-nd | 3 | 0.95 | commercial | {under}creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)(?: [234] [05])?
cc-by-nd | 3 | 0.95 | deriv | {under}creative commons attribution no ?deriv(?:ative|atives|s)(?: [234] [05])?
cc | 3 | 0.9 | commons | {under}creative commons
cc0-1.0 | 3 | 0.95 | cc0 | {under}cc0(?: 1 0)?(?: universal)?
cddl-1.0 | 3 | 0.95 | cddl | {under}cddl
epl-2.0 | 3 | 0.95 | eclipse | {under}eclipse public license{v} 2(?: 0)?
epl | 3 | 0.95 | eclipse | {under}eclipse public license
eupl-1.2 | 3 | 0.95 | union | {under}european union public licen[sc]e
expat | 3 | 0.95 | expat | {under}expat licen[sc]e
gfdl | 3 | 0.95 | documentation | {under}(?:gnu )?free documentation license
gpl-2.0 | 3 | 0.95 | general | {under}(?:gnu )?general public license(?: gpl)?{v} 2(?: 0)?
gpl-3.0 | 3 | 0.95 | general | {under}(?:gnu )?general public license(?: gpl)?{v} 3(?: 0)?
gpl | 3 | 0.95 | general | {under}(?:gnu )?general public license
gpl-2.0 | 3 | 0.95 | gpl | {under}(?:gnu )?gpl ?v2
gpl-3.0 | 3 | 0.95 | gpl | {under}(?:gnu )?gpl ?v3
isc | 3 | 0.95 | isc | {under}isc licen[sc]e
lgpl-2.1 | 3 | 0.95 | lesser | {under}(?:gnu )?lesser general public license(?: lgpl)?{v} 2 1
lgpl-3.0 | 3 | 0.95 | lesser | {under}(?:gnu )?lesser general public license(?: lgpl)?{v} 3(?: 0)?
lgpl | 3 | 0.95 | general | {under}(?:gnu )?(?:lesser|library) general public license
mit | 3 | 0.95 | mit | {under}mit(?: x11)? licen[sc]e
mpl-1.1 | 3 | 0.95 | mozilla | {under}mozilla public license{v} 1 1
mpl-2.0 | 3 | 0.95 | mozilla | {under}mozilla public license{v} 2(?: 0)?
mpl | 3 | 0.95 | mozilla | {under}mozilla public license
ms-pl | 3 | 0.95 | microsoft | {under}microsoft public license
odbl-1.0 | 3 | 0.95 | database | {under}open (?:data commons open )?database license
ofl-1.1 | 3 | 0.95 | font | {under}(?:sil )?open font license
sspl-1.0 | 3 | 0.95 | server | {under}server side public license
unlicense | 3 | 0.95 | unlicense | {under}unlicense
wtfpl | 3 | 0.95 | wtfpl | {under}wtfpl
zlib | 3 | 0.95 | zlib | {under}zlib(?: libpng)? licen[sc]e
proprietary | 3 | 0.7 | proprietary | {under}(?:a |our )?proprietary licen[sc]e
commercial | 3 | 0.7 | commercial | {under}(?:our )?commercial licen[sc]e
"""

ADDRESSES = """
agpl | 2 | 0.9 | agpl | (?:https? )?(?:www )?gnu org licenses agpl
apache-1.1 | 2 | 0.9 | apache | (?:https? )?(?:www )?apache org licenses license 1 1
apache-2.0 | 2 | 0.9 | apache | (?:https? )?(?:www )?apache org licenses license 2 0
apache | 2 | 0.85 | apache | (?:https? )?(?:www )?apache org licenses
artistic-2.0 | 2 | 0.9 | artistic | (?:https? )?(?:www )?perlfoundation org artistic license 2 0
bsd | 2 | 0.85 | opensource | (?:https? )?(?:www )?opensource org licenses bsd
bsd-2-clause | 2 | 0.9 | opensource | (?:https? )?(?:www )?opensource org licenses bsd 2 clause
bsd-3-clause | 2 | 0.9 | opensource | (?:https? )?(?:www )?opensource org licenses bsd 3 clause
bsl-1.0 | 2 | 0.9 | boost | (?:https? )?(?:www )?boost org license 1 0
busl-1.1 | 2 | 0.9 | mariadb | (?:https? )?(?:www )?mariadb com bsl11
cc0-1.0 | 2 | 0.9 | creativecommons | (?:https? )?(?:www )?creativecommons org publicdomain zero
public-domain | 2 | 0.9 | creativecommons | (?:https? )?(?:www )?creativecommons org publicdomain mark
cc-by-2.0 | 2 | 0.9 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by 2 0
cc-by-3.0 | 2 | 0.9 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by 3 0
cc-by-4.0 | 2 | 0.9 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by 4 0
cc-by-nc | 2 | 0.9 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by nc
cc-by-nc-nd | 2 | 0.9 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by nc nd
cc-by-nc-sa | 2 | 0.9 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by nc sa
cc-by-nd | 2 | 0.9 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by nd
cc-by-sa | 2 | 0.9 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by sa
cc | 2 | 0.7 | creativecommons | (?:https? )?(?:www )?creativecommons org
cddl-1.0 | 2 | 0.9 | cddl | (?:https? )?(?:www )?opensource org licenses cddl
cecill | 2 | 0.9 | cecill | (?:https? )?(?:www )?cecill info licences
epl-1.0 | 2 | 0.9 | eclipse | (?:https? )?(?:www )?eclipse org legal epl v10
epl-2.0 | 2 | 0.9 | eclipse | (?:https? )?(?:www )?eclipse org legal epl 2 0
eupl-1.2 | 2 | 0.9 | joinup | (?:https? )?(?:www )?joinup ec europa eu collection eupl
gfdl | 2 | 0.9 | gnu | (?:https? )?(?:www )?gnu org licenses fdl
gpl-2.0 | 2 | 0.9 | gnu | (?:https? )?(?:www )?gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | 2 | 0.9 | gnu | (?:https? )?(?:www )?gnu org licenses gpl 3 0
gpl | 2 | 0.8 | gnu | (?:https? )?(?:www )?gnu org licenses
isc | 2 | 0.9 | opensource | (?:https? )?(?:www )?opensource org licenses isc
json | 2 | 0.9 | json | (?:https? )?(?:www )?json org license
lgpl-2.1 | 2 | 0.9 | lgpl | (?:https? )?(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | 2 | 0.9 | lgpl | (?:https? )?(?:www )?gnu org licenses lgpl 3 0
lppl | 2 | 0.9 | latex | (?:https? )?(?:www )?latex project org lppl
mit | 2 | 0.9 | opensource | (?:https? )?(?:www )?opensource org licenses mit
mpl-1.1 | 2 | 0.9 | mozilla | (?:https? )?(?:www )?mozilla org mpl 1 1
mpl-2.0 | 2 | 0.9 | mozilla | (?:https? )?(?:www )?mozilla org mpl 2 0
mpl | 2 | 0.8 | mozilla | (?:https? )?(?:www )?mozilla org mpl
mulan-psl-2.0 | 2 | 0.9 | coscl | (?:https? )?license coscl org cn mulanpsl2
odbl-1.0 | 2 | 0.9 | opendatacommons | (?:https? )?(?:www )?opendatacommons org licenses odbl
odc-by-1.0 | 2 | 0.9 | opendatacommons | (?:https? )?(?:www )?opendatacommons org licenses by
ofl-1.1 | 2 | 0.9 | scripts | (?:https? )?scripts sil org ofl
php-3.01 | 2 | 0.9 | php | (?:https? )?(?:www )?php net license
postgresql | 2 | 0.9 | postgresql | (?:https? )?(?:www )?postgresql org about licence
python-2.0 | 2 | 0.9 | python | (?:https? )?docs python org (?:3 )?license
ruby | 2 | 0.9 | ruby | (?:https? )?(?:www )?ruby lang org (?:[a-z]{2} )?about license
sspl-1.0 | 2 | 0.9 | mongodb | (?:https? )?(?:www )?mongodb com licensing server side public license
unlicense | 2 | 0.9 | unlicense | (?:https? )?(?:www )?unlicense org
upl-1.0 | 2 | 0.9 | oracle | (?:https? )?oss oracle com licenses upl
w3c | 2 | 0.9 | w3 | (?:https? )?(?:www )?w3 org consortium legal(?: [0-9]{4})? copyright software
wtfpl | 2 | 0.9 | wtfpl | (?:https? )?(?:www )?wtfpl net
zlib | 2 | 0.9 | zlib | (?:https? )?(?:www )?zlib net zlib license
"""

NAMES = """
afl-3.0 | 1 | 0.75 | academic | academic free license{v}(?: 3 0)?
agpl-3.0 | 1 | 0.75 | affero | (?:gnu )?affero general public license{v} 3(?: 0)?
agpl | 1 | 0.75 | affero | (?:gnu )?affero general public license
agpl-3.0 | 1 | 0.75 | agplv3 | (?:gnu )?agplv3
apache-1.1 | 1 | 0.75 | apache | apache(?: software)? license{v} 1 1
apache-2.0 | 1 | 0.75 | apache | apache(?: software)? license{v} 2(?: 0)?
apache-2.0 | 1 | 0.7 | apache 2 | apache 2(?: 0)? license
apache | 1 | 0.75 | apache | apache(?: software)? license
artistic-2.0 | 1 | 0.75 | artistic | artistic license{v} 2(?: 0)?
artistic | 1 | 0.75 | artistic | (?:perl |clarified )?artistic license
beerware | 1 | 0.75 | beer | beer ?ware license
blueoak-1.0.0 | 1 | 0.75 | oak | blue oak model license
bsd-2-clause | 1 | 0.75 | bsd | (?:2|two) clause bsd|bsd 2 clause|simplified bsd
bsd-2-clause | 1 | 0.75 | freebsd | freebsd license
bsd-3-clause | 1 | 0.75 | bsd | (?:3|three) clause bsd|bsd 3 clause
bsd-3-clause | 1 | 0.75 | bsd | (?:new|modified|revised) bsd(?: licen[sc]e)?
bsd-4-clause | 1 | 0.75 | bsd | (?:4|four) clause bsd|bsd 4 clause|original bsd
bsd-0-clause | 1 | 0.75 | bsd | (?:0|zero) clause bsd|bsd 0 clause|bsd zero clause
bsd | 1 | 0.75 | bsd | bsd(?: style)? licen[sc]e
bsd | 1 | 0.75 | berkeley | berkeley software distribution licen[sc]e
bsl-1.0 | 1 | 0.75 | boost | boost software license{v}(?: 1 0)?
busl-1.1 | 1 | 0.75 | business | business source license{v}(?: 1 1)?
cc0-1.0 | 1 | 0.75 | cc0 | cc0(?:{v} 1 0)?(?: universal)?
cc-by-2.0 | 1 | 0.75 | 2 0 | (?:cc by|creative commons attribution) 2 0
cc-by-2.5 | 1 | 0.75 | 2 5 | (?:cc by|creative commons attribution) 2 5
cc-by-3.0 | 1 | 0.75 | 3 0 | (?:cc by|creative commons attribution) 3 0
cc-by-4.0 | 1 | 0.75 | 4 0 | (?:cc by|creative commons attribution) 4 0
cc-by-nc | 1 | 0.75 | nc | cc by nc(?: [234] [05])?
cc-by-nc-nd | 1 | 0.75 | nd | cc by nc nd(?: [234] [05])?
cc-by-nc-sa | 1 | 0.75 | sa | cc by nc sa(?: [234] [05])?
cc-by-nd | 1 | 0.75 | nd | cc by nd(?: [234] [05])?
cc-by-sa | 1 | 0.75 | sa | cc by sa(?: [234] [05])?
cc-by-nc | 1 | 0.75 | commercial | attribution non ?commercial(?: [234] [05])?
cc-by-nc-nd | 1 | 0.75 | commercial | attribution non ?commercial no ?deriv(?:ative|atives|s)(?: works)?(?: [234] [05])?
cc-by-nc-sa | 1 | 0.75 | commercial | attribution non ?commercial share ?alike(?: [234] [05])?
cc-by-nd | 1 | 0.75 | deriv | attribution no ?deriv(?:ative|atives|s)(?: works)?(?: [234] [05])?
cc-by-sa | 1 | 0.75 | alike | attribution share ?alike(?: [234] [05])?
cc | 1 | 0.7 | commons | creative commons
cddl-1.0 | 1 | 0.75 | cddl | cddl(?: license)?
cddl-1.0 | 1 | 0.75 | development | common development and distribution license
cecill | 1 | 0.75 | cecill | cecill(?: [abc])?(?: license)?
cpl-1.0 | 1 | 0.75 | common | common public license
ecl-2.0 | 1 | 0.75 | educational | educational community license
elastic-2.0 | 1 | 0.75 | elastic | elastic license(?: 2 0)?
epl-1.0 | 1 | 0.75 | eclipse | eclipse public license{v} 1(?: 0)?
epl-2.0 | 1 | 0.75 | eclipse | eclipse public license{v} 2(?: 0)?
epl | 1 | 0.75 | eclipse | eclipse public license
eupl-1.2 | 1 | 0.75 | union | european union public licen[sc]e
expat | 1 | 0.75 | expat | expat licen[sc]e
gfdl | 1 | 0.75 | documentation | (?:gnu )?free documentation license
gpl-2.0 | 1 | 0.75 | general | (?:gnu )?general public license(?: gpl)?{v} 2(?: 0)?
gpl-3.0 | 1 | 0.75 | general | (?:gnu )?general public license(?: gpl)?{v} 3(?: 0)?
gpl | 1 | 0.75 | general | gnu general public license
gpl-2.0 | 1 | 0.75 | gplv2 | (?:gnu )?gplv2
gpl-3.0 | 1 | 0.75 | gplv3 | (?:gnu )?gplv3
hpnd | 1 | 0.75 | historical | historical permission notice and disclaimer
ibm-pl-1.0 | 1 | 0.75 | ibm | ibm public license
ijg | 1 | 0.75 | jpeg | independent jpeg group license
isc | 1 | 0.75 | isc | isc licen[sc]e
isc | 1 | 0.75 | consortium | internet (?:software|systems) consortium licen[sc]e
lgpl-2.1 | 1 | 0.75 | lesser | (?:gnu )?lesser general public license(?: lgpl)?{v} 2 1
lgpl-3.0 | 1 | 0.75 | lesser | (?:gnu )?lesser general public license(?: lgpl)?{v} 3(?: 0)?
lgpl | 1 | 0.75 | general | (?:gnu )?(?:lesser|library) general public license
lgpl | 1 | 0.75 | lgplv | (?:gnu )?lgplv(?:2|2 1|3)
lppl | 1 | 0.75 | latex | latex project public license
mit | 1 | 0.75 | mit | (?:the )?mit(?: x11)? licen[sc]e
mit-0 | 1 | 0.75 | mit | mit no attribution|mit 0 licen[sc]e
mpl-1.1 | 1 | 0.75 | mozilla | mozilla public license{v} 1 1
mpl-2.0 | 1 | 0.75 | mozilla | mozilla public license{v} 2(?: 0)?
mpl | 1 | 0.75 | mozilla | mozilla public license
ms-pl | 1 | 0.75 | microsoft | microsoft public license
ms-rl | 1 | 0.75 | microsoft | microsoft reciprocal license
mulan-psl-2.0 | 1 | 0.75 | mulan | mulan p(?:ermissive s(?:oftware )?l(?:icense)?|sl)(?: v2)?
ncsa | 1 | 0.75 | ncsa | university of illinois ncsa open source license
npl | 1 | 0.75 | netscape | netscape public license
odbl-1.0 | 1 | 0.75 | database | open (?:data commons open )?database license
odc-by-1.0 | 1 | 0.75 | attribution | open data commons attribution license
ofl-1.1 | 1 | 0.75 | font | (?:sil )?open font license
ogl-uk | 1 | 0.75 | government | open government licen[sc]e{v}(?: [123] 0)?
openssl | 1 | 0.75 | openssl | (?:dual )?openssl(?: and ssleay)? license
osl-3.0 | 1 | 0.75 | software | open software license
php-3.01 | 1 | 0.75 | php | php license
postgresql | 1 | 0.75 | postgresql | postgresql licen[sc]e
public-domain | 1 | 0.75 | domain | (?:released into|placed in|in|dedicated to) the public domain
python-2.0 | 1 | 0.75 | python | python (?:software foundation )?license
qpl-1.0 | 1 | 0.75 | public | q public license
ruby | 1 | 0.75 | ruby | ruby(?: s)? license
sspl-1.0 | 1 | 0.75 | server | server side public license
unicode | 1 | 0.75 | unicode | unicode license(?: agreement)?
unlicense | 1 | 0.75 | unlicense | (?:the )?unlicense
upl-1.0 | 1 | 0.75 | universal | universal permissive license
vim | 1 | 0.75 | vim | vim license
w3c | 1 | 0.75 | w3c | w3c software (?:notice and )?license
wtfpl | 1 | 0.75 | public | do what the f[a-z]{1,6} you want to public license
wtfpl | 1 | 0.75 | wtfpl | wtfpl
x11 | 1 | 0.75 | x11 | x11 licen[sc]e
zlib | 1 | 0.75 | zlib | zlib(?: libpng)? licen[sc]e
zpl-2.1 | 1 | 0.75 | zope | zope public license
"""

#: Identifiers as words; each one's label is the identifier itself.
IDENTIFIERS = """
0bsd; afl-3.0; agpl-3.0; agpl-3.0-only; agpl-3.0-or-later; apache-1.1; apache-2.0; artistic-1.0; artistic-2.0; beerware; blueoak-1.0.0;
bsd-2-clause; bsd-3-clause; bsd-4-clause; bsl-1.0; busl-1.1; cc0-1.0; cc-by-2.0; cc-by-3.0; cc-by-4.0; cc-by-nc-4.0; cc-by-nc-nd-4.0;
cc-by-nc-sa-4.0; cc-by-nd-4.0; cc-by-sa-3.0; cc-by-sa-4.0; cddl-1.0; cecill-2.1; cpl-1.0; ecl-2.0; elastic-2.0; epl-1.0; epl-2.0; eupl-1.2;
gfdl-1.3; gpl-2.0; gpl-2.0-only; gpl-2.0-or-later; gpl-3.0; gpl-3.0-only; gpl-3.0-or-later; hpnd; icu; ijg; ipl-1.0; isc; json; lgpl-2.1;
lgpl-2.1-only; lgpl-2.1-or-later; lgpl-3.0; lgpl-3.0-only; lgpl-3.0-or-later; lppl-1.3c; mit; mit-0; mpl-1.1; mpl-2.0; ms-pl; ms-rl;
mulanpsl-2.0; ncsa; odbl-1.0; odc-by-1.0; ofl-1.1; openssl; osl-3.0; php-3.01; postgresql; python-2.0; qpl-1.0; ruby; sspl-1.0; unicode-3.0;
unlicense; upl-1.0; vim; w3c; wtfpl; x11; zlib; zpl-2.1
"""

#: Every text that a rule matches holds one of these, so a text without them needs no rule.
TRIGGERS = (
    "licens", "licenc", "copyright", "public", " org ", " com ", " net ", " eu ", " cn ", " info ", "cc by", "cc0", "creative", "attribution", "bsd", "gpl", "permission", "permitted", "permit",
    "consent", "redistribut", "misrepresented", "evil", "confidential", "cddl", "cecill", "mulan", "foundation", "warranty", "copyleft", "beer", "eupl", "wtfpl", "what the", "jpeg", "mit ", "software",
    "trade secret", "remotely", "contributors", "png", "unmodified", "apache", "reproduc", "verbatim", "versions", "notice", "fitness", "font",
)


def rules() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, score, keyword, expression) of every rule. Each expression begins with the blank before its first word."""
    out = []
    for line in filter(None, (SENTENCES + GRANTS + ADDRESSES + NAMES).splitlines()):
        label, priority, score, keyword, *expression = line.split(" | ")
        text = expression[0].replace("{v}", VERSION).replace("{under}", UNDER)
        out.append((label, int(priority), float(score), keyword, f" (?:{text})(?= )"))
    for name in IDENTIFIERS.replace("\n", " ").strip().split("; "):
        words = name.replace("-", " ").replace(".", " ")
        out.append((name, 4, 1.0, "spdx", f" spdx license identifier {words}(?= )"))
    return out
