"""Signature rules of licences, written by hand over folded words.

A line is ``label kind pattern``. Patterns are expressions over lower-cased words
with one blank between them; ``~k`` between words stands for up to k others.
Kinds, by falling priority: ``text`` (wording that only the licence's own text
has), ``grant`` (a notice that puts something under it), ``tag`` (an identifier in
machine form), ``link`` (its address) and ``name``.
"""

RULES = r"""
mit text permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit text the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit grant (released|licensed|distributed|available|provided|published) under (the )?(terms of )?(the )?mit licen[sc]e
mit grant (this|the) (software|project|package|library|code|program|work) is (licensed|released) under (the )?mit
mit grant use of this source code is governed by an mit style licen[sc]e
mit tag spdx licen[sc]e identifier mit
mit link opensource org licenses mit( license)?
mit name (the )?mit expat licen[sc]e
mit name expat licen[sc]e
mit name mit x11 licen[sc]e
mit-0 text permission is hereby granted free of charge to any person obtaining a copy of this software ~40 without restriction ~40 to do so the software is provided
mit-0 tag spdx licen[sc]e identifier mit 0
mit-0 name mit no attribution licen[sc]e
mit-0 name mit no attribution
x11 text except as contained in this notice the name of the x consortium shall not be used in advertising
x11 tag spdx licen[sc]e identifier x11
x11 name x11 licen[sc]e
apache-2.0 text grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e to reproduce prepare derivative works of
apache-2.0 text you must give any other recipients of the work or derivative works a copy of this license
apache-2.0 text unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 grant you may not use this file except in compliance with the license ~6 you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2.0 grant (licensed|released|distributed|available|provided) under (the )?(terms of )?(the )?apache (software )?licen[sc]e (version |v )?2( 0)?
apache-2.0 grant licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0 tag spdx licen[sc]e identifier apache 2 0
apache-2.0 link apache org licenses license 2 0
apache-2.0 link opensource org licenses apache 2 0
apache-2.0 name apache (software )?licen[sc]e (version |v )?2 0
apache-2.0 name apache (software )?licen[sc]e (version |v )?2
apache-2.0 name apache 2 0 licen[sc]ed?
apache-2.0 name asl 2 0
apache-1.1 text this product includes software developed by the apache software foundation http www apache org
apache-1.1 tag spdx licen[sc]e identifier apache 1 1
apache-1.1 name apache (software )?licen[sc]e (version |v )?1 1
apache-1.0 tag spdx licen[sc]e identifier apache 1 0
apache-1.0 text this product includes software developed by the apache group for use in the apache http server project
apache-1.0 name apache (software )?licen[sc]e (version |v )?1 0
gpl-1.0 tag spdx licen[sc]e identifier gpl 1 0( only| or later)?
gpl-1.0 grant gnu general public licen[sc]e ~8 either version 1
gpl-1.0 name (gnu )?(gpl|general public licen[sc]e) (version |v )1( 0)?
gpl-2.0 text gnu general public license version 2 june 1991
gpl-2.0 text the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended
gpl-2.0 text you must cause the modified files to carry prominent notices stating that you changed the files and the date of any change
gpl-2.0 grant under the terms of (the )?gnu general public license ~8 (either )?version 2
gpl-2.0 grant (licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu )?(gpl|general public licen[sc]e) (version |v )?2
gpl-2.0 tag spdx licen[sc]e identifier gpl 2 0( only| or later)?
gpl-2.0 link gnu org licenses (old licenses )?gpl 2 0
gpl-2.0 link opensource org licenses gpl 2 0
gpl-2.0 name gnu general public licen[sc]e (version |v )?2( 0)?
gpl-2.0 name (gnu )?gpl (version |v )2( 0)?
gpl-2.0 name gplv2( only)?
gpl-3.0 text gnu general public license version 3 29 june 2007
gpl-3.0 text the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3.0 text this license refers to version 3 of the gnu general public license
gpl-3.0 grant under the terms of (the )?gnu general public license ~8 (either )?version 3
gpl-3.0 grant (licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu )?(gpl|general public licen[sc]e) (version |v )?3
gpl-3.0 tag spdx licen[sc]e identifier gpl 3 0( only| or later)?
gpl-3.0 link gnu org licenses gpl 3 0
gpl-3.0 link opensource org licenses gpl 3 0
gpl-3.0 name gnu general public licen[sc]e (version |v )?3( 0)?
gpl-3.0 name (gnu )?gpl (version |v )3( 0)?
gpl-3.0 name gplv3( only)?
gpl text you should have received a copy of the gnu general public license along with this (program|library|software)
gpl grant this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl grant (licensed|released|distributed|available) under (the )?(terms of )?(the )?(gnu )?gpl
gpl grant module license gpl
gpl link gnu org (licenses|copyleft) gpl( html| txt)?
gpl name gnu gpl
lgpl-2.0 text gnu library general public license version 2 june 1991
lgpl-2.0 tag spdx licen[sc]e identifier lgpl 2 0( only| or later)?
lgpl-2.0 name gnu library general public licen[sc]e( (version |v )?2( 0)?)?
lgpl-2.1 text gnu lesser general public license version 2 1 february 1999
lgpl-2.1 text this is the first released version of the lesser gpl it also counts as the successor of the gnu library public license
lgpl-2.1 grant under the terms of (the )?gnu lesser general public license ~8 (either )?version 2 1
lgpl-2.1 tag spdx licen[sc]e identifier lgpl 2 1( only| or later)?
lgpl-2.1 link gnu org licenses (old licenses )?lgpl 2 1
lgpl-2.1 name (gnu )?(lgpl|lesser general public licen[sc]e) (version |v )?2 1
lgpl-2.1 name lgplv2 1
lgpl-3.0 text gnu lesser general public license version 3 29 june 2007
lgpl-3.0 text this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
lgpl-3.0 grant under the terms of (the )?gnu lesser general public license ~8 (either )?version 3
lgpl-3.0 tag spdx licen[sc]e identifier lgpl 3 0( only| or later)?
lgpl-3.0 link gnu org licenses lgpl 3 0
lgpl-3.0 name (gnu )?(lgpl|lesser general public licen[sc]e) (version |v )?3( 0)?
lgpl-3.0 name lgplv3
lgpl grant this library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license
lgpl text you should have received a copy of the gnu (lesser|library) general public license along with this (program|library|software)
lgpl link gnu org (licenses|copyleft) lgpl( html| txt)?
lgpl name gnu lesser general public licen[sc]e
lgpl name (gnu )?lgpl
agpl-3.0 text gnu affero general public license version 3 19 november 2007
agpl-3.0 text the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation
agpl-3.0 grant under the terms of (the )?gnu affero general public license ~8 (either )?version 3
agpl-3.0 tag spdx licen[sc]e identifier agpl 3 0( only| or later)?
agpl-3.0 link gnu org licenses agpl 3 0
agpl-3.0 name (gnu )?(agpl|affero general public licen[sc]e) (version |v )?3( 0)?
agpl-3.0 name agplv3
agpl-1.0 text affero general public license version 1 march 2002
agpl-1.0 tag spdx licen[sc]e identifier agpl 1 0( only| or later)?
agpl name (gnu )?affero general public licen[sc]e
agpl name gnu agpl
gfdl text permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl tag spdx licen[sc]e identifier gfdl 1 [123]( only| or later| invariants only| no invariants only)?
gfdl link gnu org (licenses|copyleft) fdl( 1 [123])?( html| txt)?
gfdl name gnu free documentation licen[sc]e( version 1 [123])?
gfdl name gnu fdl
bsd-2-clause text redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by
bsd-2-clause tag spdx licen[sc]e identifier bsd 2 clause( patent| views)?
bsd-2-clause link opensource org licenses bsd 2 clause
bsd-2-clause name bsd (2|two) clause( licen[sc]e)?
bsd-2-clause name (2|two) clause bsd( licen[sc]e)?
bsd-2-clause name simplified bsd( licen[sc]e)?
bsd-2-clause name freebsd licen[sc]e
bsd-3-clause text neither the name of ~12 nor the names of (its|their|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause grant use of this source code is governed by a bsd style licen[sc]e
bsd-3-clause tag spdx licen[sc]e identifier bsd 3 clause( clear| lbnl| attribution)?
bsd-3-clause link opensource org licenses bsd 3 clause
bsd-3-clause name bsd (3|three) clause( licen[sc]e)?
bsd-3-clause name (3|three) clause bsd( licen[sc]e)?
bsd-3-clause name (new|modified|revised) bsd licen[sc]e
bsd-4-clause text all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause tag spdx licen[sc]e identifier bsd 4 clause( uc)?
bsd-4-clause name bsd (4|four) clause( licen[sc]e)?
bsd-4-clause name (4|four) clause bsd( licen[sc]e)?
bsd-4-clause name (original|old) bsd licen[sc]e
0bsd text permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
0bsd tag spdx licen[sc]e identifier 0bsd
0bsd name (bsd zero clause|zero clause bsd) licen[sc]e
bsd text redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd text redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd grant (released|licensed|distributed|available) under (the |a )?(terms of )?(the )?bsd( style)? licen[sc]e
bsd name bsd( style)? licen[sc]e
isc text permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc grant (released|licensed|distributed|available) under (the )?(terms of )?(the )?isc licen[sc]e
isc tag spdx licen[sc]e identifier isc
isc link opensource org licenses isc
isc name isc licen[sc]e
zlib text this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib text the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib tag spdx licen[sc]e identifier zlib( acknowledgement)?
zlib name zlib( libpng)? licen[sc]e
libpng text the contributing authors and group 42 inc disclaim all warranties expressed or implied
libpng tag spdx licen[sc]e identifier libpng( 2 0)?
libpng name libpng licen[sc]e
mpl-1.0 tag spdx licen[sc]e identifier mpl 1 0
mpl-1.0 name mozilla public licen[sc]e (version |v )?1 0
mpl-1.1 text the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 tag spdx licen[sc]e identifier mpl 1 1
mpl-1.1 link mozilla org mpl (mpl )?1 1
mpl-1.1 name (mozilla public licen[sc]e|mpl) (version |v )?1 1
mpl-2.0 text this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 grant if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0 tag spdx licen[sc]e identifier mpl 2 0( no copyleft exception)?
mpl-2.0 link mozilla org (en us )?mpl 2 0
mpl-2.0 name mozilla public licen[sc]e (version |v )?2 0
mpl-2.0 name mpl (version |v )?2 0
mpl name mozilla public licen[sc]e
epl-1.0 text the accompanying program is provided under the terms of this eclipse public license agreement
epl-1.0 tag spdx licen[sc]e identifier epl 1 0
epl-1.0 link eclipse org legal epl v10
epl-1.0 name (eclipse public licen[sc]e|epl) (version |v )?1 0
epl-2.0 text the accompanying program is provided under the terms of this eclipse public license agreement as published by the eclipse foundation
epl-2.0 grant this program and the accompanying materials are made available under the terms of the eclipse public license (v |version )?2 0
epl-2.0 tag spdx licen[sc]e identifier epl 2 0
epl-2.0 link eclipse org (legal|org documents) epl (v20|2 0)
epl-2.0 name (eclipse public licen[sc]e|epl) (version |v )?2 0
epl name eclipse public licen[sc]e
edl-1.0 link eclipse org org documents edl v10
edl-1.0 name eclipse distribution licen[sc]e( (version |v )?1 0)?
cddl-1.0 text common development and distribution license cddl version 1 0
cddl-1.0 grant the contents of this file are subject to the terms of the common development and distribution license
cddl-1.0 tag spdx licen[sc]e identifier cddl 1 0
cddl-1.0 name (common development and distribution licen[sc]e|cddl) (version |v )?1 0
cddl-1.1 tag spdx licen[sc]e identifier cddl 1 1
cddl-1.1 name (common development and distribution licen[sc]e|cddl) (version |v )?1 1
cddl name common development and distribution licen[sc]e
cpl-1.0 tag spdx licen[sc]e identifier cpl 1 0
cpl-1.0 name common public licen[sc]e( (version |v )?1 0)?
ipl-1.0 tag spdx licen[sc]e identifier ipl 1 0
ipl-1.0 name ibm public licen[sc]e( (version |v )?1 0)?
artistic-1.0 tag spdx licen[sc]e identifier artistic 1 0( cl8| perl)?
artistic-1.0 text the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
artistic-1.0 name artistic licen[sc]e (version |v )?1 0
artistic-2.0 text this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
artistic-2.0 tag spdx licen[sc]e identifier artistic 2 0
artistic-2.0 link opensource org licenses artistic (licen[sc]e )?2 0
artistic-2.0 name artistic licen[sc]e (version |v )?2 0
artistic grant (free software|it) ~12 under the same terms as perl itself
artistic name (perl|the|clarified) artistic licen[sc]e
bsl-1.0 text permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
bsl-1.0 grant distributed under the boost software license
bsl-1.0 tag spdx licen[sc]e identifier bsl 1 0
bsl-1.0 link boost org license 1 0
bsl-1.0 name boost software licen[sc]e( (version |v )?1 0)?
busl-1.1 text the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
busl-1.1 tag spdx licen[sc]e identifier busl 1 1
busl-1.1 name business source licen[sc]e( (version |v )?1 1)?
sspl-1.0 text if you make the functionality of the program or a modified version available to third parties as a service
sspl-1.0 tag spdx licen[sc]e identifier sspl 1 0
sspl-1.0 name server side public licen[sc]e( (version |v )?1)?
elastic-2.0 text you may not provide the software to third parties as a hosted or managed service
elastic-2.0 tag spdx licen[sc]e identifier elastic 2 0
elastic-2.0 name elastic licen[sc]e (version |v )?2( 0)?
commons-clause text without limiting other conditions in the license the grant of rights under the license will not include ~8 the right to sell the software
commons-clause name commons clause( licen[sc]e)? condition
unlicense text this is free and unencumbered software released into the public domain
unlicense text anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
unlicense tag spdx licen[sc]e identifier unlicense
unlicense link unlicense org
unlicense name the unlicense
cc0-1.0 text the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0 text to the greatest extent permitted by but not in contravention of applicable law affirmer hereby overtly fully permanently irrevocably
cc0-1.0 tag spdx licen[sc]e identifier cc0 1 0
cc0-1.0 link creativecommons org publicdomain zero 1 0
cc0-1.0 name (creative commons )?cc0( 1 0)?( universal)?
cc0-1.0 name creative commons zero
cc-pdm-1.0 link creativecommons org publicdomain mark 1 0
cc-pdm-1.0 name public domain mark 1 0
public-domain grant (released|placed|dedicated) (in|into|to) the public domain
wtfpl text you just do what the (fuck|f) you want to
wtfpl tag spdx licen[sc]e identifier wtfpl
wtfpl name wtfpl( licen[sc]e)?
beerware text if we meet some day and you think this stuff is worth it you can buy me a beer in return
beerware tag spdx licen[sc]e identifier beerware
beerware name beer ?ware licen[sc]e
cc-by text you are free to share copy and redistribute the material in any medium or format and adapt ~20 you must give appropriate credit
cc-by link creativecommons org licenses by [1234] [05]
cc-by tag spdx licen[sc]e identifier cc by [1234] [05]
cc-by name creative commons attribution( [1234] [05])?( international| unported| generic)?( public)? licen[sc]e
cc-by-1.0 name cc by 1 0
cc-by-2.0 name cc by 2 0
cc-by-2.5 name cc by 2 5
cc-by-3.0 name cc by 3 0
cc-by-4.0 name cc by 4 0
cc-by-3.0 name creative commons attribution 3 0( unported)?
cc-by-4.0 name creative commons attribution 4 0( international)?
cc-by-3.0 link creativecommons org licenses by 3 0
cc-by-4.0 link creativecommons org licenses by 4 0
cc-by-sa-2.0 name cc by sa 2 [05]
cc-by-sa-3.0 name cc by sa 3 0
cc-by-sa-4.0 name cc by sa 4 0
cc-by-sa-3.0 link creativecommons org licenses by sa 3 0
cc-by-sa-4.0 link creativecommons org licenses by sa 4 0
cc-by-sa link creativecommons org licenses by sa [1234] [05]
cc-by-sa name creative commons attribution share ?alike( [1234] [05])?( international| unported| generic)?
cc-by-sa name cc by sa
cc-by-nc-2.0 name cc by nc 2 [05]
cc-by-nc-3.0 name cc by nc 3 0
cc-by-nc-4.0 name cc by nc 4 0
cc-by-nc-4.0 link creativecommons org licenses by nc 4 0
cc-by-nc link creativecommons org licenses by nc [1234] [05]
cc-by-nc name creative commons attribution non ?commercial( [1234] [05])?( international| unported| generic)?
cc-by-nc name cc by nc
cc-by-nd-3.0 name cc by nd 3 0
cc-by-nd-4.0 name cc by nd 4 0
cc-by-nd link creativecommons org licenses by nd [1234] [05]
cc-by-nd name creative commons attribution no ?deriv(ative)?s?( [1234] [05])?( international| unported| generic)?
cc-by-nd name cc by nd
cc-by-nc-sa-3.0 name cc by nc sa 3 0
cc-by-nc-sa-4.0 name cc by nc sa 4 0
cc-by-nc-sa link creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-sa name creative commons attribution non ?commercial share ?alike( [1234] [05])?( international| unported| generic)?
cc-by-nc-sa name cc by nc sa
cc-by-nc-nd-3.0 name cc by nc nd 3 0
cc-by-nc-nd-4.0 name cc by nc nd 4 0
cc-by-nc-nd link creativecommons org licenses by nc nd [1234] [05]
cc-by-nc-nd name creative commons attribution non ?commercial no ?deriv(ative)?s?( [1234] [05])?( international| unported| generic)?
cc-by-nc-nd name cc by nc nd
odbl-1.0 grant this ~6 is made available under the open database license
odbl-1.0 tag spdx licen[sc]e identifier odbl 1 0
odbl-1.0 link opendatacommons org licenses odbl
odbl-1.0 name open (data commons open )?database licen[sc]e( (version |v )?1 0)?
odc-by-1.0 tag spdx licen[sc]e identifier odc by 1 0
odc-by-1.0 link opendatacommons org licenses by
odc-by-1.0 name open data commons attribution licen[sc]e
pddl-1.0 tag spdx licen[sc]e identifier pddl 1 0
pddl-1.0 link opendatacommons org licenses pddl
pddl-1.0 name (open data commons )?public domain dedication and licen[sc]e
ogl-uk-3.0 text contains public sector information licensed under the open government licence v3 0
ogl-uk-3.0 tag spdx licen[sc]e identifier ogl uk 3 0
ogl-uk-3.0 link nationalarchives gov uk doc open government licence version 3
ogl name open government licen[sc]e
eupl-1.1 tag spdx licen[sc]e identifier eupl 1 1
eupl-1.1 name (european union public licen[sc]e|eupl) (version |v )?1 1
eupl-1.2 grant licensed under the eupl
eupl-1.2 tag spdx licen[sc]e identifier eupl 1 2
eupl-1.2 name (european union public licen[sc]e|eupl) (version |v )?1 2
eupl name european union public licen[sc]e
cecill-2.1 text ce logiciel est regi par la licence cecill
cecill-2.1 tag spdx licen[sc]e identifier cecill (1 0|1 1|2 0|2 1|b|c)
cecill-2.1 name cecill (free software )?licen[sc]e( agreement)?
ofl-1.1 text this font software is licensed under the sil open font license version 1 1
ofl-1.1 tag spdx licen[sc]e identifier ofl 1 1( rfn| no rfn)?
ofl-1.1 link scripts sil org ofl
ofl-1.1 name (sil )?open font licen[sc]e( (version |v )?1 1)?
ms-pl tag spdx licen[sc]e identifier ms pl
ms-pl name microsoft public licen[sc]e( ms pl)?
ms-rl tag spdx licen[sc]e identifier ms rl
ms-rl name microsoft reciprocal licen[sc]e( ms rl)?
psf-2.0 text this license agreement is between the python software foundation psf and the individual or organization
psf-2.0 tag spdx licen[sc]e identifier (psf 2 0|python 2 0( 1)?)
psf-2.0 name (python software foundation|psf) licen[sc]e( (agreement|version 2))?
php-3.01 text this product includes php software freely available from
php-3.01 tag spdx licen[sc]e identifier php 3 0?1
php-3.01 name php licen[sc]e (version |v )?3 0?1
ruby grant under the same terms as ruby
ruby tag spdx licen[sc]e identifier ruby
ruby name ruby licen[sc]e
openssl text this product includes software developed by the openssl project for use in the openssl toolkit
openssl tag spdx licen[sc]e identifier openssl
openssl name openssl licen[sc]e
w3c text by obtaining using and or copying this work you the licensee agree that you have read understood and will comply
w3c tag spdx licen[sc]e identifier w3c( 19980720| 20150513)?
w3c name w3c software( and document)?( notice and)? licen[sc]e
unicode text unicode data files and software ~6 permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
unicode tag spdx licen[sc]e identifier unicode (3 0|dfs 201[56]|tou)
unicode name unicode licen[sc]e (v3|agreement)
icu tag spdx licen[sc]e identifier icu
icu name icu licen[sc]e
curl text permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement of third party rights
curl tag spdx licen[sc]e identifier curl
ncsa text redistributions in binary form must reproduce the above copyright notice ~30 with the software without specific prior written permission
ncsa tag spdx licen[sc]e identifier ncsa
ncsa name (university of illinois )?ncsa open source licen[sc]e
postgresql text permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
postgresql tag spdx licen[sc]e identifier postgresql
postgresql name postgresql licen[sc]e
blueoak-1.0.0 text no contributor can revoke this license
blueoak-1.0.0 tag spdx licen[sc]e identifier blueoak 1 0 0
blueoak-1.0.0 name blue oak model licen[sc]e( 1 0 0)?
upl-1.0 tag spdx licen[sc]e identifier upl 1 0
upl-1.0 name universal permissive licen[sc]e( (version |v )?1 0)?
osl-3.0 text licensed under the open software license version 3 0
osl-3.0 tag spdx licen[sc]e identifier osl (1 0|1 1|2 0|2 1|3 0)
osl-3.0 name open software licen[sc]e (version |v )?3 0
afl-3.0 tag spdx licen[sc]e identifier afl (1 1|1 2|2 0|2 1|3 0)
afl-3.0 name academic free licen[sc]e( (version |v )?3 0)?
ecl-2.0 tag spdx licen[sc]e identifier ecl (1|2) 0
ecl-2.0 name educational community licen[sc]e( (version |v )?2 0)?
mulan-psl-2.0 tag spdx licen[sc]e identifier mulanpsl (1|2) 0
mulan-psl-2.0 name mulan permissive software licen[sc]e( v2)?
hippocratic-2.1 name hippocratic licen[sc]e( (version |v )?2 1)?
rail grant use restrictions ~10 responsible ai licen[sc]e
rail name (open ?rail|bigscience rail|creativeml open ?rail( m)?) licen[sc]e
llama-community name llama [234]( [0-9])? community licen[sc]e( agreement)?
proprietary grant all rights reserved ~6 (unauthori[sz]ed|no part of this) ~8 (prohibited|reproduced)
proprietary grant proprietary and confidential
proprietary grant this (file|software) contains confidential and proprietary information
"""
