"""License scans by ordered signature rules, in DataFrame operations only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.expressions import ascii_lower, let, whole

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: label | words of its identifier | a word sequence of each name, as regexes over lower-case words
LICENSES = """
mit | mit | mit license; expat license; mit x11 license
mit-0 | mit 0 | mit no attribution( license)?
apache-2.0 | apache 2 0 | apache license( version)? 2( 0)?; apache software license( version)? 2( 0)?; asl 2 0
apache-1.1 | apache 1 1 | apache (software )?license( version)? 1 1
bsd-2-clause | bsd 2 clause | (simplified|freebsd) bsd license; (bsd )?(2|two) clause bsd license; bsd (2|two) clause license
bsd-3-clause | bsd 3 clause | (new|modified|revised) bsd license; (3|three) clause bsd license; bsd (3|three) clause license
bsd-4-clause | bsd 4 clause | original bsd license; (4|four) clause bsd license; bsd (4|four) clause license
0bsd | 0bsd | zero clause bsd( license)?; bsd zero clause license
isc | isc | isc license; internet systems consortium license
zlib | zlib | zlib license; zlib libpng license
unlicense | unlicense | the unlicense; unlicense license
wtfpl | wtfpl | do what the fuck you want to public license
cc0-1.0 | cc0 1 0 | cc0( 1 0)?( universal)?; creative commons zero( v1 0| 1 0)?( universal)?
cc-by-4.0 | cc by 4 0 | cc by 4 0; creative commons attribution 4 0( international)?
cc-by-3.0 | cc by 3 0 | cc by 3 0; creative commons attribution 3 0( unported)?
cc-by-2.0 | cc by 2 0 | cc by 2 0; creative commons attribution 2 0( generic)?
cc-by-sa-4.0 | cc by sa 4 0 | cc by sa 4 0; creative commons attribution share ?alike 4 0( international)?
cc-by-sa-3.0 | cc by sa 3 0 | cc by sa 3 0; creative commons attribution share ?alike 3 0( unported)?
cc-by-sa-2.0 | cc by sa 2 0 | cc by sa 2 0; creative commons attribution share ?alike 2 0( generic)?
cc-by-nc-4.0 | cc by nc 4 0 | cc by nc 4 0; creative commons attribution non ?commercial 4 0( international)?
cc-by-nc-3.0 | cc by nc 3 0 | cc by nc 3 0; creative commons attribution non ?commercial 3 0( unported)?
cc-by-nd-4.0 | cc by nd 4 0 | cc by nd 4 0; creative commons attribution no ?deriv(ative)?s 4 0( international)?
cc-by-nd-3.0 | cc by nd 3 0 | cc by nd 3 0; creative commons attribution no ?deriv(ative)?s 3 0( unported)?
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | cc by nc sa 4 0; creative commons attribution non ?commercial share ?alike 4 0( international)?
cc-by-nc-sa-3.0 | cc by nc sa 3 0 | cc by nc sa 3 0; creative commons attribution non ?commercial share ?alike 3 0( unported)?
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | cc by nc nd 4 0; creative commons attribution non ?commercial no ?deriv(ative)?s 4 0( international)?
cc-by-nc-nd-3.0 | cc by nc nd 3 0 | cc by nc nd 3 0; creative commons attribution non ?commercial no ?deriv(ative)?s 3 0( unported)?
gpl-1.0 | gpl 1 0 | gnu general public license( version| v)? ?1( 0)?; gnu gpl (version |v)?1
gpl-2.0 | gpl 2 0 | gnu general public license( version| v)? ?2( 0)?; gnu gpl (version |v)?2; gplv2
gpl-3.0 | gpl 3 0 | gnu general public license( version| v)? ?3( 0)?; gnu gpl (version |v)?3; gplv3
lgpl-2.0 | lgpl 2 0 | gnu library general public license( version| v)? ?2( 0)?; lgplv2
lgpl-2.1 | lgpl 2 1 | gnu lesser general public license( version| v)? ?2 1; lgplv2 1
lgpl-3.0 | lgpl 3 0 | gnu lesser general public license( version| v)? ?3( 0)?; lgplv3
agpl-3.0 | agpl 3 0 | gnu affero general public license( version| v)? ?3( 0)?; agplv3
gfdl-1.1 | gfdl 1 1 | gnu free documentation license( version| v)? ?1 1
gfdl-1.2 | gfdl 1 2 | gnu free documentation license( version| v)? ?1 2
gfdl-1.3 | gfdl 1 3 | gnu free documentation license( version| v)? ?1 3
mpl-1.0 | mpl 1 0 | mozilla public license( version| v)? ?1 0
mpl-1.1 | mpl 1 1 | mozilla public license( version| v)? ?1 1
mpl-2.0 | mpl 2 0 | mozilla public license( version| v)? ?2( 0)?
epl-1.0 | epl 1 0 | eclipse public license( version| v)? ?1( 0)?
epl-2.0 | epl 2 0 | eclipse public license( version| v)? ?2( 0)?
eupl-1.1 | eupl 1 1 | european union public licen[cs]e( version| v)? ?1 1
eupl-1.2 | eupl 1 2 | european union public licen[cs]e( version| v)? ?1 2
cddl-1.0 | cddl 1 0 | common development and distribution license( version| v)? ?1 0
cddl-1.1 | cddl 1 1 | common development and distribution license( version| v)? ?1 1
cpl-1.0 | cpl 1 0 | common public license( version| v)? ?1 0
ipl-1.0 | ipl 1 0 | ibm public license( version| v)? ?1 0
afl-3.0 | afl 3 0 | academic free license( version| v)? ?3( 0)?
osl-3.0 | osl 3 0 | open software license( version| v)? ?3( 0)?
artistic-1.0 | artistic 1 0 | artistic license( version| v)? ?1 0
artistic-2.0 | artistic 2 0 | artistic license( version| v)? ?2( 0)?
bsl-1.0 | bsl 1 0 | boost software license( version| v)? ?1( 0)?
busl-1.1 | busl 1 1 | business source license( version| v)? ?1 1
sspl-1.0 | sspl 1 0 | server side public license( version| v)? ?1( 0)?
elastic-2.0 | elastic 2 0 | elastic license( version| v)? ?2( 0)?
ms-pl | ms pl | microsoft public license
ms-rl | ms rl | microsoft reciprocal license
ofl-1.1 | ofl 1 1 | sil open font license( version| v)? ?1 1
odbl-1.0 | odbl 1 0 | open data commons open database license( version| v)? ?1 0; open database license( version| v)? ?1 0
odc-by-1.0 | odc by 1 0 | open data commons attribution license( version| v)? ?1 0
pddl-1.0 | pddl 1 0 | (open data commons )?public domain dedication and licen[cs]e
psf-2.0 | psf 2 0 | python software foundation license( version| v)? ?2; psf license( agreement)?
python-2.0 | python 2 0 | python license( version| v)? ?2 0
postgresql | postgresql | postgresql license
php-3.01 | php 3 01 | php license( version| v)? ?3 01
ruby | ruby | ruby license
ncsa | ncsa | university of illinois ncsa open source license; ncsa open source license
upl-1.0 | upl 1 0 | universal permissive license( version| v)? ?1 0
vim | vim | vim license
w3c | w3c | w3c software (notice and )?license
x11 | x11 | x11 license
openssl | openssl | openssl license
json | json | json license
lppl-1.3c | lppl 1 3c | latex project public license( version| v)? ?1 3c?
ecl-2.0 | ecl 2 0 | educational community license( version| v)? ?2( 0)?
beerware | beerware | beer ?ware license
ogl-uk-3.0 | ogl uk 3 0 | open government licen[cs]e( version| v)? ?3( 0)?
mulanpsl-2.0 | mulanpsl 2 0 | mulan permissive software license( version| v)? ?2
openrail | openrail | (creativeml |bigscience )?open ?rail( m)?( license)?
"""

#: label | keyword | regex, for sentences and headings of license texts that tell which license it is
TEXTS = """
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | above copyright notice | the above copyright notice and this permission notice (shall be included|are included) in all copies or substantial portions of the software
mit | deal in the software | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit-0 | deal in the software without restriction | permission is hereby granted free of charge to any person to deal in the software without restriction and without attribution
x11 | x consortium | the name of the x consortium shall not be used in advertising
isc | permission to use copy modify | permission to use copy modify (and |and or )?distribute this software for any purpose with or without fee is hereby granted
0bsd | with or without fee | permission to use copy modify (and |and or )?distribute this software for any purpose with or without fee is hereby granted the software is provided
isc | disclaims all warranties | the author disclaims all warranties with regard to this software
bsd-2-clause | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd-2-clause | redistributions of source code | redistributions of source code must retain the above copyright notice
bsd-3-clause | endorse or promote products | (neither the name|the names?) of ([^ ]+ ){0,12}may (not )?be used to endorse or promote products derived from this software
bsd-4-clause | advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledg(e)?ment
bsd-source-code | binary form need not | redistributions in binary form need not reproduce the copyright notice
bsd-3-clause-clear | no express or implied licenses | no express or implied licenses to any party s patent rights are granted by this license
zlib | origin of this software | the origin of this software must not be misrepresented you must not claim that you wrote the original (software|licensed software)
zlib | plainly marked as such | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | damages arising from the use | in no event will the authors be held liable for any damages arising from the use of this software
libpng-2.0 | png reference library | png reference library license( version 2)?
apache-2.0 | apache org licenses license 2 0 | apache org licenses license 2 0( txt| html)?
apache-2.0 | except in compliance with the license | you may not use this file except in compliance with the license
apache-2.0 | limitations under the license | see the license for the specific language governing permissions and limitations under the license
apache-2.0 | terms and conditions for use reproduction | terms and conditions for use reproduction and distribution
apache-2.0 | grant of patent license | grant of patent license subject to the terms and conditions of this license each contributor hereby grants
apache-1.1 | developed by the apache | this product includes software developed by the apache software foundation
apache-1.1 | apache and apache software foundation | the names apache and apache software foundation must not be used to endorse
llvm-exception | llvm exception | (llvm exceptions to the apache 2 0 license|apache 2 0 with llvm exception|apache license v2 0 with llvm exceptions)
unlicense | free and unencumbered software | this is free and unencumbered software released into the public domain
unlicense | relinquishment in perpetuity | overt act of relinquishment in perpetuity of all present and future rights to this software
wtfpl | just do what the fuck | you just do what the fuck you want to
cc0-1.0 | commons deed is not | the commons deed is not a legal instrument
cc0-1.0 | affirmer hereby overtly | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc0-1.0 | no copyright the person | no copyright the person who associated a work with this deed has dedicated the work to the public domain
cc-by-4.0 | creative commons attribution 4 0 | creative commons attribution 4 0 international public license
cc-by | appropriate credit provide a link | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa | distribute your contributions | if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nc | primarily intended for or directed | not primarily intended for or directed towards commercial advantage or monetary compensation
cc-by-nc | use the material for commercial | you may not use the material for commercial purposes
cc-by-nd | distribute the modified material | if you remix transform or build upon the material you may not distribute the modified material
cc | some rights reserved this work | some rights reserved this work is licensed under a creative commons
gpl | this program is free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | without even the implied warranty | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl | received a copy of the gnu general | you should have received a copy of the gnu general public license( along with this program| along with this file)?
gpl-2.0 | either version 2 of the license | either version 2 of the license or (at your option|by your choice) any later version
gpl-2.0 | published by the free software foundation version 2 | published by the free software foundation version 2( of the license)?
gpl-3.0 | either version 3 of the license | either version 3 of the license or (at your option|by your choice) any later version
gpl-3.0 | published by the free software foundation version 3 | published by the free software foundation version 3( of the license)?
gpl-2.0 | license version 2 june 1991 | gnu general public license version 2 june 1991
gpl-3.0 | license version 3 29 june 2007 | gnu general public license version 3 29 june 2007
gpl-1.0 | license version 1 february 1989 | gnu general public license version 1 february 1989
gpl | copyleft license for software | the gnu general public license is a free copyleft license for software
gpl | freedom to share and change | licenses for most software are designed to take away your freedom to share and change it
gpl-2.0 | 2 or later | (licensed under |under )?(the )?gpl ?v? ?2 or later
gpl-3.0 | 3 or later | (licensed under |under )?(the )?gpl ?v? ?3 or later
gpl-2.0 | gplv2 only | gplv2 only
gpl-3.0 | gplv3 only | gplv3 only
classpath-exception | linking this library statically | linking this library statically or dynamically with other modules is making a combined work
gcc-exception | gcc runtime library exception | gcc runtime library exception( version 3 1)?
autoconf-exception | configure script | as a special exception ([^ ]+ ){0,12}configure script generated by autoconf
font-exception | font exception | (gpl|general public license) with font exception
lgpl-2.1 | license version 2 1 february 1999 | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | lesser general public license version 3 29 june | gnu lesser general public license version 3 29 june 2007
lgpl-2.0 | library general public license version 2 june | gnu library general public license version 2 june 1991
lgpl | received a copy of the gnu lesser | you should have received a copy of the gnu lesser general public license
lgpl | received a copy of the gnu library | you should have received a copy of the gnu library general public license
agpl-3.0 | affero general public license version 3 19 | gnu affero general public license version 3 19 november 2007
agpl | received a copy of the gnu affero | you should have received a copy of the gnu affero general public license
agpl | interacting with it remotely | all users interacting with it remotely through a computer network
gfdl-1.3 | documentation license version 1 3 3 | gnu free documentation license version 1 3 3 november 2008
gfdl | no invariant sections | with no invariant sections no front cover texts and no back cover texts
mpl-2.0 | subject to the terms of the mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | copy of the mpl was not distributed | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | subject to the mozilla public license version 1 1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | subject to the mozilla public license version 1 0 | the contents of this file are subject to the mozilla public license version 1 0
mpl | incompatible with secondary licenses | this source code form is incompatible with secondary licenses
npl-1.1 | netscape public license | netscape public license( version| v)? ?1 1
epl-2.0 | made available under the terms of the eclipse public license 2 0 | made available under the terms of the eclipse public license 2 0
epl-1.0 | made available under the terms of the eclipse public license v1 0 | made available under the terms of the eclipse public license v1 0
edl-1.0 | eclipse distribution license | eclipse distribution license( version| v)? ?1 0
cddl | terms of the common development and distribution license | subject to the terms of the common development and distribution license
cecill-2.1 | cecill free software license agreement version 2 1 | cecill free software license agreement version 2 1
cecill | cecill license | governed by the cecill license under french law
cecill-b | cecill b license | cecill b license
cecill-c | cecill c license | cecill c license
eupl | licensed under the eupl | licensed under the eupl( version| v)?( 1 1| 1 2)?
osl | open software license | licensed under the open software license
artistic | perl itself | (you can redistribute it and or modify it )?under the same terms as perl itself
artistic-1.0 | the artistic license preamble | the artistic license preamble the intent of this document is to state the conditions
artistic-2.0 | artistic license 2 0 copyright | artistic license 2 0 copyright( c)? 2000 2006 the perl foundation
bsl-1.0 | boost org license 1 0 | boost org license 1 0 txt
bsl-1.0 | boost software license version 1 0 17 | boost software license version 1 0 17(th)? august 2003
busl-1.1 | additional use grant | additional use grant (you may|none)( make production use of the licensed work)?
busl-1.1 | effective on the change date | effective on the change date or the fourth anniversary of the first publicly available distribution
sspl-1.0 | server side public license version 1 october | server side public license version 1 october 16 2018
elastic-2.0 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
commons-clause | commons clause | (commons clause license condition|commons clause)( v1 0)?
polyform-noncommercial-1.0.0 | polyform noncommercial license | polyform noncommercial license( 1 0 0)?
polyform-small-business-1.0.0 | polyform small business license | polyform small business license( 1 0 0)?
hippocratic-2.1 | hippocratic license | hippocratic license( version)?( 2 1| 3 0)?
ms-pl | microsoft public license | microsoft public license ms pl
ms-pl | conditions and limitations a no trademark | conditions and limitations a no trademark license
ms-lpl | microsoft limited public license | microsoft limited public license
ofl-1.1 | reserved font name | with reserved font names?
ofl-1.1 | sil open font license version 1 1 26 | sil open font license version 1 1 26 february 2007
ofl-1.0 | sil open font license version 1 0 | sil open font license version 1 0
ufl-1.0 | ubuntu font licen | ubuntu font licen[cs]e( version)?( 1 0)?
bitstream-vera | bitstream vera | bitstream vera (fonts )?copyright
odbl-1.0 | opendatacommons org licenses odbl | opendatacommons org licenses odbl( 1 0| summary)?
odc-by-1.0 | opendatacommons org licenses by | opendatacommons org licenses by( 1 0| summary)?
pddl-1.0 | opendatacommons org licenses pddl | opendatacommons org licenses pddl( 1 0| summary)?
dbcl-1.0 | database contents license | (open data commons )?database contents license( v1 0)?
cdla-permissive-2.0 | cdla permissive 2 0 | cdla permissive 2 0( license)?
cdla-permissive-1.0 | community data license agreement permissive | community data license agreement permissive( version 1 0)?
cdla-sharing-1.0 | community data license agreement sharing | community data license agreement sharing( version 1 0)?
ogl-uk-3.0 | public sector information licensed | contains public sector information licensed under the open government licen[cs]e v3 0
ogl-uk-2.0 | open government licence v2 0 | open government licence v2 0
ogl-uk-1.0 | open government licence v1 0 | open government licence v1 0
ogl-canada-2.0 | open government licence canada | open government licence canada
etalab-2.0 | licence ouverte | licence ouverte( open licence)?( etalab)?( version)?( 2 0)?
dl-de-by-2.0 | datenlizenz deutschland namensnennung | datenlizenz deutschland namensnennung( version)? 2 0
dl-de-zero-2.0 | datenlizenz deutschland zero | datenlizenz deutschland zero( version)? 2 0
psf-2.0 | python software foundation license version 2 | python software foundation license version 2
psf-2.0 | psf hereby grants licensee | psf hereby grants licensee a nonexclusive royalty free world wide license
cnri-python | cnri | cnri (open source )?license agreement
ruby | same terms as ruby itself | (licensed )?under the same terms as ruby itself
php-3.01 | freely available from http www php net | this product includes php software freely available from http www php net
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | cryptographic software written by eric young | this product includes cryptographic software written by eric young
curl | curl license | curl license
ncsa | deal with the software without restriction | to deal with the software without restriction
postgresql | postgresql database management system | postgresql database management system ([^ ]+ ){0,8}portions copyright
json | used for good not evil | the software shall be used for good not evil
ijg | independent jpeg group | based in part on the work of the independent jpeg group
ftl | freetype project license | (the )?freetype project license
imagemagick | imagemagick license | imagemagick license
info-zip | info zip license | info zip license
libtiff | sam leffler and silicon graphics | the names of sam leffler and silicon graphics may not be used in any advertising
tcl | tcl tk license | tcl tk license terms
vim | vim is charityware | vim is charityware you can use and copy it as much as you like
unicode-dfs | license agreement data files | unicode (inc )?license agreement data files and software
w3c | w3c software notice and license | w3c software notice and license
w3c | w3 org consortium legal | w3 org consortium legal (2015 )?copyright software
intel-acpi | intel open source license | intel open source license
nasa-1.3 | nasa open source | nasa open source (software )?agreement( version 1 3)?
qpl-1.0 | q public license | q public license( version 1 0)?
rpl-1.5 | reciprocal public license | reciprocal public license( version)?( 1 5| 1 1)?
sleepycat | sleepycat license | sleepycat license
sissl | sun industry standards source license | sun industry standards source license( version 1 1)?
apsl-2.0 | apple public source license | apple public source license( version)?( 2 0| 1 2)?
lppl | latex project public license | conditions of the latex project public license either version 1 3
knuth-ctan | donald knuth | donald knuth license
anti-996 | anti 996 license | anti 996 license( version 1 0)?
blueoak-1.0.0 | blue oak model license | blue oak model license( 1 0 0)?
isc | openbsd license | openbsd license
beerware | buy me a beer | you can buy me a beer in return
openrail | use based restrictions | use based restrictions as referenced in paragraph 5( of this license)?
bigscience-rail-1.0 | bigscience rail license | bigscience rail license( v1 0)?
llama-2 | llama 2 community license | llama 2 community license( agreement)?
llama-3 | llama 3 community license | (meta )?llama 3 community license( agreement)?
gemma | gemma terms of use | gemma terms of use( license)?
jrl | java research license | java research license
oracle-bcl | oracle binary code license | oracle binary code license agreement
fair-source | functional source license | functional source license( version)?( 1 1)?
copyfree | copyfree open innovation license | copyfree open innovation license
oasis | oasis open | copyright( c)? oasis open
ietf | ietf trust legal provisions | ietf trust legal provisions relating to ietf documents
ietf | the internet society | copyright( c)? the internet society
pixabay | pixabay | pixabay (content )?license
unsplash | unsplash license | unsplash license
stack-exchange | user contributions licensed under cc by sa | user contributions licensed under cc by sa
wikipedia | available under the creative commons attribution share | text is available under the creative commons attribution share ?alike license
"""

#: label | keyword | regex, for grants and notices that name no version; the lowest priority
NOTICES = """
apache | apache | apache license
bsd | bsd | bsd (style )?license
gpl | general public | (gnu )?general public license( version( \\S+)?)?
lgpl | lesser general | (gnu )?lesser general public license
agpl | affero | (gnu )?affero general public license
gfdl | free documentation | (gnu )?free documentation license
mpl | mozilla | mozilla public license
epl | eclipse | eclipse public license
cc-by | cc by | cc by( \\d \\d)?
cc-by-sa | cc by sa | cc by sa
cc-by-nc | cc by nc | cc by nc
cc-by-nd | cc by nd | cc by nd
cc-by-nc-sa | cc by nc sa | cc by nc sa
cc-by-nc-nd | cc by nc nd | cc by nc nd
cc | creative commons | creative commons( attribution)?( non ?commercial)?( share ?alike)? license
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy
isc | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose
bsd | redistribution and use | redistribution and use in source and binary forms
zlib | altered source versions | altered source versions must be plainly marked as such
public-domain | public domain | (dedicated to|released into|placed in|in) the public domain
reserved | rights reserved | (all|some) rights reserved
copyright | copyright | copyright( c)? (19|20)\\d\\d( (19|20)\\d\\d)?
proprietary | confidential | proprietary and confidential
no-warranty | warranty | (without warranty of any kind|as is without warranty)
no-warranty | merchantability | (implied )?warrant(y|ies) of merchantability
no-warranty | provided by the copyright holders | provided by the copyright holders and contributors as is
no-liability | liable | in no event shall (the )?(authors?|copyright holders?|contributors) ([^ ]+ ){0,8}be liable
patent | patent pending | patent pending
patent | patents | protected by (one or more|the following) (u s |us )?patents
trademark | registered trademark | (is a|are) registered trademarks? of
proprietary | trade secret | (contains|constitutes) (confidential and )?trade secrets?( information)? of
proprietary | unauthorized | unauthorized (copying|reproduction|use|distribution) of this (file|software|document|work)( [^ ]+){0,6} is strictly prohibited
proprietary | without the prior written permission | (reproduced|distributed|transmitted|copied) ([^ ]+ ){0,12}without the prior written permission of the (publisher|author|copyright holder|owner)
proprietary | end user license agreement | end user license agreement
proprietary | terms of service | subject to (our|the) terms of service
proprietary | internal use only | for internal use only
non-commercial | commercial use only | for (personal and )?non ?commercial use only
non-commercial | commercial use | (no|not for) commercial use( is permitted| is allowed)?
research-only | research purposes only | for (academic |educational )?(and )?research purposes only
evaluation-only | evaluation purposes only | for evaluation purposes only
reserved | todos los derechos reservados | todos los derechos reservados
reserved | tous droits | tous droits (de reproduction )?(reserves|réservés)
reserved | alle rechte vorbehalten | alle rechte vorbehalten
reserved | tutti i diritti riservati | tutti i diritti riservati
reserved | no rights reserved | no rights reserved
copyright | copr | copr (19|20)\\d\\d
copyright | urheberrechtlich | urheberrechtlich geschützt
fair-use | fair use | fair use (notice|disclaimer)
cc-by | licensed under cc by | (photo|image|text|content) (by|credit) ([^ ]+ ){0,8}licensed under cc by
open-access | open access article | this is an open access article (distributed )?under the terms of
us-government | of the united states government | works? of the united states government
permission | permission | (reprinted|reproduced|used) (with|by) (kind )?permission( of)?
dual | licensed under | (is |are )?dual ?licensed under
same-as | licensed under the same terms | licensed under the same terms as
see-file | file | see (the )?(accompanying )?licen[cs]e file( for details| for copyright)?
"""

#: Words without which a text is not looked at: every rule's text has one of them.
ANCHORS = (
    "licen", "creative", "distribut", "gpl", "cc by", "cc0", "copyright", "permission", "software", "openrail", "open rail", "commercial", "patent", "reserved", "warranty", "public domain", "asl 2 0", "mit no attribution", "zero clause",
    "exception", "published by the", "trade", "confidential", "unauthorized", "vorbehalten", "derechos", "droits", "riservati", "datenlizenz", "purposes only", "internal use only", "fair use", "access article", "terms of ", "open source",
    "commons", "legal provisions", "liable", "merchantab", "advertis", "copr ", "affirmer", "interacting with it", "linking this library", "jpeg group", "cdla", "use grant", "source versions",
    "what the fuck", "invariant", "same terms as", "charityware", "me a beer", "based restrictions", "urheberrecht", "states government",
)
#: A detection's trust by priority class: tag, grant, name, address, text, notice.
TRUST = (1.0, 0.95, 0.9, 0.8, 0.7, 0.5)


def signature_rules() -> list[dict]:
    """The rules in order: no (place), class (priority, 0 first), label, keyword, regex.

    Each license gives rules for its identifier tag, for its names in a grant, for its names
    alone and for its address (two for those of Creative Commons); then come TEXTS and NOTICES,
    each line a rule of its own. All work on words joined by single spaces.
    """
    rows = [[x.strip() for x in line.split("|", 2)] for line in LICENSES.strip().splitlines()]
    out = []

    def add(kind: int, label: str, keyword: str, regex: str) -> None:
        out.append({"no": len(out), "class": kind, "label": label, "keyword": keyword, "regex": f" {regex}(?= )"})

    for label, tag, names in rows:
        add(0, label, tag, f"spdx license identifier {tag}( only| or later)?")
    for label, tag, names in rows:
        for name in names.split(";"):
            add(1, label, _sure(name), f"(licensed|released|distributed|available|published|redistributed) under( the)?( terms of)?( the)? {name.strip()}")
    for label, tag, names in rows:
        for name in names.split(";"):
            add(2, label, _sure(name), name.strip())
    for label, tag, names in rows:
        add(3, label, tag, f"(opensource|spdx|choosealicense|creativecommons) (org|com) licenses {tag}( html)?")
    for label, tag, names in rows:
        if label.startswith("cc"):
            path = "publicdomain zero 1 0" if label == "cc0-1.0" else f"licenses {tag.removeprefix('cc ')}"
            add(3, label, f"creativecommons org {path}", f"creativecommons org {path}")
    for kind, lines in ((4, TEXTS), (5, NOTICES)):
        for line in lines.strip().splitlines():
            label, keyword, regex = (x.strip() for x in line.split(" | ", 2))
            add(kind, label, keyword, regex)
    return out


def _sure(name: str) -> str:
    """The longest run of plain words that every match of the regex `name` has: its keyword."""
    import re

    plain = re.sub(r"\([^()]*\)\??|.\?|\[[^\]]*\]", "\n", name.strip())
    return max((x.strip() for x in plain.split("\n")), key=len)


def normal(text: Column) -> Column:
    """Lower-case words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, each after one space, and a last space."""
    spaced = F.regexp_replace(ascii_lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(spaced), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _base(norm: Column, n_words: Column, phrase: str) -> Column:
    """Struct n, first, last of the places of `phrase`; words are counted by the spaces before them."""
    parts = lambda p: F.struct(
        (F.size(p) - 1).alias("n"),
        _spaces(F.get(p, F.lit(0))).alias("first"),
        (n_words - (_spaces(F.get(p, F.size(p) - 1)) - 1) - len(phrase.split())).alias("last"),
    )
    return F.when(F.contains(norm, F.lit(f" {phrase} ")), let(F.split(norm, f" {phrase}(?= )", -1), parts))


def _detections(norm: Column, rules: Column) -> Column:
    """All matches of the rules whose keyword the text has, as (start, less the end, class, no, label)."""
    one = "struct<start:int,less:int,class:int,no:int,label:string>"

    def matches(r: Column) -> Column:
        def placed(gaps: Column) -> Column:
            step = lambda a, h: let(
                a["at"] + F.length(F.get(gaps, a["k"])),
                lambda s: F.struct(
                    (s + F.length(h)).alias("at"),
                    (a["k"] + 1).alias("k"),
                    F.array_append(a["out"], F.struct(s.alias("start"), (-s - F.length(h)).alias("less"), r["class"], r["no"], r["label"])).alias("out"),
                ),
            )
            start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast(f"array<{one}>").alias("out"))
            return F.when(F.size(gaps) > 1, F.aggregate(F.regexp_extract_all(norm, r["regex"], F.lit(0)), start, step, lambda a: a["out"])).otherwise(F.array().cast(f"array<{one}>"))

        return let(F.split(norm, r["regex"], -1), placed)

    return F.flatten(F.transform(F.filter(rules, lambda r: F.contains(norm, r["keyword"])), matches))


def _survivors(found: Column) -> Column:
    """Distinct (class, label) of detections in no other's interval of the same or a higher priority.

    By start, longest first, one sweep that keeps the furthest end for each class: what contains a
    detection comes before it. Of equal intervals of one class the earlier rule stays.
    """
    def step(a: Column, d: Column) -> Column:
        inside = F.exists(F.slice(a["ends"], 1, d["class"] + 1), lambda e: e >= -d["less"])
        return F.struct(
            F.transform(a["ends"], lambda e, c: F.when(c == d["class"], F.greatest(e, -d["less"])).otherwise(e)).alias("ends"),
            F.when(inside, a["out"]).otherwise(F.array_union(a["out"], F.array(F.struct(d["class"].alias("class"), d["label"].alias("label"))))).alias("out"),
        )

    start = F.struct(F.array_repeat(F.lit(-1), len(TRUST)).alias("ends"), F.array().cast("array<struct<class:int,label:string>>").alias("out"))
    return F.aggregate(F.sort_array(found), start, step, lambda a: a["out"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """License phrases and labels of each row of `docs` (doc_id, text), from its whole text.

    Returns doc_id, n_words, n_base (places of the BASE phrases), first_word, last_word (their
    smallest and largest start in words; null if none), base_labels, labels (with those of the
    signature rules; both distinct, sorted, comma-joined, empty if none) and score: the trust of
    the best surviving detection, that of a notice if only a base phrase stands, else 0.

    One pass, no shuffle: rules run only on texts that have an anchor, each only where its
    keyword stands. Null text: as empty, no words. Repeated rows and null doc_id: a row each.
    Empty table: no rows. Other columns are ignored.
    """
    schema = "array<struct<no:int,class:int,label:string,keyword:string,regex:string>>"
    rules = F.from_json(F.lit(json.dumps(signature_rules())), schema)
    norm, n = F.col("norm"), F.col("n_words")
    anchored = F.contains(norm, F.lit(ANCHORS[0]))
    for a in ANCHORS[1:]:
        anchored = anchored | F.contains(norm, F.lit(a))
    none = F.array().cast("array<struct<class:int,label:string>>")
    base = [f"base{k}" for k in range(len(BASE))]
    found = lambda f: F.array(*[f(F.col(b)) for b in base])
    names = F.filter(F.array(*[F.when(F.col(b).isNotNull(), F.lit(x)) for b, (_, x) in zip(base, BASE, strict=True)]), lambda x: x.isNotNull())
    trust = F.array(*[F.lit(x) for x in TRUST])
    joined = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal(whole("text")).alias("norm"))
        .withColumn("n_words", F.when(F.length(norm) <= 2, 0).otherwise(_spaces(norm) - 1).cast("long"))
        .select("doc_id", "n_words", *[_base(norm, n, p).alias(b) for b, (p, _) in zip(base, BASE, strict=True)],
                F.when(anchored, _survivors(_detections(norm, rules))).otherwise(none).alias("found"))
        .withColumn("base_names", names)
        .select(
            "doc_id", "n_words",
            F.aggregate(found(lambda b: F.coalesce(b["n"], F.lit(0))), F.lit(0), lambda a, x: a + x).cast("long").alias("n_base"),
            F.array_min(found(lambda b: b["first"])).cast("long").alias("first_word"),
            F.array_max(found(lambda b: b["last"])).cast("long").alias("last_word"),
            joined(F.col("base_names")).alias("base_labels"),
            joined(F.concat("base_names", F.transform("found", lambda d: d["label"]))).alias("labels"),
            F.coalesce(F.array_max(F.transform("found", lambda d: F.get(trust, d["class"]))), F.when(F.size("base_names") > 0, TRUST[-1]), F.lit(0.0)).alias("score"),
        )
    )
