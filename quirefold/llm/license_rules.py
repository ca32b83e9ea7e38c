r"""Signature rules of licenses, written by hand: label ; priority ; keywords ; regex.

Regexes are for text with A-Z lowered. A blank in them is white space of any kind, with comment marks after a line break.
Both ends must not touch a letter or a digit, and no further digit of a version may follow. A rule is tried on texts
that hold one of its keywords (plain strings without white space, every match holds one of them; a&b: both).

Priorities: 95 license identifiers in tags, 90 addresses, 85 full grants, 80 names with a version, 70 short names with a
version, 60 names, 55 phrases of license texts, 40 bare families, 20 vague hints.
"""

RULES = r"""
gpl-1.0 ; 95 ; spdx ; spdx-license-identifier: gpl-1\.0(?:\+|-only|-or-later)?
gpl-2.0 ; 95 ; spdx ; spdx-license-identifier: gpl-2\.0(?:\+|-only|-or-later)?
gpl-3.0 ; 95 ; spdx ; spdx-license-identifier: gpl-3\.0(?:\+|-only|-or-later)?
lgpl-2.0 ; 95 ; spdx ; spdx-license-identifier: lgpl-2\.0(?:\+|-only|-or-later)?
lgpl-2.1 ; 95 ; spdx ; spdx-license-identifier: lgpl-2\.1(?:\+|-only|-or-later)?
lgpl-3.0 ; 95 ; spdx ; spdx-license-identifier: lgpl-3\.0(?:\+|-only|-or-later)?
agpl-1.0 ; 95 ; spdx ; spdx-license-identifier: agpl-1\.0(?:\+|-only|-or-later)?
agpl-3.0 ; 95 ; spdx ; spdx-license-identifier: agpl-3\.0(?:\+|-only|-or-later)?
gfdl-1.3 ; 95 ; spdx ; spdx-license-identifier: gfdl-1\.3(?:-only|-or-later)?
apache-1.1 ; 95 ; spdx ; spdx-license-identifier: apache-1\.1
apache-2.0 ; 95 ; spdx ; spdx-license-identifier: apache-2\.0
mit ; 95 ; spdx ; spdx-license-identifier: mit(?!-)
mit-0 ; 95 ; spdx ; spdx-license-identifier: mit-0
isc ; 95 ; spdx ; spdx-license-identifier: isc
bsd-0-clause ; 95 ; spdx ; spdx-license-identifier: 0bsd
bsd-2-clause ; 95 ; spdx ; spdx-license-identifier: bsd-2-clause
bsd-3-clause ; 95 ; spdx ; spdx-license-identifier: bsd-3-clause
bsd-4-clause ; 95 ; spdx ; spdx-license-identifier: bsd-4-clause
mpl-1.1 ; 95 ; spdx ; spdx-license-identifier: mpl-1\.1
mpl-2.0 ; 95 ; spdx ; spdx-license-identifier: mpl-2\.0
epl-1.0 ; 95 ; spdx ; spdx-license-identifier: epl-1\.0
epl-2.0 ; 95 ; spdx ; spdx-license-identifier: epl-2\.0
cddl-1.0 ; 95 ; spdx ; spdx-license-identifier: cddl-1\.0
eupl-1.2 ; 95 ; spdx ; spdx-license-identifier: eupl-1\.2
bsl-1.0 ; 95 ; spdx ; spdx-license-identifier: bsl-1\.0
busl-1.1 ; 95 ; spdx ; spdx-license-identifier: busl-1\.1
cc0 ; 95 ; spdx ; spdx-license-identifier: cc0-1\.0
cc-by-3.0 ; 95 ; spdx ; spdx-license-identifier: cc-by-3\.0
cc-by-4.0 ; 95 ; spdx ; spdx-license-identifier: cc-by-4\.0
cc-by-sa-3.0 ; 95 ; spdx ; spdx-license-identifier: cc-by-sa-3\.0
cc-by-sa-4.0 ; 95 ; spdx ; spdx-license-identifier: cc-by-sa-4\.0
cc-by-nc-4.0 ; 95 ; spdx ; spdx-license-identifier: cc-by-nc-4\.0
unlicense ; 95 ; spdx ; spdx-license-identifier: unlicense
zlib ; 95 ; spdx ; spdx-license-identifier: zlib
wtfpl ; 95 ; spdx ; spdx-license-identifier: wtfpl
artistic-2.0 ; 95 ; spdx ; spdx-license-identifier: artistic-2\.0
ofl-1.1 ; 95 ; spdx ; spdx-license-identifier: ofl-1\.1
postgresql ; 95 ; spdx ; spdx-license-identifier: postgresql
ncsa ; 95 ; spdx ; spdx-license-identifier: ncsa
upl-1.0 ; 95 ; spdx ; spdx-license-identifier: upl-1\.0
gpl-2.0 ; 90 ; gnu.org ; gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.[a-z]+)?
gpl-3.0 ; 90 ; gnu.org ; gnu\.org/licenses/gpl-3\.0(?:\.[a-z]+)?
lgpl-2.1 ; 90 ; gnu.org ; gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1(?:\.[a-z]+)?
lgpl-3.0 ; 90 ; gnu.org ; gnu\.org/licenses/lgpl-3\.0(?:\.[a-z]+)?
agpl-3.0 ; 90 ; gnu.org ; gnu\.org/licenses/agpl-3\.0(?:\.[a-z]+)?
gfdl-1.3 ; 90 ; gnu.org ; gnu\.org/licenses/fdl-1\.3(?:\.[a-z]+)?
apache-1.1 ; 90 ; apache.org ; apache\.org/licenses/license-1\.1
apache-2.0 ; 90 ; apache.org ; apache\.org/licenses/license-2\.0(?:\.[a-z]+)?
mit ; 90 ; opensource.org ; opensource\.org/licenses?/mit(?:-license)?(?:\.php)?
isc ; 90 ; opensource.org ; opensource\.org/licenses?/isc(?:-license)?
bsd-2-clause ; 90 ; opensource.org ; opensource\.org/licenses?/bsd-2-clause
bsd-3-clause ; 90 ; opensource.org ; opensource\.org/licenses?/bsd-3-clause
mpl-2.0 ; 90 ; mozilla.org ; mozilla\.org/(?:en-us/)?mpl/2\.0/?
mpl-1.1 ; 90 ; mozilla.org ; mozilla\.org/mpl/mpl-1\.1(?:\.[a-z]+)?
epl-1.0 ; 90 ; eclipse.org ; eclipse\.org/legal/epl-v10(?:\.[a-z]+)?
epl-2.0 ; 90 ; eclipse.org ; eclipse\.org/legal/epl-(?:2\.0|v20)(?:\.[a-z]+)?
bsl-1.0 ; 90 ; boost.org ; boost\.org/license_1_0\.txt
unlicense ; 90 ; unlicense.org ; unlicense\.org
ofl-1.1 ; 90 ; sil.org ; scripts\.sil\.org/ofl
wtfpl ; 90 ; wtfpl.net ; wtfpl\.net
odbl-1.0 ; 90 ; opendatacommons ; opendatacommons\.org/licenses/odbl(?:/1[.-]0)?
odc-by-1.0 ; 90 ; opendatacommons ; opendatacommons\.org/licenses/by(?:/1[.-]0)?
pddl-1.0 ; 90 ; opendatacommons ; opendatacommons\.org/licenses/pddl(?:/1[.-]0)?
cc-by-1.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by/1\.0
cc-by-2.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by/2\.0
cc-by-2.5 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by/2\.5
cc-by-3.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by/3\.0
cc-by-4.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by/4\.0
cc-by-sa-1.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by-sa/1\.0
cc-by-sa-2.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by-sa/2\.0
cc-by-sa-2.5 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by-sa/2\.5
cc-by-sa-3.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by-sa/3\.0
cc-by-sa-4.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by-sa/4\.0
cc-by-nd-3.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by-nd/3\.0
cc-by-nd-4.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by-nd/4\.0
cc-by-nc-2.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by-nc/2\.0
cc-by-nc-3.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by-nc/3\.0
cc-by-nc-4.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-sa-2.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by-nc-sa/2\.0
cc-by-nc-sa-3.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-sa-4.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-nd-2.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by-nc-nd/2\.0
cc-by-nc-nd-3.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by-nc-nd/3\.0
cc-by-nc-nd-4.0 ; 90 ; creativecommons.org ; creativecommons\.org/licenses/by-nc-nd/4\.0
cc0 ; 90 ; creativecommons.org ; creativecommons\.org/publicdomain/zero(?:/1\.0)?
public-domain ; 90 ; creativecommons.org ; creativecommons\.org/(?:publicdomain/mark(?:/1\.0)?|licenses/publicdomain)
gpl-2.0 ; 85 ; gnu&licen ; gnu general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 2(?: of the licen[cs]e,? or \(?at your option\)? any later version)?
gpl-3.0 ; 85 ; gnu&licen ; gnu general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 3(?: of the licen[cs]e,? or \(?at your option\)? any later version)?
lgpl-2.1 ; 85 ; gnu&licen ; gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 2(?:\.1)?(?: of the licen[cs]e,? or \(?at your option\)? any later version)?
lgpl-3.0 ; 85 ; gnu&licen ; gnu lesser general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 3(?: of the licen[cs]e,? or \(?at your option\)? any later version)?
agpl-3.0 ; 85 ; affero&licen ; gnu affero general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 3(?: of the licen[cs]e,? or \(?at your option\)? any later version)?
apache-2.0 ; 85 ; apache&licen ; licen[cs]ed under the apache licen[cs]e,? version 2\.0(?: \(the "license"\))?
mit ; 85 ; granted ; permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
isc ; 85 ; permission ; permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that
bsd-0-clause ; 85 ; permission ; permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted\.
bsd-3-clause ; 85 ; redistribution ; redistribution and use in source and binary forms, with or without modification, are permitted provided that .{1,900}neither the names? of .{1,160} may be used to endorse or promote
bsd-4-clause ; 85 ; advertising ; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
mpl-2.0 ; 85 ; mozilla&licen ; this source code form is subject to the terms of the mozilla public licen[cs]e,? v\. 2\.0
mpl-1.1 ; 85 ; mozilla&licen ; the contents of this file are subject to the mozilla public licen[cs]e version 1\.1
epl-1.0 ; 85 ; eclipse&licen ; made available under the terms of the eclipse public licen[cs]e v1\.0
epl-2.0 ; 85 ; eclipse&licen ; made available under the terms of the eclipse public licen[cs]e (?:v\. ?)?2\.0
unlicense ; 85 ; unencumbered ; this is free and unencumbered software released into the public domain
bsl-1.0 ; 85 ; boost&licen ; distributed under the boost software licen[cs]e,? version 1\.0
zlib ; 85 ; as-is ; this software is provided ['"‘]as-is['"’],? without any express or implied warranty\. in no event will the authors be held liable
wtfpl ; 85 ; fuck ; do what the fuck you want to(?: public licen[cs]e)?
ofl-1.1 ; 85 ; sil&licen ; this font software is licen[cs]ed under the sil open font licen[cs]e,? version 1\.1
postgresql ; 85 ; permission ; permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
beerware ; 85 ; stuff ; as long as you retain this notice you can do whatever you want with this stuff
json ; 85 ; evil ; the software shall be used for good, not evil
gpl-1.0 ; 80 ; gnu&licen ; gnu general public licen[cs]e,? \(?(?:version|v\.?) ?1(?:\.0)?
gpl-2.0 ; 80 ; gnu&licen ; gnu general public licen[cs]e,? \(?(?:version|v\.?)? ?2(?:\.0)?(?:,? or \(?(?:at your option\)? )?(?:any )?later(?: version)?)?
gpl-3.0 ; 80 ; gnu&licen ; gnu general public licen[cs]e,? \(?(?:version|v\.?)? ?3(?:\.0)?(?:,? or \(?(?:at your option\)? )?(?:any )?later(?: version)?)?
lgpl-2.0 ; 80 ; gnu&licen ; gnu (?:lesser|library) general public licen[cs]e,? \(?(?:version|v\.?)? ?2(?:\.0)?(?:,? or \(?(?:at your option\)? )?(?:any )?later(?: version)?)?
lgpl-2.1 ; 80 ; gnu&licen ; gnu (?:lesser|library) general public licen[cs]e,? \(?(?:version|v\.?)? ?2\.1(?:,? or \(?(?:at your option\)? )?(?:any )?later(?: version)?)?
lgpl-3.0 ; 80 ; gnu&licen ; gnu (?:lesser|library) general public licen[cs]e,? \(?(?:version|v\.?)? ?3(?:\.0)?(?:,? or \(?(?:at your option\)? )?(?:any )?later(?: version)?)?
agpl-1.0 ; 80 ; affero&licen ; affero general public licen[cs]e,? \(?(?:version|v\.?)? ?1(?:\.0)?
agpl-3.0 ; 80 ; affero&licen ; (?:gnu )?affero general public licen[cs]e,? \(?(?:version|v\.?)? ?3(?:\.0)?(?:,? or \(?(?:at your option\)? )?(?:any )?later(?: version)?)?
gfdl-1.1 ; 80 ; gnu&licen ; gnu free documentation licen[cs]e,? \(?(?:version|v\.?)? ?1\.1
gfdl-1.2 ; 80 ; gnu&licen ; gnu free documentation licen[cs]e,? \(?(?:version|v\.?)? ?1\.2
gfdl-1.3 ; 80 ; gnu&licen ; gnu free documentation licen[cs]e,? \(?(?:version|v\.?)? ?1\.3
apache-1.0 ; 80 ; apache&licen ; apache (?:software )?licen[cs]e,? \(?(?:version|v\.?)? ?1\.0
apache-1.1 ; 80 ; apache&licen ; apache (?:software )?licen[cs]e,? \(?(?:version|v\.?)? ?1\.1
apache-2.0 ; 80 ; apache&licen ; apache (?:software )?licen[cs]e,? \(?(?:version|v\.?)? ?2(?:\.0)?
mpl-1.0 ; 80 ; mozilla&licen ; mozilla public licen[cs]e,? \(?(?:version|v\.?)? ?1\.0
mpl-1.1 ; 80 ; mozilla&licen ; mozilla public licen[cs]e,? \(?(?:version|v\.?)? ?1\.1
mpl-2.0 ; 80 ; mozilla&licen ; mozilla public licen[cs]e,? \(?(?:version|v\.?)? ?2(?:\.0)?
npl-1.1 ; 80 ; netscape&licen ; netscape public licen[cs]e,? \(?(?:version|v\.?)? ?1\.[01]
epl-1.0 ; 80 ; eclipse ; eclipse public licen[cs]e,? (?:-|\()? ?(?:version|v\.?)? ?1(?:\.0)?
epl-2.0 ; 80 ; eclipse ; eclipse public licen[cs]e,? (?:-|\()? ?(?:version|v\.?)? ?2(?:\.0)?
edl-1.0 ; 80 ; eclipse ; eclipse distribution licen[cs]e,? (?:-|\()? ?(?:version|v\.?)? ?1(?:\.0)?
cpl-1.0 ; 80 ; common&licen ; common public licen[cs]e,? \(?(?:version|v\.?)? ?1(?:\.0)?
ipl-1.0 ; 80 ; ibm&licen ; ibm public licen[cs]e,? \(?(?:version|v\.?)? ?1(?:\.0)?
cddl-1.0 ; 80 ; common&licen ; common development and distribution licen[cs]e,? \(?(?:cddl\)?,? )?(?:version|v\.?)? ?1(?:\.0)?
cddl-1.1 ; 80 ; common&licen ; common development and distribution licen[cs]e,? \(?(?:cddl\)?,? )?(?:version|v\.?)? ?1\.1
eupl-1.0 ; 80 ; european&licen ; european union public licen[cs]e,? \(?(?:eupl\)?,? )?(?:version|v\.?)? ?1\.0
eupl-1.1 ; 80 ; european&licen ; european union public licen[cs]e,? \(?(?:eupl\)?,? )?(?:version|v\.?)? ?1\.1
eupl-1.2 ; 80 ; european&licen ; european union public licen[cs]e,? \(?(?:eupl\)?,? )?(?:version|v\.?)? ?1\.2
artistic-1.0 ; 80 ; artistic&licen ; (?:perl )?artistic licen[cs]e,? \(?(?:version|v\.?)? ?1(?:\.0)?
artistic-2.0 ; 80 ; artistic&licen ; artistic licen[cs]e,? \(?(?:version|v\.?)? ?2(?:\.0)?
osl-1.0 ; 80 ; open&licen ; open software licen[cs]e,? \(?(?:version|v\.?)? ?1\.0
osl-2.0 ; 80 ; open&licen ; open software licen[cs]e,? \(?(?:version|v\.?)? ?2\.0
osl-2.1 ; 80 ; open&licen ; open software licen[cs]e,? \(?(?:version|v\.?)? ?2\.1
osl-3.0 ; 80 ; open&licen ; open software licen[cs]e,? \(?(?:version|v\.?)? ?3(?:\.0)?
afl-2.1 ; 80 ; academic&licen ; academic free licen[cs]e,? \(?(?:version|v\.?)? ?2\.1
afl-3.0 ; 80 ; academic&licen ; academic free licen[cs]e,? \(?(?:version|v\.?)? ?3(?:\.0)?
ofl-1.0 ; 80 ; open&licen ; (?:sil )?open font licen[cs]e,? \(?(?:version|v\.?)? ?1\.0
ofl-1.1 ; 80 ; open&licen ; (?:sil )?open font licen[cs]e,? \(?(?:version|v\.?)? ?1\.1
lppl-1.0 ; 80 ; latex&licen ; latex project public licen[cs]e,? \(?(?:version|v\.?)? ?1\.0
lppl-1.2 ; 80 ; latex&licen ; latex project public licen[cs]e,? \(?(?:version|v\.?)? ?1\.2
lppl-1.3 ; 80 ; latex&licen ; latex project public licen[cs]e,? \(?(?:version|v\.?)? ?1\.3[ac]?
zpl-2.0 ; 80 ; zope&licen ; zope public licen[cs]e,? \(?(?:zpl\)?,? )?(?:version|v\.?)? ?2\.0
zpl-2.1 ; 80 ; zope&licen ; zope public licen[cs]e,? \(?(?:zpl\)?,? )?(?:version|v\.?)? ?2\.1
bsl-1.0 ; 80 ; boost ; boost software licen[cs]e,? (?:-|\()? ?(?:version|v\.?)? ?1(?:\.0)?
psf-2.0 ; 80 ; python&licen ; python software foundation licen[cs]e,? \(?(?:version|v\.?)? ?2
cecill-1.0 ; 80 ; cecill ; cecill(?: free software licen[cs]e agreement)?,? (?:version|v\.?)? ?1\.0
cecill-2.0 ; 80 ; cecill ; cecill(?: free software licen[cs]e agreement)?,? (?:version|v\.?)? ?2\.0
cecill-2.1 ; 80 ; cecill ; cecill(?: free software licen[cs]e agreement)?,? (?:version|v\.?)? ?2\.1
php-3.0 ; 80 ; php&licen ; php licen[cs]e,? \(?(?:version|v\.?)? ?3\.0
php-3.01 ; 80 ; php&licen ; php licen[cs]e,? \(?(?:version|v\.?)? ?3\.01
upl-1.0 ; 80 ; universal&licen ; universal permissive licen[cs]e,? \(?(?:upl\)?,? )?(?:version|v\.?)? ?1\.0
odbl-1.0 ; 80 ; database&licen ; open (?:data commons )?(?:open )?database licen[cs]e,? \(?(?:odbl\)?,? )?(?:version|v\.?)? ?1\.0
odc-by-1.0 ; 80 ; attribution&licen ; open data commons attribution licen[cs]e,? \(?(?:version|v\.?)? ?1\.0
sspl-1.0 ; 80 ; server&licen ; server side public licen[cs]e,? \(?(?:version|v\.?)? ?1(?:\.0)?
busl-1.1 ; 80 ; business&licen ; business source licen[cs]e,? \(?(?:version|v\.?)? ?1\.1
elastic-2.0 ; 80 ; elastic&licen ; elastic licen[cs]e,? \(?(?:version|v\.?)? ?2(?:\.0)?
ms-pl ; 80 ; microsoft&licen ; microsoft public licen[cs]e(?: \(ms-pl\))?
ms-rl ; 80 ; microsoft&licen ; microsoft reciprocal licen[cs]e(?: \(ms-rl\))?
cc-by-1.0 ; 80 ; commons ; creative commons attribution ?(?:licen[cs]e)?,? ?(?:version)? ?1\.0
cc-by-2.0 ; 80 ; commons ; creative commons attribution ?(?:generic )?(?:licen[cs]e)?,? ?(?:version)? ?2\.0
cc-by-2.5 ; 80 ; commons ; creative commons attribution ?(?:generic )?(?:licen[cs]e)?,? ?(?:version)? ?2\.5
cc-by-3.0 ; 80 ; commons ; creative commons attribution ?(?:unported )?(?:licen[cs]e)?,? ?(?:version)? ?3\.0
cc-by-4.0 ; 80 ; commons ; creative commons attribution ?(?:international )?(?:licen[cs]e)?,? ?(?:version)? ?4\.0
cc-by-sa-2.0 ; 80 ; commons ; creative commons attribution[ ,-]+share ?-?alike ?(?:licen[cs]e)?,? ?(?:version)? ?2\.0
cc-by-sa-2.5 ; 80 ; commons ; creative commons attribution[ ,-]+share ?-?alike ?(?:licen[cs]e)?,? ?(?:version)? ?2\.5
cc-by-sa-3.0 ; 80 ; commons ; creative commons attribution[ ,-]+share ?-?alike ?(?:licen[cs]e)?,? ?(?:version)? ?3\.0
cc-by-sa-4.0 ; 80 ; commons ; creative commons attribution[ ,-]+share ?-?alike ?(?:licen[cs]e)?,? ?(?:version)? ?4\.0
cc-by-nd-3.0 ; 80 ; commons ; creative commons attribution[ ,-]+no ?-?deriv(?:ative)?s?(?: works)? ?(?:licen[cs]e)?,? ?(?:version)? ?3\.0
cc-by-nd-4.0 ; 80 ; commons ; creative commons attribution[ ,-]+no ?-?deriv(?:ative)?s?(?: works)? ?(?:licen[cs]e)?,? ?(?:version)? ?4\.0
cc-by-nc-3.0 ; 80 ; commons ; creative commons attribution[ ,-]+non-?commercial ?(?:licen[cs]e)?,? ?(?:version)? ?3\.0
cc-by-nc-4.0 ; 80 ; commons ; creative commons attribution[ ,-]+non-?commercial ?(?:licen[cs]e)?,? ?(?:version)? ?4\.0
cc-by-nc-sa-3.0 ; 80 ; commons ; creative commons attribution[ ,-]+non-?commercial[ ,-]+share ?-?alike ?(?:licen[cs]e)?,? ?(?:version)? ?3\.0
cc-by-nc-sa-4.0 ; 80 ; commons ; creative commons attribution[ ,-]+non-?commercial[ ,-]+share ?-?alike ?(?:licen[cs]e)?,? ?(?:version)? ?4\.0
cc-by-nc-nd-3.0 ; 80 ; commons ; creative commons attribution[ ,-]+non-?commercial[ ,-]+no ?-?deriv(?:ative)?s?(?: works)? ?(?:licen[cs]e)?,? ?(?:version)? ?3\.0
cc-by-nc-nd-4.0 ; 80 ; commons ; creative commons attribution[ ,-]+non-?commercial[ ,-]+no ?-?deriv(?:ative)?s?(?: works)? ?(?:licen[cs]e)?,? ?(?:version)? ?4\.0
gpl-1.0 ; 70 ; gpl ; (?:gnu )?gpl(?:[- ]?v|,? version |[- ])1(?:\.0)?(?:\+|-only|-or-later)?
gpl-2.0 ; 70 ; gpl ; (?:gnu )?gpl(?:[- ]?v|,? version |[- ])?2(?:\.0)?(?:\+|-only|-or-later)?
gpl-3.0 ; 70 ; gpl ; (?:gnu )?gpl(?:[- ]?v|,? version |[- ])?3(?:\.0)?(?:\+|-only|-or-later)?
lgpl-2.0 ; 70 ; lgpl ; (?:gnu )?lgpl(?:[- ]?v|,? version |[- ])?2(?:\.0)?(?:\+|-only|-or-later)?
lgpl-2.1 ; 70 ; lgpl ; (?:gnu )?lgpl(?:[- ]?v|,? version |[- ])?2\.1(?:\+|-only|-or-later)?
lgpl-3.0 ; 70 ; lgpl ; (?:gnu )?lgpl(?:[- ]?v|,? version |[- ])?3(?:\.0)?(?:\+|-only|-or-later)?
agpl-3.0 ; 70 ; agpl ; (?:gnu )?agpl(?:[- ]?v|,? version |[- ])?3(?:\.0)?(?:\+|-only|-or-later)?
gfdl-1.2 ; 70 ; gfdl ; gfdl(?:[- ]?v|,? version |[- ])?1\.2
gfdl-1.3 ; 70 ; gfdl ; gfdl(?:[- ]?v|,? version |[- ])?1\.3
apache-2.0 ; 70 ; apache ; apache(?:[- ]?v|,? version |[- ])2(?:\.0)?
mpl-1.1 ; 70 ; mpl ; mpl(?:[- ]?v|,? version |[- ])?1\.1
mpl-2.0 ; 70 ; mpl ; mpl(?:[- ]?v|,? version |[- ])?2(?:\.0)?
epl-1.0 ; 70 ; epl ; epl(?:[- ]?v|,? version |[- ])?1(?:\.0)?
epl-2.0 ; 70 ; epl ; epl(?:[- ]?v|,? version |[- ])?2(?:\.0)?
cddl-1.0 ; 70 ; cddl ; cddl(?:[- ]?v|,? version |[- ])?1(?:\.0)?
eupl-1.1 ; 70 ; eupl ; eupl(?:[- ]?v|,? version |[- ])?1\.1
eupl-1.2 ; 70 ; eupl ; eupl(?:[- ]?v|,? version |[- ])?1\.2
ofl-1.1 ; 70 ; ofl ; (?:sil )?ofl(?:[- ]?v|,? version |[- ])?1\.1
sspl-1.0 ; 70 ; sspl ; sspl(?:[- ]?v|,? version |[- ])?1(?:\.0)?
cc-by-3.0 ; 70 ; cc ; cc[- ]by[- ]3\.0
cc-by-4.0 ; 70 ; cc ; cc[- ]by[- ]4\.0
cc-by-sa-3.0 ; 70 ; cc ; cc[- ]by[- ]sa[- ]3\.0
cc-by-sa-4.0 ; 70 ; cc ; cc[- ]by[- ]sa[- ]4\.0
cc-by-nd-4.0 ; 70 ; cc ; cc[- ]by[- ]nd[- ]4\.0
cc-by-nc-3.0 ; 70 ; cc ; cc[- ]by[- ]nc[- ]3\.0
cc-by-nc-4.0 ; 70 ; cc ; cc[- ]by[- ]nc[- ]4\.0
cc-by-nc-sa-3.0 ; 70 ; cc ; cc[- ]by[- ]nc[- ]sa[- ]3\.0
cc-by-nc-sa-4.0 ; 70 ; cc ; cc[- ]by[- ]nc[- ]sa[- ]4\.0
cc-by-nc-nd-4.0 ; 70 ; cc ; cc[- ]by[- ]nc[- ]nd[- ]4\.0
cc0 ; 70 ; cc0 ; cc0(?:[- ]1\.0)?(?: universal)?
cc0 ; 70 ; zero ; (?:cc|creative commons) zero
bsd-0-clause ; 70 ; bsd ; (?:zero[- ]clause bsd|0bsd|bsd[- ]?0[- ]clause)
bsd-2-clause ; 70 ; bsd ; (?:simplified|freebsd|2[- ]clause|two[- ]clause) bsd(?: licen[cs]e)?
bsd-2-clause ; 70 ; bsd ; bsd[- ]2[- ]clause
bsd-3-clause ; 70 ; bsd ; (?:new|revised|modified|3[- ]clause|three[- ]clause) bsd(?: licen[cs]e)?
bsd-3-clause ; 70 ; bsd ; bsd[- ]3[- ]clause
bsd-4-clause ; 70 ; bsd ; (?:original|old|4[- ]clause|four[- ]clause) bsd(?: licen[cs]e)?
bsd-4-clause ; 70 ; bsd ; bsd[- ]4[- ]clause
mit ; 60 ; mit&licen ; mit[- ]licen[cs]e
mit ; 60 ; mit&under ; (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of the )?mit(?: licen[cs]e)?
mit ; 60 ; expat&licen ; expat licen[cs]e
x11 ; 60 ; x11&licen ; x11 licen[cs]e
x11 ; 60 ; consortium&licen ; (?:x|mit/x) consortium licen[cs]e
isc ; 60 ; isc&licen ; isc licen[cs]e
unlicense ; 60 ; unlicense ; the unlicense
zlib ; 60 ; zlib&licen ; zlib(?:/libpng)? licen[cs]e
wtfpl ; 60 ; wtfpl ; wtfpl
postgresql ; 60 ; postgresql&licen ; postgresql licen[cs]e
openssl ; 60 ; openssl&licen ; openssl licen[cs]e
ruby ; 60 ; ruby&licen ; ruby licen[cs]e
vim ; 60 ; vim&licen ; vim licen[cs]e
curl ; 60 ; curl&licen ; curl licen[cs]e
beerware ; 60 ; beer&licen ; beer-?ware licen[cs]e
ncsa ; 60 ; illinois&licen ; university of illinois/ncsa open source licen[cs]e
ncsa ; 60 ; ncsa&licen ; ncsa open source licen[cs]e
fair ; 60 ; fair&licen ; fair licen[cs]e
sleepycat ; 60 ; sleepycat&licen ; sleepycat licen[cs]e
w3c ; 60 ; w3c&licen ; w3c software (?:notice and )?licen[cs]e
ftl ; 60 ; freetype&licen ; freetype (?:project )?licen[cs]e
ijg ; 60 ; jpeg&licen ; independent jpeg group(?:'s)? licen[cs]e
libpng ; 60 ; libpng&licen ; libpng licen[cs]e
icu ; 60 ; icu&licen ; icu licen[cs]e
unicode ; 60 ; unicode&licen ; unicode(?:,? inc\.?)? licen[cs]e agreement
intel ; 60 ; intel&licen ; intel open source licen[cs]e
naumen ; 60 ; naumen&licen ; naumen public licen[cs]e
nokia ; 60 ; nokia&licen ; nokia open source licen[cs]e
qpl ; 60 ; public&licen ; q public licen[cs]e
rpl ; 60 ; reciprocal&licen ; reciprocal public licen[cs]e
sissl ; 60 ; industry&licen ; sun industry standards source licen[cs]e
spl ; 60 ; sun&licen ; sun public licen[cs]e
watcom ; 60 ; watcom&licen ; sybase open watcom public licen[cs]e
vsl ; 60 ; vovida&licen ; vovida software licen[cs]e
ecl ; 60 ; educational&licen ; educational community licen[cs]e
efl ; 60 ; eiffel&licen ; eiffel forum licen[cs]e
entessa ; 60 ; entessa&licen ; entessa public licen[cs]e
eudatagrid ; 60 ; datagrid&licen ; eu datagrid software licen[cs]e
hpnd ; 60 ; historical ; historical permission notice and disclaimer
lucent ; 60 ; lucent&licen ; lucent public licen[cs]e
miros ; 60 ; miros&licen ; miros licen[cs]e
motosoto ; 60 ; motosoto&licen ; motosoto open source licen[cs]e
multics ; 60 ; multics&licen ; multics licen[cs]e
apsl ; 60 ; apple&licen ; apple public source licen[cs]e
aladdin ; 60 ; aladdin&licen ; aladdin free public licen[cs]e
polyform ; 60 ; polyform&licen ; polyform (?:noncommercial|strict|shield|perimeter|small business|internal use|free trial) licen[cs]e
commons-clause ; 60 ; commons ; commons clause(?: licen[cs]e condition)?
prosperity ; 60 ; prosperity&licen ; prosperity public licen[cs]e
parity ; 60 ; parity&licen ; parity public licen[cs]e
blueoak-1.0 ; 60 ; blue&licen ; blue oak model licen[cs]e
mulan ; 60 ; mulan ; mulan (?:psl|permissive software licen[cs]e|pubs?l)
openrail ; 60 ; rail&licen ; (?:creativeml )?open ?rail(?:\+\+)?-?m? licen[cs]e
llama ; 60 ; llama&licen ; llama ?[23]?(?:\.\d)? community licen[cs]e
gemma ; 60 ; gemma ; gemma terms of use
cc-sampling ; 60 ; sampling ; creative commons sampling(?: plus)?
dl-de ; 60 ; deutschland ; datenlizenz deutschland
ogl-uk ; 60 ; government&licen ; open government licen[cs]e
etalab ; 60 ; etalab,ouverte ; licence ouverte|etalab open licen[cs]e
free-art ; 60 ; art ; free art licen[cs]e|licence art libre
oasis ; 60 ; oasis ; oasis ipr policy
apache-2.0 ; 55 ; perpetual ; grants? to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:copyright|patent|\(except)
gpl-3.0 ; 55 ; copyleft&licen ; the gnu general public licen[cs]e is a free, copyleft licen[cs]e for software and other kinds of works
gpl ; 55 ; warranty&licen ; without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu (?:lesser |library |affero )?general public licen[cs]e
gpl ; 55 ; free ; this program is free software[;:,] you can redistribute it and/or modify it under the terms
mit ; 55 ; notice ; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
bsd ; 55 ; redistribution ; redistribution and use in source and binary forms, with or without modification
bsd-3-clause ; 55 ; contributors ; neither the names? of .{1,160} nor the names of (?:its|their) contributors
zlib ; 55 ; misrepresented ; the origin of this software must not be misrepresented; you must not claim that you wrote the original software
bsl-1.0 ; 55 ; boost&licen ; boost software licen[cs]e - version 1\.0 - august 17th, 2003
ofl ; 55 ; reserved ; reserved font name
public-domain ; 55 ; domain ; (?:released|placed|dedicated|donated) (?:in)?to the public domain
public-domain ; 55 ; domain ; public domain (?:dedication|mark)
cc-by-1.0 ; 45 ; attribution ; attribution 1\.0 generic
cc-by-4.0 ; 45 ; attribution ; attribution 4\.0 international
cc-by-sa-4.0 ; 45 ; attribution ; attribution-sharealike 4\.0 international
cc-by-nc-4.0 ; 45 ; attribution ; attribution-noncommercial 4\.0 international
cc-by-nc-sa-4.0 ; 45 ; attribution ; attribution-noncommercial-sharealike 4\.0 international
cc-by-nc-nd-4.0 ; 45 ; attribution ; attribution-noncommercial-noderivatives 4\.0 international
lgpl ; 40 ; general&licen ; (?:gnu )?(?:lesser|library) general public licen[cs]e
agpl ; 40 ; affero&licen ; (?:gnu )?affero general public licen[cs]e
gpl ; 40 ; general&licen ; (?:gnu )?general public licen[cs]e
gfdl ; 40 ; documentation&licen ; (?:gnu )?free documentation licen[cs]e
gpl ; 40 ; gpl ; gpl
lgpl ; 40 ; lgpl ; lgpl
agpl ; 40 ; agpl ; agpl
apache ; 40 ; apache&licen ; apache (?:software )?licen[cs]e
mpl ; 40 ; mozilla&licen ; mozilla public licen[cs]e
epl ; 40 ; eclipse&licen ; eclipse public licen[cs]e
cpl ; 40 ; common&licen ; common public licen[cs]e
cddl ; 40 ; common&licen ; common development and distribution licen[cs]e
eupl ; 40 ; european&licen ; european union public licen[cs]e
artistic ; 40 ; artistic&licen ; artistic licen[cs]e
osl ; 40 ; open&licen ; open software licen[cs]e
afl ; 40 ; academic&licen ; academic free licen[cs]e
ofl ; 40 ; open&licen ; (?:sil )?open font licen[cs]e
lppl ; 40 ; latex&licen ; latex project public licen[cs]e
zpl ; 40 ; zope&licen ; zope public licen[cs]e
bsl ; 40 ; boost&licen ; boost software licen[cs]e
psf ; 40 ; python&licen,psf&licen ; python software foundation licen[cs]e|psf licen[cs]e
cecill ; 40 ; cecill ; cecill(?:-[bc])?
php ; 40 ; php&licen ; php licen[cs]e
upl ; 40 ; universal&licen ; universal permissive licen[cs]e
odbl ; 40 ; database&licen ; open (?:data commons )?(?:open )?database licen[cs]e
sspl ; 40 ; server&licen ; server side public licen[cs]e
busl ; 40 ; business&licen ; business source licen[cs]e
elastic ; 40 ; elastic&licen ; elastic licen[cs]e
bsd ; 40 ; bsd&licen ; bsd(?:[- ]style)? licen[cs]e
cc-by ; 40 ; cc ; cc[- ]by
cc-by-sa ; 40 ; cc ; cc[- ]by[- ]sa
cc-by-nd ; 40 ; cc ; cc[- ]by[- ]nd
cc-by-nc ; 40 ; cc ; cc[- ]by[- ]nc
cc-by-nc-sa ; 40 ; cc ; cc[- ]by[- ]nc[- ]sa
cc-by-nc-nd ; 40 ; cc ; cc[- ]by[- ]nc[- ]nd
cc-by ; 40 ; commons ; creative commons attribution
cc-by-sa ; 40 ; commons ; creative commons attribution[ ,-]+share ?-?alike
cc-by-nc ; 40 ; commons ; creative commons attribution[ ,-]+non-?commercial
cc ; 35 ; commons&licen ; creative commons licen[cs]e
proprietary ; 20 ; proprietary ; proprietary and confidential|confidential and proprietary
proprietary ; 20 ; reserved ; all rights reserved
proprietary ; 20 ; prohibited ; unauthori[sz]ed (?:copying|use|distribution|reproduction) .{0,60}(?:strictly )?prohibited
copyright-notice ; 20 ; copyright ; copyright (?:\(c\) |© )?(?:19|20)\d\d
copyright-notice ; 20 ; (c),© ; (?:\(c\)|©) ?(?:copyright )?(?:19|20)\d\d
"""
