"""The signature rules of the license scan, written by hand, one a line: label | keywords | pattern.

A pattern is tried only around its keywords, so it must hold one of them and
match no more than REACH bytes. It matches lower-cased UTF-8. A word border (\\b)
is one of words with letters of any script. Patterns take time in proportion
to what they read: no repetition is without bound or within another.
"""

from __future__ import annotations

REACH = 400

#: Names of licenses. Each is looked for in the forms of FORMS.
NAMES = r"""
mit | mit | mit(?:/x11)?
mit-0 | mit | mit[- ]0|mit no attribution
apache-2.0 | apache | apache(?:[- ]software)?(?:[- ]license)?,?[- ](?:v(?:ersion)?\W{0,2})?2(?:\.0)?
apache-1.1 | apache | apache(?:[- ]software)?(?:[- ]license)?,?[- ](?:v(?:ersion)?\W{0,2})?1\.[01]
bsd-2-clause | bsd | (?:bsd[- ]2[- ]clause|simplified[- ]bsd|freebsd)
bsd-3-clause | bsd | (?:bsd[- ]3[- ]clause|new[- ]bsd|revised[- ]bsd|modified[- ]bsd)
bsd-4-clause | bsd | (?:bsd[- ]4[- ]clause|original[- ]bsd)
0bsd | bsd | (?:0bsd|zero[- ]clause[- ]bsd)
isc | isc | isc
gpl-1.0 | gpl,general | (?:gnu[- ])?(?:gpl|general[- ]public[- ]licen[cs]e),?[- ](?:v(?:ersion)?\W{0,2})?1(?:\.0)?
gpl-2.0 | gpl,general | (?:gnu[- ])?(?:gpl|general[- ]public[- ]licen[cs]e),?[- ](?:v(?:ersion)?\W{0,2})?2(?:\.0)?
gpl-3.0 | gpl,general | (?:gnu[- ])?(?:gpl|general[- ]public[- ]licen[cs]e),?[- ](?:v(?:ersion)?\W{0,2})?3(?:\.0)?
lgpl-2.0 | lgpl,library,lesser | (?:gnu[- ])?(?:lgpl|library[- ]general[- ]public[- ]licen[cs]e),?[- ](?:v(?:ersion)?\W{0,2})?2(?:\.0)?
lgpl-2.1 | lgpl,library,lesser | (?:gnu[- ])?(?:lgpl|lesser[- ]general[- ]public[- ]licen[cs]e),?[- ](?:v(?:ersion)?\W{0,2})?2\.1
lgpl-3.0 | lgpl,library,lesser | (?:gnu[- ])?(?:lgpl|lesser[- ]general[- ]public[- ]licen[cs]e),?[- ](?:v(?:ersion)?\W{0,2})?3(?:\.0)?
agpl-3.0 | agpl,affero | (?:gnu[- ])?(?:agpl|affero[- ]general[- ]public[- ]licen[cs]e),?[- ](?:v(?:ersion)?\W{0,2})?3(?:\.0)?
gfdl | gfdl,documentation | (?:gnu[- ])?(?:gfdl|free[- ]documentation[- ]licen[cs]e)(?:,?[- ](?:v(?:ersion)?\W{0,2})?1\.[0-3])?
mpl-1.1 | mpl,mozilla | (?:mpl|mozilla[- ]public[- ]licen[cs]e),?[- ](?:v(?:ersion)?\W{0,2})?1\.[01]
mpl-2.0 | mpl,mozilla | (?:mpl|mozilla[- ]public[- ]licen[cs]e),?[- ](?:v(?:ersion)?\W{0,2})?2(?:\.0)?
epl-1.0 | epl,eclipse | (?:epl|eclipse[- ]public[- ]licen[cs]e),?[- ](?:v(?:ersion)?\W{0,2})?1(?:\.0)?
epl-2.0 | epl,eclipse | (?:epl|eclipse[- ]public[- ]licen[cs]e),?[- ](?:v(?:ersion)?\W{0,2})?2(?:\.0)?
cddl-1.0 | cddl,development | (?:cddl|common[- ]development[- ]and[- ]distribution[- ]licen[cs]e)(?:,?[- ](?:v(?:ersion)?\W{0,2})?1\.[01])?
cpl-1.0 | common | common[- ]public[- ]licen[cs]e(?:,?[- ](?:v(?:ersion)?\W{0,2})?1(?:\.0)?)?
eupl-1.1 | eupl,european | (?:eupl|european[- ]union[- ]public[- ]licen[cs]e),?[- ](?:v(?:ersion)?\W{0,2})?1\.1
eupl-1.2 | eupl,european | (?:eupl|european[- ]union[- ]public[- ]licen[cs]e),?[- ](?:v(?:ersion)?\W{0,2})?1\.2
artistic-1.0 | artistic | artistic[- ]licen[cs]e,?[- ](?:v(?:ersion)?\W{0,2})?1(?:\.0)?
artistic-2.0 | artistic | artistic[- ]licen[cs]e,?[- ](?:v(?:ersion)?\W{0,2})?2(?:\.0)?
bsl-1.0 | boost | boost[- ]software[- ]licen[cs]e(?:,?[- ](?:v(?:ersion)?\W{0,2})?1(?:\.0)?)?
busl-1.1 | busl,business | (?:busl|business[- ]source[- ]licen[cs]e),?[- ](?:v(?:ersion)?\W{0,2})?1\.1
sspl-1.0 | sspl,server | (?:sspl|server[- ]side[- ]public[- ]licen[cs]e)
elastic-2.0 | elastic | elastic[- ]licen[cs]e(?:,?[- ](?:v(?:ersion)?\W{0,2})?2(?:\.0)?)?
zlib | zlib | (?:zlib|zlib/libpng)
libpng | libpng | libpng
openssl | openssl | openssl
unlicense | unlicense | unlicense
wtfpl | wtfpl,what the f | (?:wtfpl|do what the f\w{0,9} you want to public licen[cs]e)
cc0-1.0 | cc0,zero | (?:cc0|cc[- ]zero|creative[- ]commons[- ]zero)(?:[- ]1\.0)?(?:[- ]universal)?
cc-by-1.0 | cc,commons | (?:cc[- ]by|creative[- ]commons[- ]attribution)[- ]1\.0
cc-by-2.0 | cc,commons | (?:cc[- ]by|creative[- ]commons[- ]attribution)[- ]2\.0
cc-by-2.5 | cc,commons | (?:cc[- ]by|creative[- ]commons[- ]attribution)[- ]2\.5
cc-by-3.0 | cc,commons | (?:cc[- ]by|creative[- ]commons[- ]attribution)[- ]3\.0
cc-by-4.0 | cc,commons | (?:cc[- ]by|creative[- ]commons[- ]attribution)[- ]4\.0
cc-by-sa | cc,commons | (?:cc[- ]by[- ]sa|creative[- ]commons[- ]attribution[- ]share[- ]?alike)(?:[- ][1-4]\.[05])?
cc-by-nd | cc,commons | (?:cc[- ]by[- ]nd|creative[- ]commons[- ]attribution[- ]no[- ]?deriv\w{0,9})(?:[- ][1-4]\.[05])?
cc-by-nc | cc,commons | (?:cc[- ]by[- ]nc|creative[- ]commons[- ]attribution[- ]non[- ]?commercial)(?:[- ][1-4]\.[05])?
cc-by-nc-sa | cc,commons | (?:cc[- ]by[- ]nc[- ]sa|creative[- ]commons[- ]attribution[- ]non[- ]?commercial[- ]share[- ]?alike)(?:[- ][1-4]\.[05])?
cc-by-nc-nd | cc,commons | (?:cc[- ]by[- ]nc[- ]nd|creative[- ]commons[- ]attribution[- ]non[- ]?commercial[- ]no[- ]?deriv\w{0,9})(?:[- ][1-4]\.[05])?
odbl-1.0 | odbl,database | (?:odbl|open[- ]database[- ]licen[cs]e)(?:[- ]v?1\.0)?
odc-by | odc,commons | (?:odc[- ]by|open[- ]data[- ]commons[- ]attribution)
pddl | pddl,dedication | (?:pddl|public[- ]domain[- ]dedication[- ]and[- ]licen[cs]e)
ofl-1.1 | ofl,font | (?:ofl|sil[- ]open[- ]font[- ]licen[cs]e)(?:,?[- ](?:v(?:ersion)?\W{0,2})?1\.1)?
postgresql | postgresql | postgresql
psf-2.0 | psf,python | (?:psf|python[- ]software[- ]foundation)(?:[- ]licen[cs]e)?(?:,?[- ](?:v(?:ersion)?\W{0,2})?2(?:\.0)?)?
ruby | ruby | ruby
php-3.01 | php | php[- ]licen[cs]e(?:,?[- ](?:v(?:ersion)?\W{0,2})?3\.0?1?)?
w3c | w3c | w3c(?:[- ]software)?
x11 | x11 | x11
ncsa | ncsa,illinois | (?:ncsa|university of illinois)
vim | vim | vim
intel | intel | intel[- ]open[- ]source
ibm-pl | ibm | ibm[- ]public[- ]licen[cs]e
ms-pl | ms-pl,ms pl,microsoft | (?:ms[- ]pl|microsoft[- ]public[- ]licen[cs]e)
ms-rl | ms-rl,ms rl,microsoft | (?:ms[- ]rl|microsoft[- ]reciprocal[- ]licen[cs]e)
osl-3.0 | osl,software | (?:osl|open[- ]software[- ]licen[cs]e)[- ](?:v(?:ersion)?\W{0,2})?3(?:\.0)?
afl-3.0 | afl,academic | (?:afl|academic[- ]free[- ]licen[cs]e)[- ](?:v(?:ersion)?\W{0,2})?3(?:\.0)?
cecill | cecill | cecill(?:[- ](?:b|c|v?[12]\.[01]))?
upl-1.0 | upl,universal | (?:upl|universal[- ]permissive[- ]licen[cs]e)(?:[- ]v?1\.0)?
blueoak-1.0.0 | blue | blue[- ]?oak(?:[- ]model)?(?:[- ]licen[cs]e)?
openrail | rail | (?:(?:creativeml|bigscience)[- ])?(?:open[- ]?rail|rail)(?:[- ]?\+{0,2}[ms]?)
llama-community | llama | llama(?:[- ][234](?:\.\d)?)?[- ]community[- ]licen[cs]e
polyform-nc | polyform | polyform[- ]noncommercial
""".strip().splitlines()

_GRANTS = ("licensed", "licenced", "released", "distributed", "published", "available", "covered", "provided")
#: How a name is stated: pattern around {}, keywords of which one must be in the text, confidence, priority.
FORMS = [
    (r"spdx-license-identifier\s{0,4}:\s{0,4}(?:{})\b", ("spdx-license-identifier",), 1.0, 60),
    (rf"\b(?:{'|'.join(_GRANTS)}) under (?:(?:the )?terms of )?(?:the |an? )?(?:{{}})\b(?:[- ](?:(?:public|software) )?licen[cs]e)?", tuple(f"{g} under" for g in _GRANTS), 0.95, 55),
    (r"\blicen[cs]e\s{0,4}[:=]\s{0,4}[\"']?(?:{})\b", ("license", "licence"), 0.9, 50),
    (r"\b(?:{})[- ]licen[cs]e\b", ("license", "licence"), 0.8, 35),
]

#: Statements: clauses of license texts, addresses, names and notices.
STATEMENTS = r"""
mit | hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy
mit | shall be included | the above copyright notice and this permission notice shall be included in all copies
mit | without restriction | deal in the software without restriction
mit | expat | \bexpat licen[cs]e\b
mit-0 | without limitation the rights | including without limitation the rights to use, copy, modify, merge,? publish
isc | permission to use | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose
isc | isc disclaims | isc disclaims all warranties
hpnd | purpose and without fee | for any purpose and without fee is hereby granted
hpnd | supporting documentation | appear in supporting documentation
bsd | redistribution and use | redistribution and use in source and binary forms,? with or without modification
bsd-2-clause | redistributions of source | redistributions of source code must retain the above copyright notice
bsd-2-clause | redistributions in binary | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse or promote | may be used to endorse or promote products derived from this software
bsd-3-clause | nor the names of | neither the names? of .{1,80} nor the names of its contributors
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software
bsd-4-clause-uc | regents of the university | the regents of the university of california
bsd | provided by the copyright | this software is provided by the copyright holders and contributors
bsd-patent | patent | \bbsd[- ]?\+? ?patent\b
apache-2.0 | apache.org/licenses | apache\.org/licenses/license-2\.0
apache-2.0 | in compliance with | you may not use this file except in compliance with the licen[cs]e
apache-2.0 | specific language | see the licen[cs]e for the specific language governing permissions and limitations
apache-2.0 | distributed on an | distributed on an ["']?as is["']? basis
apache-2.0 | submitted for inclusion | intentionally submitted for inclusion in the work
apache | apache software foundation | \bdeveloped by the apache software foundation\b
asl | apache licen | \bapache licen[cs]e\b
gpl | general public licen | \bgnu general public licen[cs]e\b
gpl | general public licen | \bgeneral public licen[cs]e\b
gpl | gpl | \bgplv?[123]?\+?\b
gpl-2.0 | version 2 of | either version 2 of the licen[cs]e
gpl-3.0 | version 3 of | either version 3 of the licen[cs]e
gpl-2.0-only | gpl-2.0-only | \bgpl-2\.0-only\b
gpl-2.0-or-later | gpl-2.0-or-later | \bgpl-2\.0-or-later\b
gpl-3.0-only | gpl-3.0-only | \bgpl-3\.0-only\b
gpl-3.0-or-later | gpl-3.0-or-later | \bgpl-3\.0-or-later\b
gpl | at your option | \(at your option\) any later version
gpl | free software foundation | as published by the free software foundation
gpl | implied warranty of | without even the implied warranty of merchantability
gpl | freedom to share | take away your freedom to share and change
gpl | freedom to share | guarantee your freedom to share and change
gpl | copyleft | \bcopyleft licen[cs]e\b
gpl-classpath | classpath | \bclasspath exception\b
gpl-gcc | runtime library | \bgcc runtime library exception\b
lgpl | lesser general | \bgnu lesser general public licen[cs]e\b
lgpl | library general | \bgnu library general public licen[cs]e\b
lgpl | lgpl | \blgplv?[23]?(?:\.1)?\+?\b
lgpl | that uses the library | work that uses the library
agpl | affero | \bgnu affero general public licen[cs]e\b
agpl | agpl | \bagplv?3?\+?\b
agpl | remote network | remote network interaction
gfdl | free documentation | \bgnu free documentation licen[cs]e\b
gfdl | invariant sections | with no invariant sections
gfdl | front-cover | no front-cover texts
mpl-2.0 | mozilla.org/mpl | mozilla\.org/mpl/2\.0
mpl-2.0 | source code form | this source code form is subject to the terms of the mozilla public
mpl | mozilla public | \bmozilla public licen[cs]e\b
mpl-1.1 | mozilla.org/mpl | mozilla\.org/mpl/(?:mpl-)?1\.1
npl | netscape public | \bnetscape public licen[cs]e\b
epl | eclipse public | \beclipse public licen[cs]e\b
epl | eclipse.org/legal | eclipse\.org/legal/epl-v[12]0
edl | eclipse distribution | \beclipse distribution licen[cs]e\b
cddl | common development and | \bcommon development and distribution licen[cs]e\b
cpl | common public licen | \bcommon public licen[cs]e\b
cpal | common public attribution | \bcommon public attribution licen[cs]e\b
eupl | european union public | \beuropean union public licen[cs]e\b
artistic | artistic licen | \bartistic licen[cs]e\b
artistic | clarified artistic | \bclarified artistic licen[cs]e\b
perl | as perl itself | under the same terms as perl itself
bsl-1.0 | boost software | \bboost software licen[cs]e\b
bsl-1.0 | boost.org/license | boost\.org/license_1_0
busl | business source | \bbusiness source licen[cs]e\b
busl | change licen | \bchange licen[cs]e\b
sspl | server side | \bserver side public licen[cs]e\b
elastic | elastic licen | \belastic licen[cs]e\b
commons-clause | commons clause | \bcommons clause\b
confluent | confluent community | \bconfluent community licen[cs]e\b
fsl | functional source | \bfunctional source licen[cs]e\b
zlib | altered source | altered source versions must be plainly marked
zlib | origin of this software | the origin of this software must not be misrepresented
zlib | held liable | in no event will the authors be held liable for any damages
libpng | png reference | \bpng reference library licen[cs]e\b
libtiff | silicon graphics | \bsam leffler and silicon graphics\b
ijg | independent jpeg | \bindependent jpeg group\b
ftl | freetype | \bfreetype (?:project )?licen[cs]e\b
openssl | openssl toolkit | for use in the openssl toolkit
ssleay | eric young | \beric young\b
curl | curl licen | \bcurl licen[cs]e\b
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | unlicense.org | unlicense\.org
unlicense | anyone is free to | anyone is free to copy, modify, publish, use, compile, sell
wtfpl | what the f | \bdo what the f\w{1,6} you want to\b
beerware | beer | \bbeer[- ]?ware licen[cs]e\b
beerware | buy me a beer | you can buy me a beer in return
cc0 | creativecommons.org | creativecommons\.org/publicdomain/zero/1\.0
pd-mark | creativecommons.org | creativecommons\.org/publicdomain/mark/1\.0
cc-by | creativecommons.org | creativecommons\.org/licenses/by/[1-4]\.[05]
cc-by-sa | creativecommons.org | creativecommons\.org/licenses/by-sa/[1-4]\.[05]
cc-by-nd | creativecommons.org | creativecommons\.org/licenses/by-nd/[1-4]\.[05]
cc-by-nc | creativecommons.org | creativecommons\.org/licenses/by-nc/[1-4]\.[05]
cc-by-nc-sa | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]
cc-by-nc-nd | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]
cc | creativecommons.org | creativecommons\.org/(?:licenses|publicdomain)/[a-z0-9./-]{1,60}
cc-by | cc by,cc-by | \bcc[- ]by\b
cc-by-sa | cc by,cc-by | \bcc[- ]by[- ]sa\b
cc-by-nc | cc by,cc-by | \bcc[- ]by[- ]nc\b
cc-by-nd | cc by,cc-by | \bcc[- ]by[- ]nd\b
cc | creative commons | \bcreative commons (?:public )?licen[cs]e\b
cc-by | creative commons | \bcreative commons attribution\b
cc-by-sa | creative commons | \bcreative commons attribution[- ]share[- ]?alike\b
cc-by-nc | creative commons | \bcreative commons attribution[- ]non[- ]?commercial\b
cc-by-nd | creative commons | \bcreative commons attribution[- ]no[- ]?deriv(?:ative)?s?\b
cc0 | with this deed | the person who associated a work with this deed
cc0 | dedicated the work | has dedicated the work to the public domain
cc0 | cc0 | \bcc0\b
odbl | open database | \bopen database licen[cs]e\b
odbl | opendatacommons.org | opendatacommons\.org/licenses/odbl
odc-by | opendatacommons.org | opendatacommons\.org/licenses/by
pddl | opendatacommons.org | opendatacommons\.org/licenses/pddl
odbl | openstreetmap contributors | \bopenstreetmap contributors\b
cdla-permissive | community data licen | \bcommunity data licen[cs]e agreement\W{1,4}permissive\b
cdla-sharing | community data licen | \bcommunity data licen[cs]e agreement\W{1,4}sharing\b
ogl-uk | open government | \bopen government licen[cs]e\b
etalab | licence ouverte | \blicence ouverte\b
dl-de | datenlizenz | \bdatenlizenz deutschland\b
nlod | norwegian licen | \bnorwegian licen[cs]e for open government data\b
ofl | open font licen | \bsil open font licen[cs]e\b
ofl | reserved font | \bwith reserved font name\b
ubuntu-font | ubuntu font | \bubuntu font licen[cs]e\b
bitstream-vera | bitstream vera | \bbitstream vera fonts copyright\b
postgresql | postgresql licen | \bpostgresql licen[cs]e\b
psf | python software foundation | \bpython software foundation licen[cs]e\b
cnri | national research initiatives | \bcorporation for national research initiatives\b
ruby | ruby licen,ruby's licen | \bruby(?:'s)? licen[cs]e\b
php | php licen | \bphp licen[cs]e\b
php | php.net/license | php\.net/license/3_0[01]?\.txt
zend | zend | \bzend engine licen[cs]e\b
zpl | zope public | \bzope public licen[cs]e\b
w3c | w3c software | \bw3c software (?:and document )?(?:notice and )?licen[cs]e\b
w3c | w3.org/consortium/legal | w3\.org/consortium/legal/[a-z0-9./-]{1,60}
x11 | x consortium | \bx consortium\b
ncsa | university of illinois | \buniversity of illinois/ncsa open source licen[cs]e\b
vim | vim licen | \bvim licen[cs]e\b
intel | intel open source | \bintel open source licen[cs]e\b
ibm-pl | ibm public | \bibm public licen[cs]e\b
lpl | lucent public | \blucent public licen[cs]e\b
ms-pl | microsoft public | \bmicrosoft public licen[cs]e\b
ms-rl | microsoft reciprocal | \bmicrosoft reciprocal licen[cs]e\b
ms-lpl | microsoft limited | \bmicrosoft limited public licen[cs]e\b
apsl | apple public source | \bapple public source licen[cs]e\b
nosl | nethack | \bnethack general public licen[cs]e\b
qpl | q public | \bq public licen[cs]e\b
rpl | reciprocal public | \breciprocal public licen[cs]e\b
rpsl | realnetworks | \brealnetworks public source licen[cs]e\b
spl | sun public | \bsun public licen[cs]e\b
sissl | sun industry | \bsun industry standards source licen[cs]e\b
bcl | binary code licen | \bbinary code licen[cs]e agreement\b
otn | oracle technology network | \boracle technology network licen[cs]e\b
upl | universal permissive | \buniversal permissive licen[cs]e\b
osl | open software licen | \bopen software licen[cs]e\b
afl | academic free | \bacademic free licen[cs]e\b
ecl | educational community | \beducational community licen[cs]e\b
nasa | nasa open source | \bnasa open source agreement\b
cecill | cecill | \bcecill\b
cecill | droit fran | \bsoumis au droit fran(?:c|\xc3\xa7)ais\b
mulan | mulan | \bmulan (?:permissive software licen[cs]e|psl)\b
blueoak | blue oak model | \bblue oak model licen[cs]e\b
hippocratic | hippocratic | \bhippocratic licen[cs]e\b
anti-996 | anti 996,anti-996 | \banti[- ]996 licen[cs]e\b
cern-ohl | cern open hardware | \bcern open hardware licen[cs]e\b
tapr-ohl | tapr open hardware | \btapr open hardware licen[cs]e\b
solderpad | solderpad | \bsolderpad hardware licen[cs]e\b
openrail | responsible ai | \bresponsible ai licen[cs]e\b
openrail | rail | \bopen ?rail[- ]?(?:\+\+)?-?[msd]?\b
openrail | use-based restrictions | \buse-based restrictions\b
llama-community | llama | \bllama [234](?:\.\d)? community licen[cs]e agreement\b
llama-community | built with | \bbuilt with (?:meta )?llama\b
gemma | gemma terms | \bgemma terms of use\b
polyform | polyform | \bpolyform (?:noncommercial|small business|shield|perimeter|strict)\b
prosperity | prosperity public | \bprosperity public licen[cs]e\b
parity | parity public | \bparity public licen[cs]e\b
sleepycat | sleepycat | \bsleepycat (?:software )?licen[cs]e\b
sleepycat | accompanying software | any accompanying software that uses the db software
sqlite | may you do good | \bmay you do good and not evil\b
json | good, not evil | shall be used for good, not evil
tcl | tcl/tk | \btcl/tk licen[cs]e\b
imagemagick | imagemagick | \bimagemagick licen[cs]e\b
info-zip | info-zip | \binfo-zip licen[cs]e\b
bzip2 | bzip2 | \bbzip2(?: and libbzip2)? licen[cs]e\b
icu | icu licen | \bicu licen[cs]e\b
unicode | unicode | \bunicode,? inc\.? licen[cs]e agreement\b
unicode | unicode.org/copyright | unicode\.org/copyright\.html
naist | naist | \bnaist-2003\b
wordnet | wordnet | \bwordnet (?:release )?\d\.\d(?: licen[cs]e)?\b
cmu | carnegie mellon | \bcarnegie mellon university\b
mit-modern | massachusetts institute | \bmassachusetts institute of technology\b
stlport | stlport | \bstlport licen[cs]e\b
fair | fair licen | \bfair licen[cs]e\b
glide | 3dfx | \b3dfx glide source code general public licen[cs]e\b
jasper | jasper | \bjasper licen[cs]e\b
lppl | latex project public | \blatex project public licen[cs]e\b
lppl | lppl | \blppl\b
opl | open publication | \bopen publication licen[cs]e\b
ocl | open content | \bopen content licen[cs]e\b
design-science | design science | \bdesign science licen[cs]e\b
free-art | free art licen,licence art libre | \b(?:free art licen[cs]e|licence art libre)\b
gnu | gnu.org/ | gnu\.org/(?:licenses|copyleft)/[a-z0-9.#-]{0,60}
osi | opensource.org/licen | opensource\.org/licenses?/[a-z0-9.-]{1,60}
spdx | spdx.org/licenses | spdx\.org/licenses/[a-z0-9.-]{1,60}
choosealicense | choosealicense | choosealicense\.com/licenses/[a-z0-9.-]{1,60}
reserved | rights reserved,rights are reserved | \ball rights(?: are)? reserved\b
reserved | rights reserved | \b(?:some|certain) rights reserved\b
reserved | droits r | \btous droits r(?:e|\xc3\xa9)serv(?:e|\xc3\xa9)s\b
reserved | rechte vorbehalten | \balle rechte vorbehalten\b
reserved | derechos reservados | \btodos los derechos reservados\b
copyright | copyright,(c),© | (?:\bcopyright|\(c\)|\xc2\xa9)\s{0,4}(?:\(c\)|\xc2\xa9)?\s{0,4}(?:19|20)\d\d(?:\s{0,4}-\s{0,4}(?:19|20)?\d\d)?
copyright | copyright | \bcopyright (?:notice|holder|owner)s?\b
proprietary | proprietary | \b(?:proprietary and confidential|confidential and proprietary)\b
proprietary | unauthori | \bunauthori[sz]ed (?:copying|reproduction|distribution|use)\b
proprietary | user licen | \bend[- ]user licen[cs]e agreement\b
proprietary | trade secret | \bcontains? trade secrets\b
proprietary | reverse engineer | \bmay not (?:decompile, disassemble,? or )?reverse engineer\b
proprietary | non-transferable,nontransferable | \bnon-?exclusive,? non-?transferable\b
proprietary | written permission | \bwithout (?:the )?(?:express |prior )?written permission of\b
public-domain | public domain | \b(?:in|into|to) the public domain\b
public-domain | public domain | \bpublic domain dedication\b
public-domain | government | \bworks? of the (?:united states|u\.s\.) government\b
public-domain | gemeinfrei | \bgemeinfrei\b
public-domain | domaine public | \bdans le domaine public\b
public-domain | dominio p | \ben el dominio p(?:u|\xc3\xba)blico\b
nc | commercial use only | \b(?:for )?non[- ]?commercial use only\b
nc | commercial purposes | \b(?:not|may not be used) for commercial purposes\b
nc | research purposes only | \bfor (?:academic and )?research purposes only\b
nc | educational use only | \bfor educational use only\b
nc | evaluation purposes | \bfor evaluation purposes only\b
warranty | without warranty | \bprovided (?:["']?as is["']?,? )?without warranty of any kind\b
warranty | any warranty | \bwithout any warranty\b
dual | dual-licen,dual licen | \bdual[- ]licen[cs]ed\b
dual | under either of | \blicensed under either of\b
permissive | permissive | \bpermissive (?:open source )?licen[cs]e\b
lizenz | unter der | \bunter der (?:mit|gpl|bsd|apache)-lizenz\b
licencia | bajo la licencia | \bbajo la licencia (?:mit|gpl|bsd|apache)\b
licence-fr | sous licence | \bsous licence (?:mit|gpl|bsd|apache|libre)\b
""".strip().splitlines()

#: Labels that say how a text may be used, not by which license.
NOTICES = {"reserved", "copyright", "proprietary", "public-domain", "nc", "warranty", "dual", "permissive"}
