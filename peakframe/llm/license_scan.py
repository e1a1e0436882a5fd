"""Find licence notices by ordered signature rules, with DataFrame functions alone.

A text is reduced to its words (ASCII letters in lower case, one space between). Rules are regular
expressions over words; each names a keyword that any match of it holds, and a text meets only the rules
of the keywords that it has. Detections are intervals of words. One goes if it lies within another of
the same or a stronger class (tags and licence text over grants over bare names), so "gnu general public
license version 3" isn't also reported as one without a version. Passages of licence
texts and other notices are rules of their own, and each licence's name gives one for each phrasing in which names are met;
everything happens within a row, so nothing is shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Phrases of the base, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, keyword, pattern of the name over words, SPDX identifier as words (empty if another row has it).
NAMES: list[tuple[str, str, str, str]] = [
    ("gpl-1.0", "gnu", r"gnu general public licen[sc]e (?:as published by the free software foundation )?(?:v ?1|version 1)(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "gnu", r"gnu general public licen[sc]e (?:as published by the free software foundation )?(?:v ?2|version 2)(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "gnu", r"gnu general public licen[sc]e (?:as published by the free software foundation )?(?:v ?3|version 3)(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl-2.0", "gplv2", r"(?:gnu )?gplv2", "gplv2"),
    ("gpl-3.0", "gplv3", r"(?:gnu )?gplv3", "gplv3"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?: version)?(?: [123])?", "gpl"),
    ("lgpl-2.1", "gnu", r"gnu (?:lesser|library) general public licen[sc]e (?:v ?2|version 2)(?: 1)?", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "gnu", r"gnu lesser general public licen[sc]e (?:v ?3|version 3)(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "gnu", r"gnu (?:lesser|library) general public licen[sc]e", "lgpl"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: version)?(?: [23])?", "lgpl"),
    ("agpl-3.0", "gnu", r"gnu affero general public licen[sc]e(?: v ?3| version 3)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "agpl", r"(?:gnu )?agpl(?: v3)?", "agpl"),
    ("agpl", "agplv3", r"(?:gnu )?agplv3", ""),
    ("lgpl-2.1", "lgplv2", r"(?:gnu )?lgplv2(?: 1)?", ""),
    ("lgpl-3.0", "lgplv3", r"(?:gnu )?lgplv3", ""),
    ("apache-2.0", "apache", r"apache 2 0", ""),
    ("gfdl", "gnu", r"gnu free documentation licen[sc]e(?: version 1 [123])?", "gfdl 1 [123](?: only| or later)?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e (?:version )?1 1", "apache 1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[sc]e (?:v ?|version )?2 0", "apache 2 0"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", "apache"),
    ("mit", "license", r"(?:the )?mit (?:x11 )?license", "mit"),
    ("mit", "licence", r"(?:the )?mit (?:x11 )?licence", "mit"),
    ("mit", "expat", r"expat licen[sc]e", "expat"),
    ("x11", "x11", r"x11 licen[sc]e", "x11"),
    ("isc", "isc", r"isc licen[sc]e", "isc"),
    ("bsd-2-clause", "bsd", r"(?:2 clause|simplified|two clause) bsd(?: licen[sc]e)?|bsd 2 clause(?: licen[sc]e)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:3 clause|new|revised|modified|three clause) bsd(?: licen[sc]e)?|bsd 3 clause(?: licen[sc]e)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:4 clause|original|four clause) bsd(?: licen[sc]e)?|bsd 4 clause(?: licen[sc]e)?", "bsd 4 clause"),
    ("0bsd", "0bsd", r"0bsd(?: licen[sc]e)?", "0bsd"),
    ("0bsd", "zero", r"zero clause bsd(?: licen[sc]e)?", ""),
    ("bsd", "bsd", r"bsd (?:style )?licen[sc]e", "bsd"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e (?:version )?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e (?:v ?|version )?2 0", "mpl 2 0"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", "mpl"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e (?:v ?|version )?1 0", "epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e (?:v ?|version )?2 0", "epl 2 0"),
    ("epl", "eclipse", r"eclipse public licen[sc]e", "epl"),
    ("cddl-1.0", "cddl", r"cddl(?: version)?(?: 1 0)?", "cddl 1 0"),
    ("cddl-1.0", "distribution", r"common development and distribution licen[sc]e", ""),
    ("cpl-1.0", "common", r"common public licen[sc]e(?: version 1 0)?", "cpl 1 0"),
    ("eupl-1.2", "eupl", r"eupl(?: v ?1 2| 1 2)?", "eupl 1 2"),
    ("eupl", "union", r"european union public licen[sc]e", "eupl 1 1"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e 1 0", "artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e 2 0", "artistic 2 0"),
    ("artistic", "artistic", r"artistic licen[sc]e", "artistic"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e(?: version)?(?: 1 0)?", "bsl 1 0"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", "zlib"),
    ("libpng", "libpng", r"libpng licen[sc]e", "libpng"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2)?", "wtfpl"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?", "cc by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?", "cc by nc sa [1-4] [05]"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?", "cc by nc [1-4] [05]"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?", "cc by nd [1-4] [05]"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?", "cc by sa [1-4] [05]"),
    ("cc-by-4.0", "cc", r"cc by 4 0", "cc by 4 0"),
    ("cc-by-3.0", "cc", r"cc by 3 0", "cc by 3 0"),
    ("cc-by", "cc", r"cc by", "cc by"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial(?: licen[sc]e)?", "cc by nc"),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international)?(?: licen[sc]e)?", "cc by sa"),
    ("cc-by", "commons", r"creative commons attribution(?: [1-4] [05])?(?: international)?(?: licen[sc]e)?", "cc by"),
    ("cc", "commons", r"creative commons licen[sc]e", "cc"),
    ("odbl-1.0", "odbl", r"odbl(?: 1 0)?", "odbl 1 0"),
    ("odbl", "database", r"open database licen[sc]e", "odbl"),
    ("odc-by", "odc", r"odc by(?: 1 0)?", "odc by 1 0"),
    ("ofl-1.1", "ofl", r"(?:sil )?ofl(?: 1 1)?", "ofl 1 1"),
    ("ofl", "font", r"(?:sil )?open font licen[sc]e(?: version 1 1)?", "ofl 1 1"),
    ("psf-2.0", "python", r"python software foundation licen[sc]e(?: version 2)?", "psf 2 0"),
    ("php-3.01", "php", r"php licen[sc]e(?: version)?(?: 3 01?)?", "php 3 01"),
    ("ruby", "ruby", r"ruby licen[sc]e", "ruby"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", "postgresql"),
    ("openssl", "openssl", r"openssl licen[sc]e", "openssl"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?licen[sc]e", "ncsa"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", "ms pl"),
    ("ms-rl", "reciprocal", r"microsoft reciprocal licen[sc]e", "ms rl"),
    ("afl-3.0", "academic", r"academic free licen[sc]e(?: version 3 0)?", "afl 3 0"),
    ("osl-3.0", "osl", r"osl(?: 3 0)?|open software licen[sc]e(?: version 3 0)? osl", "osl 3 0"),
    ("ecl-2.0", "educational", r"educational community licen[sc]e(?: version 2 0)?", "ecl 2 0"),
    ("upl-1.0", "upl", r"upl(?: 1 0)?", "upl 1 0"),
    ("sspl-1.0", "sspl", r"sspl(?: v ?1| 1 0)?", "sspl 1 0"),
    ("sspl-1.0", "server", r"server side public licen[sc]e", "sspl"),
    ("busl-1.1", "business", r"business source licen[sc]e(?: version)?(?: 1 1)?", "busl 1 1"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?: version)?(?: 2 0)?", "elastic 2 0"),
    ("mulan-2.0", "mulan", r"mulan (?:psl|permissive software licen[sc]e)(?: v ?2)?", "mulanpsl 2 0"),
    ("blueoak-1.0.0", "blueoak", r"blueoak(?: 1 0 0)?", "blueoak 1 0 0"),
    ("cecill-2.1", "cecill", r"cecill(?: [bc])?(?: 2 1)?", "cecill 2 1"),
    ("openrail-m", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?", "openrail m"),
    ("proprietary", "proprietary", r"proprietary licen[sc]e", "licenseref proprietary"),
]

#: Passages of licence texts and other notices: label, keyword, pattern.
PASSAGES: list[tuple[str, str, str]] = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"),
    ("isc", "fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products"),
    ("apache-2.0", "apache", r"you may not use this file except in compliance with the license (?:[^ ]+ ){0,20}www apache org licenses license 2 0"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"),
    ("agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("gpl", "warranty", r"without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e version 1 0 august 17th 2003"),
    ("wtfpl", "fuck", r"do what the fuck you want to public licen[sc]e"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc", "creativecommons", r"creativecommons org licenses (?!by (?:sa )?[1-4] [05](?![^ ]))[a-z]+(?: [a-z]+)*(?: [1-4] [05])?"),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("all-rights-reserved", "reserved", r"all rights reserved"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("proprietary", "confidential", r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution) of this (?:file|work|material|document)"),
    ("mit", "sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial", r"(?:the )?above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", r"including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "tort", r"whether in an action of contract tort or otherwise arising from out of or in connection with the software"),
    ("x11", "consortium", r"the name of the x consortium shall not be used in advertising"),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software"),
    ("isc", "tortious", r"whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("hpnd", "supporting", r"that both that copyright notice and this permission notice appear in supporting documentation"),
    ("hpnd", "publicity", r"not be used in advertising or publicity pertaining to (?:the )?distribution of the software"),
    ("bsd", "retain", r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", "reproduce", r"redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd", "holders", r"this software is provided by the copyright holders and contributors as is"),
    ("bsd", "regents", r"this software is provided by the regents and contributors as is"),
    ("bsd", "procurement", r"procurement of substitute goods or services loss of use data or profits"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledg?e?ment"),
    ("bsd-4-clause", "regents", r"the regents of the university of california"),
    ("apache-2.0", "unless", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    ("apache-2.0", "january", r"version 2 0 january 2004"),
    ("apache-2.0", "asf", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "jakarta", r"this product includes software developed by the apache software foundation http www apache org jakarta"),
    ("gpl", "useful", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", "1991", r"gnu general public license version 2 june 1991"),
    ("gpl-3.0", "2007", r"gnu general public license version 3 29 june 2007"),
    ("gpl-3.0", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "along", r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "option", r"either version [23] of the license or at your option any later version"),
    ("lgpl", "along", r"you should have received a copy of the gnu lesser general public license along with this library"),
    ("lgpl-2.1", "1999", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl", "linking", r"linking (?:this library|a work with this library) statically or dynamically"),
    ("agpl-3.0", "affero", r"gnu affero general public license version 3 19 november 2007"),
    ("agpl", "remotely", r"all users interacting with it remotely through a computer network"),
    ("classpath-exception", "classpath", r"(?:gnu )?classpath exception(?: 2 0)?"),
    ("gcc-exception", "gcc", r"gcc runtime library exception"),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "invariant", r"with the invariant sections being list their titles"),
    ("mpl-2.0", "mozilla", r"if a copy of the mpl was not distributed with this file you can obtain one at https? (?:www )?mozilla org mpl 2 0"),
    ("mpl-2.0", "incompatible", r"this source code form is incompatible with secondary licenses"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("npl", "netscape", r"netscape public licen[sc]e(?: version 1 [01])?"),
    ("epl-2.0", "eclipse", r"made available under the terms of the eclipse public license (?:v ?)?2 0"),
    ("epl-1.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e(?: v ?1 0| version 1 0)?"),
    ("cddl-1.0", "cddl", r"the contents of this file are subject to the terms of the common development and distribution license the license cddl"),
    ("cddl-1.1", "cddl", r"cddl gpl 2 ce|cddl version 1 1"),
    ("cpl-1.0", "recipient", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("ipl-1.0", "ibm", r"ibm public licen[sc]e(?: version 1 0)?"),
    ("lpl-1.02", "lucent", r"lucent public licen[sc]e(?: version 1 02?)?"),
    ("apsl-2.0", "apple", r"apple public source licen[sc]e(?: version)?(?: 2 0)?"),
    ("artistic-2.0", "package", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("artistic-1.0", "semblance", r"such that the copyright holder maintains some semblance of artistic control"),
    ("perl", "perl", r"(?:under )?the same terms as perl(?: itself)?"),
    ("clarified-artistic", "clarified", r"clarified artistic licen[sc]e"),
    ("bsl-1.0", "machine", r"unless such copies or derivative works are solely in the form of machine executable object code"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "implied", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng", "png", r"png reference library"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", r"(?:portions of this software are copyright (?:[^ ]+ ){1,6}the )?freetype project(?: licen[sc]e)?"),
    ("libtiff", "libtiff", r"libtiff licen[sc]e"),
    ("sgi-b-2.0", "sgi", r"sgi free software licen[sc]e b(?: version 2 0)?"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", "eric", r"this product includes cryptographic software written by eric young"),
    ("ntp", "ntp", r"ntp licen[sc]e"),
    ("curl", "curl", r"curl licen[sc]e|curl and libcurl are (?:true )?open source"),
    ("icu", "icu", r"icu licen[sc]e(?: icu 1 8 1 and later)?"),
    ("unicode-dfs", "unicode", r"unicode (?:inc )?licen[sc]e agreement data files and software"),
    ("w3c", "w3c", r"w3c software (?:and document )?(?:notice and )?licen[sc]e"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("beerware", "beerware", r"the beerware licen[sc]e(?: revision 42)?"),
    ("unlicense", "dedicate", r"the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", "wtfpl", r"you just do what the [a-z]+ you want to wtfpl"),
    ("public-domain", "domain", r"this (?:file|work|code|software|program) is (?:hereby )?(?:in|released into|placed in) the public domain"),
    ("cc0-1.0", "waive", r"overtly fully permanently irrevocably and unconditionally waive"),
    ("cc0-1.0", "cc0", r"to the extent possible under law (?:[^ ]+ ){1,12}waived all copyright (?:[^ ]+ ){0,12}cc0"),
    ("cc-by-sa", "sharealike", r"attribution sharealike [1-4] [05] (?:international|unported|generic)"),
    ("cc-by-nc", "noncommercial", r"attribution noncommercial [1-4] [05] (?:international|unported|generic)"),
    ("cc-by-nc-sa", "noncommercial", r"attribution noncommercial sharealike [1-4] [05] (?:international|unported|generic)"),
    ("cc-by-nc-nd", "noderivatives", r"attribution noncommercial noderivatives [1-4] [05]"),
    ("cc-by-nd", "noderivatives", r"attribution noderivatives [1-4] [05]"),
    ("cc-by", "attribution", r"attribution you must give appropriate credit"),
    ("cc-by-sa", "remix", r"if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nd", "remix", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-nc", "commercial", r"you may not use the material for commercial purposes"),
    ("cc-pdm", "mark", r"public domain mark 1 0"),
    ("odbl-1.0", "produced", r"attribute any public use of the database or works produced from the database"),
    ("odc-pddl", "pddl", r"(?:odc )?pddl(?: 1 0)?"),
    ("odc-pddl", "dedication", r"(?:open data commons )?public domain dedication and licen[sc]e"),
    ("ogl-uk", "government", r"open government licen[sc]e(?: v ?[123] 0| version [123] 0)?"),
    ("cdla-permissive", "cdla", r"cdla permissive(?: [12] 0)?"),
    ("cdla-sharing", "cdla", r"cdla sharing(?: 1 0)?"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "reserved", r"with reserved font name"),
    ("ufl-1.0", "ubuntu", r"ubuntu font licen[sc]e(?: version 1 0)?"),
    ("lppl-1.3c", "latex", r"latex project public licen[sc]e(?: version)?(?: 1 3[ac]?)?"),
    ("psf-2.0", "psf", r"psf license agreement for python"),
    ("cnri", "cnri", r"cnri (?:open source )?(?:python )?licen[sc]e(?: agreement)?"),
    ("zpl-2.1", "zope", r"zope public licen[sc]e(?: zpl)?(?: version)?(?: 2 [01])?"),
    ("php-3.01", "php", r"this product includes php software freely available from"),
    ("ruby", "ruby", r"(?:under )?the same terms as ruby(?: itself)?"),
    ("tcl", "tcl", r"tcl tk licen[sc]e|tcl licen[sc]e"),
    ("vim", "vim", r"vim licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql is released under the postgresql license"),
    ("ncsa", "urbana", r"university of illinois at urbana champaign"),
    ("ms-pl", "accepts", r"this license governs use of the accompanying software (?:[^ ]+ ){0,12}accepts"),
    ("ms-limited", "microsoft", r"microsoft limited public licen[sc]e"),
    ("ms-eula", "microsoft", r"microsoft software license terms"),
    ("qpl-1.0", "qpl", r"(?:the )?q public licen[sc]e qpl|qpl(?: version)? 1 0"),
    ("rpl-1.5", "reciprocal", r"reciprocal public licen[sc]e(?: version)?(?: 1 [15])?"),
    ("sleepycat", "sleepycat", r"sleepycat (?:public )?licen[sc]e"),
    ("watcom-1.0", "watcom", r"sybase open watcom public licen[sc]e(?: version 1 0)?"),
    ("eupl-1.2", "eupl", r"licensed under the eupl(?: version)?(?: v ?1 2| 1 2)?(?: or later)?"),
    ("cecill-b", "cecill", r"cecill b(?: version 1)?(?: 0)?"),
    ("cecill-c", "cecill", r"cecill c(?: version 1)?(?: 0)?"),
    ("osl-3.0", "osl", r"licensed under the open software license version 3 0 osl"),
    ("afl-3.0", "afl", r"afl 3 0|academic free license v ?3 0 afl"),
    ("cpal-1.0", "cpal", r"cpal(?: version)?(?: 1 0)?"),
    ("cpal-1.0", "attribution", r"common public attribution licen[sc]e"),
    ("sspl-1.0", "mongodb", r"mongodb inc server side public license"),
    ("busl-1.1", "change", r"change date (?:[^ ]+ ){1,10}change license"),
    ("elastic-2.0", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "clause", r"commons clause(?: license condition)?(?: v ?1 0)?"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|free trial|internal use|perimeter)(?: licen[sc]e)?(?: 1 0 0)?"),
    ("hippocratic", "hippocratic", r"hippocratic licen[sc]e(?: version)?(?: [123] [01])?"),
    ("parity", "parity", r"parity public licen[sc]e(?: 7 0 0)?"),
    ("llama-community", "llama", r"llama (?:[23] (?:[0-9] )?)?community licen[sc]e(?: agreement)?"),
    ("gemma", "gemma", r"gemma terms of use"),
    ("openrail", "openrail", r"openrail(?: m| pp)? licen[sc]e"),
    ("rail", "rail", r"bigscience (?:bloom )?rail licen[sc]e(?: v ?1 0)?|bigcode open rail m"),
    ("ai2-impact", "ai2", r"ai2 impact licen[sc]e"),
    ("oracle-bcl", "oracle", r"oracle binary code license agreement"),
    ("nvidia-eula", "nvidia", r"nvidia (?:software licen[sc]e|source code licen[sc]e|cuda toolkit end user licen[sc]e)(?: agreement)?"),
    ("eula", "user", r"end user licen[sc]e agreement"),
    ("trade-secret", "secrets", r"contains (?:confidential (?:information )?and |proprietary (?:information )?and )?trade secrets"),
    ("no-redistribution", "prior", r"may not be (?:copied|reproduced|redistributed|distributed)(?: in whole or in part)? without (?:the )?(?:express )?prior (?:written )?(?:permission|consent)"),
    ("educational-use", "educational", r"for educational (?:and research )?(?:purposes|use) only"),
    ("noncommercial", "commercial", r"(?:for )?non commercial use only"),
    ("research-only", "research", r"for (?:academic |non commercial )?research (?:purposes|use) only"),
    ("copyright", "copr", r"copr (?:19|20)[0-9]{2}"),
]

#: Phrasings: pattern round a name or identifier, class (0 is the strongest), weight of a detection in the score, whether it takes the identifier.
PHRASINGS: list[tuple[str, int, float, bool]] = [
    (r"spdx license identifier {}", 0, 0.99, True),
    (r"(?:(?:is|are|was|and|work|file|software|code|data) )*(?:licen[sc]ed|released|distributed|available|provided|published|issued) (?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{})", 1, 0.9, False),
    (r"(?:{})", 2, 0.6, False),
]


def rules() -> list[dict]:
    """The ordered rules: some 430, of which some 270 are written by hand."""
    out = [{"pattern": phrase, "keyword": "cc" if phrase == "cc by" else "license", "class": 2, "label": label, "weight": 0.5, "base": True} for phrase, label in BASE.items()]
    out += [{"pattern": p, "keyword": k, "class": 0, "label": label, "weight": 0.95, "base": False} for label, k, p in PASSAGES]
    for around, strength, weight, by_id in PHRASINGS:
        out += [{"pattern": around.format(spdx if by_id else name), "keyword": "spdx" if by_id else k, "class": strength, "label": label, "weight": weight, "base": False} for label, k, name, spdx in NAMES if spdx or not by_id]
    for r in out:
        r["pattern"] = f"(?<![^ ])(?:{r['pattern']})(?![^ ])"
    return out


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spaces(x: str) -> str:
    return f"(octet_length({x}) - octet_length(replace({x}, ' ', '')))"


SPAN = "struct<start:int,back:int,class:int,label:string,weight:double,base:boolean>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def detect(documents: DataFrame) -> DataFrame:
    """doc_id, n_words and ``found``: all detections, by start, longer first; ``back`` is minus the end, words from 0.

    Null text is empty. Detections of one rule don't overlap; those of different rules may.
    """
    table = rules()
    keywords = "|".join(sorted({r["keyword"] for r in table}))
    words = texts(documents).withColumn("words", F.translate(F.concat(F.lit(" "), F.trim(F.regexp_replace("text", NOT_WORD, " ")), F.lit(" ")), _UPPER, _LOWER))
    words = words.select("doc_id", "words", F.when(F.octet_length("words") > 2, F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" "), F.lit(""))) - 1).otherwise(0).cast("long").alias("n_words"))
    words = words.withColumn("keywords", F.expr(f"array_distinct(regexp_extract_all(words, {_sql(f'(?<![^ ])(?:{keywords})(?![^ ])')}, 0))"))
    schema = "array<struct<pattern:string,keyword:string,class:int,label:string,weight:double,base:boolean>>"
    spans = f"""aggregate(arrays_zip(regexp_extract_all(words, r.pattern, 0), split(words, r.pattern, -1)),
        named_struct('w', -1, 'o', cast(array() as array<{SPAN}>)),
        (a, x) -> if(x['0'] is null, a, named_struct(
            'w', a.w + {_spaces("x['1']")} + {_spaces("x['0']")},
            'o', concat(a.o, array(named_struct('start', a.w + {_spaces("x['1']")}, 'back', -(a.w + {_spaces("x['1']")} + {_spaces("x['0']")} + 1),
                'class', r.class, 'label', r.label, 'weight', r.weight, 'base', r.base))))),
        a -> a.o)"""
    # Each pattern is a literal, compiled once; only the rules that match go on to the columns of the table.
    patterns = [_sql(r["pattern"]) for r in table]
    by_keyword: dict[str, list[int]] = {}
    for i, r in enumerate(table):
        by_keyword.setdefault(r["keyword"], []).append(i)
    tried = [f"case when array_contains(keywords, {_sql(k)}) then array({', '.join(f'if(words rlike {patterns[i]}, {i}, null)' for i in at)}) else cast(array() as array<int>) end" for k, at in sorted(by_keyword.items())]
    met = f"array_compact(flatten(array({', '.join(tried)})))"
    found = f"""case when size(keywords) = 0 then cast(array() as array<{SPAN}>) else
        array_sort(flatten(transform(transform({met}, i -> element_at(from_json({_sql(json.dumps(table))}, '{schema}'), i + 1)), r -> {spans}))) end"""
    return words.select("doc_id", "n_words", F.expr(found).alias("found"))


def scan(documents: DataFrame) -> DataFrame:
    """One row for each row of documents.

    n_base counts the places of the base phrases, first_word and last_word are the smallest and largest of
    their starts (null without one), base_labels their labels. labels adds those of the detections that
    suppression leaves, and score is one less the product of their doubts. Empty or null text has no words
    and score 0; a null doc_id stays null; repeated rows are scanned each; further columns are ignored.
    """
    within = "(x.class >= 0 and -x.back <= a.e0 or x.class >= 1 and -x.back <= a.e1 or x.class >= 2 and -x.back <= a.e2)"
    reach = ", ".join(f"'e{k}', if(x.class = {k}, greatest(a.e{k}, -x.back), a.e{k})" for k in range(3))
    kept = f"""aggregate(found, named_struct('e0', -1, 'e1', -1, 'e2', -1, 'labels', cast(array() as array<string>), 'doubt', 1.0D),
        (a, x) -> if({within}, a, named_struct({reach}, 'labels', array_union(a.labels, array(x.label)), 'doubt', a.doubt * (1 - x.weight))))"""
    d = detect(documents).withColumn("base", F.expr("filter(found, x -> x.base)")).withColumn("kept", F.expr(kept))
    return d.selectExpr(
        "doc_id", "n_words", "cast(size(base) as long) n_base",
        "cast(if(size(base) = 0, null, base[0].start) as long) first_word",
        "cast(array_max(transform(base, x -> x.start)) as long) last_word",
        "array_join(array_sort(array_distinct(transform(base, x -> x.label))), ',') base_labels",
        "array_join(array_sort(array_union(kept.labels, transform(base, x -> x.label))), ',') labels",
        "round(1 - kept.doubt, 6) score",
        "cast(size(found) as long) n_detections",
    )
