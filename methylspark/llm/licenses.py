"""License scans by ordered signature rules.

A rule is a regular expression over the words of a text, with a label, a priority and
keywords. Only rules whose keywords all stand in the text are tried. Of detections that
lie within a detection of higher priority only the latter counts. The four base phrases
are found apart from the rules and are never suppressed.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases that the contract fixes, and their labels.
BASE = (
    (("gnu", "general", "public", "license"), "gpl"),
    (("apache", "license"), "apache"),
    (("cc", "by"), "cc-by"),
    (("mit", "license"), "mit"),
)

#: Bytes of words: digits, lower-case letters and all of non-ASCII; A-Z become a-z, others a space.
TO_WORDS = bytes(
    c if c >= 128 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for c in range(256)
)

V = r"(?: version)? (?:v ?)?"  # before a version number
OR_LATER = r"(?: or(?: at your option)? any later version| or later| or newer|)"

#: Label, pattern of the name, keywords. Written as words: lower case, one space between.
#: All keywords must stand in the text; of those with | between, one of them.
LICENSES = (
    ("gpl-1.0", rf"gnu (?:general public license|gpl){V}1(?: 0)?{OR_LATER}", "gnu"),
    ("gpl-2.0", rf"gnu (?:general public license|gpl){V}2(?: 0)?{OR_LATER}", "gnu"),
    ("gpl-3.0", rf"gnu (?:general public license|gpl){V}3(?: 0)?{OR_LATER}", "gnu"),
    ("lgpl-2.0", rf"gnu (?:library|lesser) general public license{V}2(?: 0)?{OR_LATER}", "gnu"),
    ("lgpl-2.1", rf"gnu lesser general public license{V}2 1{OR_LATER}", "gnu lesser"),
    ("lgpl-3.0", rf"gnu lesser general public license{V}3(?: 0)?{OR_LATER}", "gnu lesser"),
    ("agpl-3.0", rf"gnu affero general public license(?:{V}3(?: 0)?)?{OR_LATER}", "gnu affero"),
    ("gfdl", rf"gnu free documentation license(?:{V}1(?: [123])?)?{OR_LATER}", "gnu documentation"),
    ("apache-1.0", rf"apache (?:software )?license{V}1 0", "apache"),
    ("apache-1.1", rf"apache (?:software )?license{V}1 1", "apache"),
    ("apache-2.0", rf"apache (?:software )?license{V}2(?: 0)?", "apache"),
    ("mit", r"mit (?:x11 )?license|expat license", "license"),
    ("mit-0", r"mit no attribution(?: license)?", "mit attribution"),
    ("x11", r"x11 license|mit x11 license", "x11"),
    ("bsd-1-clause", r"(?:bsd 1 clause|1 clause bsd)(?: license)?", "bsd"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?", "bsd|freebsd"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?", "bsd"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?", "bsd"),
    ("0bsd", r"(?:0bsd|bsd zero clause|zero clause bsd)(?: license)?", "0bsd|bsd"),
    ("bsd", r"bsd license", "bsd"),
    ("cc-by-1.0", r"(?:cc by|creative commons attribution) 1 0", "1"),
    ("cc-by-2.0", r"(?:cc by|creative commons attribution) 2 0", "2"),
    ("cc-by-2.5", r"(?:cc by|creative commons attribution) 2 5", "2"),
    ("cc-by-3.0", r"(?:cc by|creative commons attribution) 3 0", "3"),
    ("cc-by-4.0", r"(?:cc by|creative commons attribution) 4 0", "4"),
    ("cc-by-sa-2.0", r"(?:cc by sa|creative commons attribution share ?alike) 2 0", "2"),
    ("cc-by-sa-3.0", r"(?:cc by sa|creative commons attribution share ?alike) 3 0", "3"),
    ("cc-by-sa-4.0", r"(?:cc by sa|creative commons attribution share ?alike) 4 0", "4"),
    ("cc-by-nd-3.0", r"(?:cc by nd|creative commons attribution no ?derivatives) 3 0", "3"),
    ("cc-by-nd-4.0", r"(?:cc by nd|creative commons attribution no ?derivatives) 4 0", "4"),
    ("cc-by-nc-2.0", r"(?:cc by nc|creative commons attribution non ?commercial) 2 0", "2"),
    ("cc-by-nc-3.0", r"(?:cc by nc|creative commons attribution non ?commercial) 3 0", "3"),
    ("cc-by-nc-4.0", r"(?:cc by nc|creative commons attribution non ?commercial) 4 0", "4"),
    ("cc-by-nc-sa-3.0", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 3 0", "3"),
    ("cc-by-nc-sa-4.0", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0", "4"),
    ("cc-by-nc-nd-3.0", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?derivatives) 3 0", "3"),
    ("cc-by-nc-nd-4.0", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?derivatives) 4 0", "4"),
    ("cc-by-sa", r"cc by sa|creative commons attribution share ?alike", "by|attribution"),
    ("cc-by-nd", r"cc by nd|creative commons attribution no ?derivatives", "by|attribution"),
    ("cc-by-nc", r"cc by nc|creative commons attribution non ?commercial", "by|attribution"),
    ("cc0-1.0", r"cc0(?: 1 0)?|creative commons zero|cc zero", "cc0|zero"),
    ("public-domain", r"(?:in|into|to) the public domain|public domain dedication", "public domain"),
    ("mpl-1.0", rf"mozilla public license{V}1 0", "mozilla"),
    ("mpl-1.1", rf"mozilla public license{V}1 1", "mozilla"),
    ("mpl-2.0", rf"mozilla public license{V}2(?: 0)?", "mozilla"),
    ("epl-1.0", rf"eclipse public license{V}1(?: 0)?", "eclipse"),
    ("epl-2.0", rf"eclipse public license{V}2(?: 0)?", "eclipse"),
    ("edl-1.0", rf"eclipse distribution license(?:{V}1(?: 0)?)?", "eclipse"),
    ("cpl-1.0", rf"common public license(?:{V}1(?: 0)?)?", "common"),
    ("ipl-1.0", rf"ibm public license(?:{V}1(?: 0)?)?", "ibm"),
    ("cddl-1.0", rf"common development and distribution license(?:{V}1(?: 0)?)?", "distribution"),
    ("eupl-1.1", rf"european union public licen[cs]e{V}1 1", "european"),
    ("eupl-1.2", rf"european union public licen[cs]e{V}1 2", "european"),
    ("afl-3.0", rf"academic free license(?:{V}3(?: 0)?)?", "academic"),
    ("osl-3.0", rf"open software license(?:{V}3(?: 0)?)?", "software"),
    ("artistic-1.0", rf"artistic license{V}1(?: 0)?", "artistic"),
    ("artistic-2.0", rf"artistic license{V}2(?: 0)?", "artistic"),
    ("bsl-1.0", rf"boost software license(?:{V}1(?: 0)?)?", "boost"),
    ("busl-1.1", rf"business source license(?:{V}1 1)?", "business"),
    ("isc", r"isc license", "isc"),
    ("zlib", r"zlib(?: libpng)? license", "zlib"),
    ("unlicense", r"the unlicense|unlicense org", "unlicense"),
    ("wtfpl", r"do what the (?:fuck|f) you want to public license", "want"),
    ("ofl-1.1", rf"sil open font license(?:{V}1 1)?", "font"),
    ("psf-2.0", rf"python software foundation license(?:{V}2)?", "python"),
    ("php-3.01", rf"php license(?:{V}3(?: 0?1)?)?", "php"),
    ("ruby", r"ruby s? ?license", "ruby"),
    ("postgresql", r"postgresql license", "postgresql"),
    ("openssl", r"openssl license", "openssl"),
    ("ncsa", r"university of illinois(?: ncsa)? open source license", "illinois"),
    ("ms-pl", r"microsoft public license", "microsoft"),
    ("ms-rl", r"microsoft reciprocal license", "microsoft"),
    ("upl-1.0", rf"universal permissive license(?:{V}1(?: 0)?)?", "universal"),
    ("odbl-1.0", rf"open data(?:base| commons open database) license(?:{V}1(?: 0)?)?", "open"),
    ("odc-by-1.0", rf"open data commons attribution license(?:{V}1(?: 0)?)?", "commons"),
    ("ecl-2.0", rf"educational community license(?:{V}2(?: 0)?)?", "educational"),
    ("vim", r"vim license", "vim"),
    ("w3c", r"w3c (?:software (?:notice and )?)?license", "w3c"),
    ("llama", r"llama (?:[23] )?community license", "community"),
    ("openrail", r"openrail(?: m)? license|responsible ai license", "license"),
)

#: Sentences of license texts and notices: label, pattern, words that every match holds.
TEXTS = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby obtaining associated"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "notice substantial portions"),
    ("x11", r"except as contained in this notice the name of the (?:x consortium|copyright holders?) shall not be used in advertising", "except contained advertising"),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", "purpose fee hereby"),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "purpose fee appear"),
    ("hpnd", r"permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and without fee)? is hereby granted", "documentation purpose hereby"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "documentation written agreement"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary permitted"),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions retain disclaimer"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistributions reproduce disclaimer"),
    ("bsd-3-clause", r"may be used to endorse or promote products derived from this software without specific prior written permission", "endorse promote derived"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising mentioning display"),
    ("bsd-clear", r"no express or implied licenses to any party s patent rights are granted by this license", "implied party patent"),
    ("ncsa", r"to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", "deal restriction sublicense"),
    ("gpl-1.0", r"gnu general public license as published by the free software foundation either version 1(?: of the license)?", "gnu published either"),
    ("gpl-2.0", r"gnu general public license as published by the free software foundation(?: either)? version 2(?: of the license)?", "gnu published foundation"),
    ("gpl-3.0", r"gnu general public license as published by the free software foundation(?: either)? version 3(?: of the license)?", "gnu published foundation"),
    ("lgpl-2.0", r"gnu (?:library|lesser) general public license as published by the free software foundation either version 2 of the license", "gnu published either"),
    ("lgpl-2.1", r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license", "gnu lesser published"),
    ("lgpl-3.0", r"gnu lesser general public license as published by the free software foundation either version 3 of the license", "gnu lesser published"),
    ("agpl-3.0", r"gnu affero general public license as published by the free software foundation either version 3 of the license", "gnu affero published"),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "program redistribute gnu"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:library|lesser) general public license", "library redistribute gnu"),
    ("gpl-2.0", r"gnu general public license version 2 june 1991", "gnu june 1991"),
    ("gpl-3.0", r"gnu general public license version 3 29 june 2007", "gnu june 2007"),
    ("lgpl-2.1", r"gnu lesser general public license version 2 1 february 1999", "gnu february 1999"),
    ("lgpl-3.0", r"gnu lesser general public license version 3 29 june 2007", "gnu lesser 2007"),
    ("agpl-3.0", r"gnu affero general public license version 3 19 november 2007", "gnu affero 2007"),
    ("gfdl-1.3", r"gnu free documentation license version 1 3 3 november 2008", "gnu documentation 2008"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "document gnu documentation"),
    ("gpl-2.0", r"the licenses for most software are designed to take away your freedom to share and change it", "licenses freedom share"),
    ("gpl-3.0", r"the gnu general public license is a free copyleft license for software and other kinds of works", "gnu copyleft kinds"),
    ("gnu-text", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim changing allowed"),
    ("agpl-3.0", r"your modified version must prominently offer all users interacting with it remotely through a computer network", "prominently interacting remotely"),
    ("ms-pl", r"ms pl", "ms"),
    ("ms-rl", r"ms rl", "ms"),
    ("classpath-exception-2.0", r"linking this library statically or dynamically with other modules is making a combined work based on this library", "statically dynamically combined"),
    ("gcc-exception-3.1", r"gcc runtime library exception", "gcc runtime exception"),
    ("bison-exception-2.2", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", "bison parser skeleton"),
    ("apache-2.0", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache file compliance"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "applicable agreed basis"),
    ("apache-2.0", r"apache license version 2 0 january 2004", "apache january 2004"),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "contributor perpetual irrevocable"),
    ("apache-1.1", r"this product includes software developed by the apache (?:software foundation|group)", "product includes apache"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", "form subject mozilla"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", "contents subject mozilla"),
    ("mpl-1.0", r"the contents of this file are subject to the mozilla public license version 1 0", "contents subject mozilla"),
    ("npl-1.1", r"the contents of this file are subject to the netscape public license version 1 1", "contents subject netscape"),
    ("epl-1.0", r"made available under the terms of the eclipse public license v1 0", "available eclipse v1"),
    ("epl-2.0", r"made available under the terms of the eclipse public license(?: v)? 2 0", "available eclipse 2"),
    ("epl-1.0", r"the accompanying program is provided under the terms of this eclipse public license", "accompanying provided eclipse"),
    ("cpl-1.0", r"the accompanying program is provided under the terms of this common public license", "accompanying provided common"),
    ("ipl-1.0", r"the accompanying program is provided under the terms of this ibm public license", "accompanying provided ibm"),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution license", "contents subject distribution"),
    ("eupl", r"licensed under the eupl", "licensed eupl"),
    ("cecill", r"this software is governed by the cecill license under french law", "governed cecill french"),
    ("cecill-b", r"this software is governed by the cecill b license under french law", "governed cecill french"),
    ("cecill-c", r"this software is governed by the cecill c license under french law", "governed cecill french"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "express event liable"),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "origin misrepresented claim"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered plainly misrepresented"),
    ("libpng", r"the png reference library is supplied as is", "png reference supplied"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "independent jpeg group"),
    ("info-zip", r"this is version 20(?:0[0-9]|1[0-9]) (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) [0-9]{1,2} of the info zip license", "version info zip"),
    ("ftl", r"portions of this software are copyright (?:[0-9]{4} )?the freetype project", "portions freetype project"),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "hereby organization accompanying"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered public domain"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "anyone publish compile"),
    ("wtfpl", r"you just do what the (?:fuck|f) you want to", "just what want"),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", "retain whatever stuff"),
    ("json", r"the software shall be used for good not evil", "shall good evil"),
    ("cc0-1.0", r"the person who associated a work with this deed has dedicated the work to the public domain", "associated deed dedicated"),
    ("cc0-1.0", r"to the extent possible under law (?:the author|the person who associated cc0 with this work) has waived all copyright and related or neighboring rights", "extent waived neighboring"),
    ("cc-by-4.0", r"licensed under a creative commons attribution 4 0 international license", "creative commons international"),
    ("cc-by-3.0", r"licensed under a creative commons attribution 3 0 (?:unported|united states) license", "creative commons 3"),
    ("cc-by-sa-4.0", r"licensed under a creative commons attribution share ?alike 4 0 international license", "creative commons international"),
    ("cc-by-sa-3.0", r"licensed under a creative commons attribution share ?alike 3 0 (?:unported|united states) license", "creative commons 3"),
    ("cc-by-nc-4.0", r"licensed under a creative commons attribution non ?commercial 4 0 international license", "creative commons international"),
    ("cc-by-nd-4.0", r"licensed under a creative commons attribution no ?derivatives 4 0 international license", "creative commons international"),
    ("cc-by-nc-sa-4.0", r"licensed under a creative commons attribution non ?commercial share ?alike 4 0 international license", "creative commons international"),
    ("cc-by-nc-nd-4.0", r"licensed under a creative commons attribution non ?commercial no ?derivatives 4 0 international license", "creative commons international"),
    ("cc-by", r"you must give appropriate credit provide a link to the license and indicate if changes were made", "appropriate credit indicate"),
    ("cc-by-nc", r"you may not use the material for commercial purposes", "material commercial purposes"),
    ("cc-by-sa", r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original", "remix transform contributions"),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material", "remix transform modified"),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied", "intent conditions package"),
    ("artistic-2.0", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", "establishes package redistributed"),
    ("perl", r"you can redistribute it and or modify it under the same terms as perl itself", "redistribute terms perl"),
    ("psf-2.0", r"this license agreement is between the python software foundation psf and the individual or organization", "agreement python psf"),
    ("php-3.01", r"this product includes php software freely available from", "product includes php"),
    ("openssl", r"this product includes software developed by the openssl project", "product includes openssl"),
    ("ssleay", r"this product includes cryptographic software written by eric young", "product cryptographic eric"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license version 1 1", "font licensed sil"),
    ("w3c", r"by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms and conditions", "obtaining licensee comply"),
    ("unicode", r"unicode inc license agreement data files and software", "unicode agreement files"),
    ("vim", r"vim is charityware", "vim charityware"),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license", "governs accompanying accept"),
    ("sspl-1.0", r"server side public license", "server side public"),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service", "provide hosted managed"),
    ("busl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "licensor derivative production"),
    ("commons-clause", r"commons clause license condition", "commons clause condition"),
    ("polyform", r"polyform (?:noncommercial|small business|shield|perimeter|strict|free trial) license", "polyform license"),
    ("llama", r"built with (?:meta )?llama(?: [23])?", "built with llama"),
    ("openrail", r"you agree not to use the model or derivatives of the model in any way that violates", "agree model violates"),
)

#: Addresses of licenses, as words.
ADDRESSES = (
    ("gpl-2.0", r"gnu org licenses (?:old licenses )?gpl 2 0", "gnu org gpl"),
    ("gpl-3.0", r"gnu org licenses gpl 3 0", "gnu org gpl"),
    ("lgpl-2.1", r"gnu org licenses (?:old licenses )?lgpl 2 1", "gnu org lgpl"),
    ("lgpl-3.0", r"gnu org licenses lgpl 3 0", "gnu org lgpl"),
    ("agpl-3.0", r"gnu org licenses agpl 3 0", "gnu org agpl"),
    ("gfdl", r"gnu org licenses fdl(?: 1 3)?", "gnu org fdl"),
    ("gpl", r"gnu org (?:copyleft|licenses) gpl", "gnu org gpl"),
    ("lgpl", r"gnu org (?:copyleft|licenses) (?:lgpl|lesser)", "gnu org"),
    ("apache-2.0", r"apache org licenses license 2 0", "apache org licenses"),
    ("apache-1.1", r"apache org licenses license 1 1", "apache org licenses"),
    ("mit", r"opensource org licenses? mit(?: license)?", "opensource org mit"),
    ("isc", r"opensource org licenses? isc(?: license)?", "opensource org isc"),
    ("zlib", r"opensource org licenses? zlib(?: license)?", "opensource org zlib"),
    ("bsd-2-clause", r"opensource org licenses? bsd 2 clause", "opensource org bsd"),
    ("bsd-3-clause", r"opensource org licenses? bsd 3 clause", "opensource org bsd"),
    ("bsd", r"opensource org licenses? bsd license", "opensource org bsd"),
    ("apache-2.0", r"opensource org licenses? apache 2 0", "opensource org apache"),
    ("gpl-2.0", r"opensource org licenses? gpl 2 0", "opensource org gpl"),
    ("gpl-3.0", r"opensource org licenses? gpl 3 0", "opensource org gpl"),
    ("lgpl-2.1", r"opensource org licenses? lgpl 2 1", "opensource org lgpl"),
    ("lgpl-3.0", r"opensource org licenses? lgpl 3 0", "opensource org lgpl"),
    ("agpl-3.0", r"opensource org licenses? agpl 3 0", "opensource org agpl"),
    ("mpl-2.0", r"opensource org licenses? mpl 2 0", "opensource org mpl"),
    ("epl-1.0", r"opensource org licenses? epl 1 0", "opensource org epl"),
    ("epl-2.0", r"opensource org licenses? epl 2 0", "opensource org epl"),
    ("artistic-2.0", r"opensource org licenses? artistic(?: license)? 2 0", "opensource org artistic"),
    ("osl-3.0", r"opensource org licenses? osl 3 0", "opensource org osl"),
    ("mpl-2.0", r"mozilla org mpl 2 0", "mozilla org mpl"),
    ("mpl-1.1", r"mozilla org mpl (?:mpl )?1 1", "mozilla org mpl"),
    ("epl-1.0", r"eclipse org legal epl v10", "eclipse org v10"),
    ("epl-2.0", r"eclipse org legal epl (?:v20|2 0)", "eclipse org epl"),
    ("bsl-1.0", r"boost org license 1 0", "boost org license"),
    ("unlicense", r"unlicense org", "unlicense org"),
    ("wtfpl", r"wtfpl net", "wtfpl net"),
    ("php-3.01", r"php net license 3 0?1", "php net license"),
    ("ofl-1.1", r"scripts sil org ofl", "sil org ofl"),
    ("zlib", r"zlib net zlib license", "zlib net license"),
    ("public-domain", r"sqlite org copyright", "sqlite org copyright"),
    ("cc0-1.0", r"creativecommons org publicdomain zero(?: 1 0)?", "creativecommons publicdomain zero"),
    ("public-domain", r"creativecommons org publicdomain mark(?: 1 0)?", "creativecommons publicdomain mark"),
    ("cc-by-2.0", r"creativecommons org licenses by 2 0", "creativecommons by 2"),
    ("cc-by-3.0", r"creativecommons org licenses by 3 0", "creativecommons by 3"),
    ("cc-by-4.0", r"creativecommons org licenses by 4 0", "creativecommons by 4"),
    ("cc-by-sa-3.0", r"creativecommons org licenses by sa 3 0", "creativecommons sa 3"),
    ("cc-by-sa-4.0", r"creativecommons org licenses by sa 4 0", "creativecommons sa 4"),
    ("cc-by-nd-4.0", r"creativecommons org licenses by nd 4 0", "creativecommons nd 4"),
    ("cc-by-nc-3.0", r"creativecommons org licenses by nc 3 0", "creativecommons nc 3"),
    ("cc-by-nc-4.0", r"creativecommons org licenses by nc 4 0", "creativecommons nc 4"),
    ("cc-by-nc-sa-4.0", r"creativecommons org licenses by nc sa 4 0", "creativecommons sa 4"),
    ("cc-by-nc-nd-4.0", r"creativecommons org licenses by nc nd 4 0", "creativecommons nd 4"),
)

#: Licenses known by letters, and their versions; and those of which only the whole version is meant (Apache 2 is also a server).
FAMILIES = (
    ("gpl", "1.0 2.0 3.0"), ("lgpl", "2.0 2.1 3.0"), ("agpl", "3.0"), ("mpl", "1.0 1.1 2.0"), ("epl", "1.0 2.0"), ("cpl", "1.0"), ("cddl", "1.0 1.1"), ("eupl", "1.1 1.2"),
    ("afl", "3.0"), ("osl", "3.0"), ("ecl", "2.0"), ("upl", "1.0"), ("ofl", "1.1"), ("bsl", "1.0"), ("busl", "1.1"), ("artistic", "1.0 2.0"), ("odbl", "1.0"),
)
WHOLE = ("artistic", "bsl", "epl")
#: Other short forms: label, pattern, keywords as in ``LICENSES``.
SHORT = (
    ("apache-1.1", r"apache 1 1", "apache"),
    ("apache-2.0", r"apache (?:v|version )?2 0|apachev2(?: 0)?|asl 2 0", "apache|apachev2|asl"),
    ("gpl", r"gnu gpl|gpl licensed|licensed under (?:the )?gpl", "gpl"),
    ("lgpl", r"gnu (?:lesser|library) general public license|gnu lgpl|licensed under (?:the )?lgpl", "gnu|lgpl"),
    ("agpl-3.0", r"gnu agpl|licensed under (?:the )?agpl", "agpl"),
    ("gpl-2.0", r"gnu general public license either version 2(?: 0)?", "gnu"),
    ("gpl-3.0", r"gnu general public license either version 3(?: 0)?", "gnu"),
    ("lgpl-2.1", r"gnu lesser general public license either version 2 1", "gnu"),
    ("lgpl-3.0", r"gnu lesser general public license either version 3(?: 0)?", "gnu"),
    ("mit", r"licen[cs]ed? (?:under (?:the )?)?mit|mit licen[cs]ed|mit x11", "mit"),
    ("bsd", r"licen[cs]ed? (?:under (?:the )?)?bsd|bsd licensed", "bsd"),
    ("isc", r"licen[cs]ed? (?:under (?:the )?)?isc", "isc"),
    ("ms-pl", r"ms pl", "ms"),
    ("ms-rl", r"ms rl", "ms"),
    ("classpath-exception-2.0", r"classpath exception(?: 2 0)?", "classpath"),
    ("llvm-exception", r"llvm exceptions?", "llvm"),
    ("gcc-exception-3.1", r"gcc (?:runtime library )?exception(?: 3 1)?", "gcc"),
)
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Kinds of Creative Commons licenses: letters, and the words of the name.
CC_KINDS = (
    ("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?derivatives"), ("by nc", "attribution non ?commercial"),
    ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?derivatives"),
)


def short_forms() -> list[tuple[str, str, str]]:
    """``SHORT`` and the forms of ``FAMILIES``: letters, v or version, number."""
    out = list(SHORT)
    for name, versions in FAMILIES:
        for version in versions.split():
            number = version.replace(".", " ")
            if number.endswith(" 0") and name not in WHOLE:
                number = f"{number[:-2]}(?: 0)?"
            out.append((f"{name}-{version}", rf"{name}(?:v| v| version | ){number}(?: only| or later| or newer|)", f"{name}|{name}v{version[0]}"))
    return out


def names() -> list[tuple[str, str, str]]:
    """``LICENSES`` and the versions of Creative Commons licenses that it lacks."""
    out = list(LICENSES)
    known = {label for label, _, _ in out}
    for kind, words in CC_KINDS:
        for version in CC_VERSIONS:
            if (label := f"cc-{kind.replace(' ', '-')}-{version}") not in known:
                out.append((label, rf"(?:cc {kind}|creative commons {words}) {version.replace('.', ' ')}", version[0]))
    return out


def addresses() -> list[tuple[str, str, str]]:
    """``ADDRESSES`` and those of the Creative Commons licenses that it lacks."""
    out = list(ADDRESSES)
    known = {label for label, pattern, _ in out if pattern.startswith("creativecommons")}
    for kind, _ in CC_KINDS:
        for version in CC_VERSIONS:
            if (label := f"cc-{kind.replace(' ', '-')}-{version}") not in known:
                out.append((label, f"creativecommons org licenses {kind} {version.replace('.', ' ')}", f"creativecommons {kind.split()[-1]} {version[0]}"))
    return out


GRANT = r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?"


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keywords: frozenset[bytes]
    priority: int  # more wins
    relevance: float


def _rule(label: str, pattern: str, keywords: str, priority: int, relevance: float) -> Rule:
    return Rule(label, re.compile(rf"(?<= )(?:{pattern})(?= )".encode()), frozenset(keywords.encode().split()), priority, relevance)


def rules() -> list[Rule]:
    """From the surest to the least sure: identifiers, other members of their expressions, addresses, sentences of texts and notices, grants by name, names, short forms."""
    out = [_rule(label, pattern, words, 280, 1.0) for label, pattern, words in addresses()]
    out += [_rule(label, pattern, words, 260, 0.99) for label, pattern, words in TEXTS]
    for label, name, keyword in names():
        tag = label.replace("-", " ").replace(".", " ")
        out.append(_rule(label, rf"spdx license identifier {tag}(?: only| or later)?", "spdx identifier", 300, 1.0))
        out.append(_rule(label, rf"(?:or|and) {tag}(?: only| or later)?", f"spdx identifier {tag.split()[0]}", 290, 1.0))
        for one in keyword.split("|"):  # where two stand in the text, the second rule's detections lie within the first's
            out.append(_rule(label, GRANT + f"(?:{name})", f"under {one}", 200, 0.95))
            out.append(_rule(label, name, one, 100, 0.85))
    for label, name, keyword in short_forms():
        out += [_rule(label, name, one, 90, 0.7) for one in keyword.split("|")]
    out.append(_rule("copyleft", r"copyleft", "copyleft", 20, 0.4))
    out.append(_rule("all-rights-reserved", r"all rights reserved", "reserved", 20, 0.5))
    out.append(_rule("proprietary", r"proprietary and confidential|confidential and proprietary", "proprietary", 20, 0.5))
    return sorted(out, key=lambda r: -r.priority)


def _places(words: list[bytes], phrase: tuple[bytes, ...]) -> list[int]:
    out, i = [], -1
    while True:
        try:
            i = words.index(phrase[0], i + 1)
        except ValueError:
            return out
        if tuple(words[i : i + len(phrase)]) == phrase:
            out.append(i)


_start = itemgetter(0)


def scan(data: bytes, ordered: list[Rule]) -> dict:
    """All that is found in one text, given in UTF-8."""
    words = data.translate(TO_WORDS).split()
    there = set(words)
    base = [(i, label) for phrase, label in BASE if there.issuperset(p := tuple(w.encode() for w in phrase)) for i in _places(words, p)]
    tried = [r for r in ordered if r.keywords <= there]
    found: list[tuple[int, int, Rule]] = []
    if tried:
        joined = b" " + b" ".join(words) + b" "
        for r in tried:  # highest priority first
            for m in r.pattern.finditer(joined):
                found.append((m.start(), m.end(), r))
    found.sort(key=lambda x: (-x[2].priority, -(x[1] - x[0]), x[0], x[2].label))
    kept: list[tuple[int, int, Rule]] = []  # by start
    longest = 0
    for s, e, r in found:
        near = kept[bisect.bisect_left(kept, s - longest, key=_start) : bisect.bisect_right(kept, s, key=_start)]
        if not any(e <= b for _, b, _ in near):
            bisect.insort(kept, (s, e, r), key=_start)
            longest = max(longest, e - s)
    at = [i for i, _ in base]
    labels = {label for _, label in base}
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min(at, default=None),
        "last_word": max(at, default=None),
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | {r.label for _, _, r in kept})),
        "score": max([0.8 * bool(base), *(r.relevance for _, _, r in kept)]),
        "spans": [{"label": r.label, "first": joined.count(b" ", 0, s) - 1, "words": joined.count(b" ", s, e) + 1} for s, e, r in sorted(kept, key=lambda x: x[:2])],
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, words: long>>"


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: the id and what ``scan`` finds in the whole text.

    ``spans`` are the detections that count, as first word and number of words. Null
    texts count as empty: no words, no labels, score 0. Of detections of equal priority
    the longer, then the earlier one goes first; labels stand in name order. Repeated
    rows are scanned each; other columns are ignored, whatever their names. Texts are scanned
    whole, however long. No rows in, no rows out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = rules()
        types = {"score": pa.float64(), "base_labels": pa.string(), "labels": pa.string(), "spans": pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))}
        for batch in batches:
            found = [scan(x.as_py() or b"", ordered) for x in batch.column("text").cast(pa.binary())]
            new = [pa.array([x[k] for x in found], types.get(k, pa.int64())) for k in schema.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *new], schema.names)

    return rows.mapInArrow(run, schema)
