"""License scans with ordered signature rules, in DataFrame functions only.

A text is lower-cased (A-Z) and reduced to its words, one space between them. Each rule is gated by one
word that whatever it matches must hold (a test proves that for every rule); the text's words are looked
up among these at once, so that only few regular expressions see a text, whatever the number of rules.
Detections are intervals. One that lies within another that stays (or equals one of a better rule) is suppressed;
of two that overlap in part, the one of lower priority is, if the other stays: what is suppressed suppresses
nothing. Base phrases are counted exactly and never suppressed. Everything is a projection of the row: no shuffle, and no limit on texts or detections.

Defined results: null and empty texts have no words, no places and score 0; places are null when there
are none; repeated rows give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: phrase -> label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Families of versioned licenses: label, (word that a match holds, name) of each name, versions.
_VERSIONED = [
    ("gpl", (("general", r"(?:gnu )?(?<!lesser )(?<!library )(?<!affero )general public licen[cs]e"), ("gpl", r"gnu gpl"), ("gpl", r"gpl")), ("1", "2", "3")),
    ("lgpl", (("lesser", r"(?:gnu )?lesser general public licen[cs]e"), ("library", r"(?:gnu )?library general public licen[cs]e"), ("lgpl", r"(?:gnu )?lgpl")), ("2", "2.1", "3")),
    ("agpl", (("affero", r"(?:gnu )?affero general public licen[cs]e"), ("agpl", r"(?:gnu )?agpl")), ("1", "3")),
    ("gfdl", (("documentation", r"(?:gnu )?free documentation licen[cs]e"), ("gfdl", r"gfdl")), ("1.1", "1.2", "1.3")),
    ("apache", (("apache", r"apache(?: software)? licen[cs]e"), ("apache", r"apache")), ("1.0", "1.1", "2.0", "2")),
    ("mpl", (("mozilla", r"mozilla public licen[cs]e"), ("mpl", r"mpl")), ("1.0", "1.1", "2.0")),
    ("epl", (("eclipse", r"eclipse public licen[cs]e"), ("epl", r"epl")), ("1.0", "2.0")),
    ("cddl", (("distribution", r"common development and distribution licen[cs]e"), ("cddl", r"cddl")), ("1.0", "1.1")),
    ("cpl", (("common", r"common public licen[cs]e"),), ("1.0",)),
    ("eupl", (("european", r"european union public licen[cs]e"), ("eupl", r"eupl")), ("1.0", "1.1", "1.2")),
    ("artistic", (("artistic", r"artistic licen[cs]e"),), ("1.0", "2.0")),
    ("afl", (("academic", r"academic free licen[cs]e"),), ("1.1", "2.0", "2.1", "3.0")),
    ("osl", (("open", r"open software licen[cs]e"),), ("1.0", "2.0", "2.1", "3.0")),
    ("cecill", (("cecill", r"cecill(?: free software licen[cs]e agreement)?"),), ("1.0", "2.0", "2.1")),
    ("ofl", (("sil", r"sil open font licen[cs]e"),), ("1.0", "1.1")),
    ("boost", (("boost", r"boost software licen[cs]e"),), ("1.0",)),
    ("business-source", (("source", r"business source licen[cs]e"),), ("1.0", "1.1")),
    ("zpl", (("zope", r"zope public licen[cs]e"),), ("1.1", "2.0", "2.1")),
    ("odbl", (("database", r"open database licen[cs]e"), ("odbl", r"odbl")), ("1.0",)),
    ("psf", (("python", r"python software foundation licen[cs]e"),), ("2",)),
    ("lppl", (("latex", r"latex project public licen[cs]e"),), ("1.0", "1.2", "1.3")),
]
# Creative Commons: code, attribute words, versions.
_CC = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s?", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# Signatures written by hand: label, word that a match holds, priority, weight, pattern.
_SINGLE = [
    # MIT and its kin
    ("mit", "mit", 60, 0.9, r"(?:the )?mit licen[cs]e"),
    ("mit", "mit", 70, 0.95, r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e"),
    ("mit", "mit", 55, 0.85, r"(?:mit licensed|licensed under mit|licen[cs]e mit|mit style licen[cs]e)"),
    ("mit", "expat", 60, 0.85, r"expat licen[cs]e"),
    ("mit", "granted", 80, 0.95, r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "substantial", 70, 0.85, r"copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", 50, 0.6, r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "opensource", 70, 0.95, r"opensource org licenses mit(?: license)?(?: php)?"),
    ("mit-0", "attribution", 65, 0.9, r"mit no attribution(?: licen[cs]e)?"),
    ("mit-0", "mit", 65, 0.9, r"mit 0"),
    ("x11", "x11", 60, 0.85, r"x11 licen[cs]e"),
    ("x11", "consortium", 60, 0.85, r"x consortium licen[cs]e"),
    ("isc", "disclaims", 70, 0.8, r"the author disclaims all warranties with regard to this software"),
    ("isc", "fee", 80, 0.9, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "isc", 60, 0.9, r"isc licen[cs]e"),
    ("hpnd", "fee", 75, 0.85, r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
    ("hpnd", "historical", 60, 0.85, r"historical permission notice and disclaimer"),
    ("curl", "curl", 60, 0.85, r"curl licen[cs]e"),
    ("fair", "usage", 70, 0.85, r"usage of the works is permitted provided that this instrument is retained"),
    ("fair", "fair", 55, 0.8, r"fair licen[cs]e"),
    ("beerware", "beer", 65, 0.9, r"(?:the )?beer ware licen[cs]e"),
    ("beerware", "beerware", 60, 0.9, r"beerware(?: licen[cs]e)?"),
    ("beerware", "beer", 80, 0.95, r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    # BSD
    ("bsd", "bsd", 50, 0.8, r"(?:new |modified |simplified |revised )?bsd licen[cs]e"),
    ("bsd", "bsd", 45, 0.75, r"(?:bsd licensed|licensed under bsd|bsd style licen[cs]e|under the bsd)"),
    ("bsd", "redistribution", 70, 0.9, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", 65, 0.85, r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", 65, 0.85, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-2-clause", "bsd", 65, 0.9, r"(?:bsd 2 clause|2 clause bsd|simplified bsd licen[cs]e)"),
    ("bsd-2-clause", "freebsd", 60, 0.85, r"freebsd licen[cs]e"),
    ("bsd-2-clause", "two", 65, 0.9, r"two clause bsd"),
    ("bsd-2-clause", "bsd", 70, 0.95, r"opensource org licenses bsd 2 clause"),
    ("bsd-2-clause-patent", "patent", 70, 0.9, r"bsd 2 clause (?:plus )?patent(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", 65, 0.9, r"(?:bsd 3 clause|3 clause bsd|new bsd licen[cs]e|modified bsd licen[cs]e)"),
    ("bsd-3-clause", "three", 65, 0.9, r"three clause bsd"),
    ("bsd-3-clause", "endorse", 75, 0.9, r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", "bsd", 70, 0.95, r"opensource org licenses bsd 3 clause"),
    ("bsd-3-clause-clear", "clear", 70, 0.9, r"(?:the )?clear bsd licen[cs]e"),
    ("bsd-4-clause", "bsd", 65, 0.9, r"(?:bsd 4 clause|4 clause bsd|original bsd licen[cs]e)"),
    ("bsd-4-clause", "four", 65, 0.9, r"four clause bsd"),
    ("bsd-4-clause", "advertising", 75, 0.9, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("0bsd", "0bsd", 65, 0.9, r"0bsd"),
    ("0bsd", "zero", 65, 0.9, r"zero clause bsd"),
    ("0bsd", "zero", 66, 0.9, r"bsd zero clause licen[cs]e"),
    ("0bsd", "public", 55, 0.8, r"free public licen[cs]e 1 0 0"),
    ("ncsa", "ncsa", 60, 0.85, r"(?:university of illinois )?ncsa open source licen[cs]e"),
    ("ncsa", "illinois", 55, 0.85, r"university of illinois open source licen[cs]e"),
    ("zlib", "zlib", 60, 0.85, r"zlib(?: libpng)? licen[cs]e"),
    ("zlib", "misrepresented", 75, 0.9, r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", 70, 0.85, r"altered source versions must be plainly marked as such"),
    ("libpng", "libpng", 60, 0.85, r"libpng licen[cs]e(?: version 2)?"),
    ("libtiff", "libtiff", 60, 0.85, r"libtiff licen[cs]e"),
    # GNU
    ("gpl-2", "gplv2", 60, 0.95, r"gplv2"),
    ("gpl-2-or-later", "gplv2", 70, 0.95, r"gplv2 or (?:any )?later"),
    ("gpl-3", "gplv3", 60, 0.95, r"gplv3"),
    ("gpl-3-or-later", "gplv3", 70, 0.95, r"gplv3 or (?:any )?later"),
    ("gpl-2", "gpl2", 55, 0.9, r"gpl2"),
    ("gpl-3", "gpl3", 55, 0.9, r"gpl3"),
    ("lgpl-2.1", "lgplv2", 60, 0.95, r"lgplv2 1"),
    ("lgpl-2", "lgplv2", 55, 0.9, r"lgplv2"),
    ("lgpl-3", "lgplv3", 60, 0.95, r"lgplv3"),
    ("agpl-3", "agplv3", 60, 0.95, r"agplv3"),
    ("gpl", "redistribute", 65, 0.85, r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "redistribute", 66, 0.85, r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("agpl", "redistribute", 66, 0.85, r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl", "gnu", 50, 0.8, r"www gnu org (?:licenses|copyleft) gpl(?: html)?"),
    ("lgpl", "gnu", 50, 0.8, r"www gnu org (?:licenses|copyleft) lesser(?: html)?"),
    ("agpl", "gnu", 50, 0.8, r"www gnu org licenses agpl(?: html)?"),
    ("gpl", "gpl", 35, 0.7, r"(?:gpl licensed|licensed under (?:the )?gpl|gpl compatible)"),
    ("gpl-exception", "classpath", 70, 0.9, r"classpath exception"),
    ("gpl-exception", "linking", 60, 0.8, r"special exception to the terms and conditions of the gpl linking"),
    ("gpl-exception", "gcc", 65, 0.85, r"gcc runtime library exception"),
    ("gpl-exception", "font", 60, 0.8, r"gpl font exception"),
    ("gfdl", "invariant", 65, 0.85, r"with no invariant sections(?: no front cover texts and no back cover texts)?"),
    # Apache, Mozilla, Eclipse and other copyleft per file
    ("apache-2.0", "apache", 80, 0.95, r"licensed under the apache licen[cs]e version 2 0"),
    ("apache-2.0", "apache", 75, 0.95, r"www apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", "asl", 55, 0.85, r"asl 2 0"),
    ("apache", "compliance", 40, 0.6, r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache", "writing", 40, 0.6, r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e"),
    ("apache-exception", "llvm", 70, 0.9, r"(?:apache licen[cs]e v2 0 )?with llvm exceptions?"),
    ("mpl-2.0", "mpl", 80, 0.95, r"if a copy of the mpl was not distributed with this file"),
    ("mpl-2.0", "mozilla", 80, 0.95, r"subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl", "mozilla", 50, 0.85, r"www mozilla org mpl(?: 2 0| mpl 1 1 html)?"),
    ("epl", "eclipse", 50, 0.85, r"www eclipse org legal epl v ?[12]0?(?: html)?"),
    ("npl", "netscape", 60, 0.85, r"netscape public licen[cs]e(?: version 1 [01])?"),
    ("spl", "sun", 60, 0.85, r"sun public licen[cs]e(?: version 1 0)?"),
    ("sissl", "sun", 60, 0.85, r"sun industry standards source licen[cs]e"),
    ("ipl", "ibm", 60, 0.85, r"ibm public licen[cs]e(?: version 1 0)?"),
    ("qpl", "q", 60, 0.85, r"q public licen[cs]e(?: version 1 0)?"),
    ("rpl", "reciprocal", 60, 0.85, r"reciprocal public licen[cs]e(?: 1 [15])?"),
    ("cpal", "attribution", 60, 0.85, r"common public attribution licen[cs]e(?: version 1 0)?"),
    ("apsl", "apple", 60, 0.85, r"apple public source licen[cs]e(?: version [12] [0-2])?"),
    ("ms-pl", "microsoft", 60, 0.9, r"microsoft public licen[cs]e"),
    ("ms-pl", "ms", 55, 0.85, r"ms pl"),
    ("ms-rl", "microsoft", 60, 0.9, r"microsoft reciprocal licen[cs]e"),
    ("ms-rl", "ms", 55, 0.85, r"ms rl"),
    ("lpl", "lucent", 60, 0.85, r"lucent public licen[cs]e(?: version 1 0?[02]?)?"),
    ("nosa", "nasa", 60, 0.85, r"nasa open source agreement(?: 1 3)?"),
    ("oclc", "oclc", 60, 0.85, r"oclc research public licen[cs]e(?: 2 0)?"),
    ("rpsl", "realnetworks", 60, 0.85, r"realnetworks public source licen[cs]e"),
    ("sleepycat", "sleepycat", 60, 0.85, r"sleepycat licen[cs]e"),
    ("watcom", "watcom", 60, 0.85, r"sybase open watcom public licen[cs]e"),
    ("simple", "simple", 60, 0.85, r"simple public licen[cs]e(?: 2 0)?"),
    ("motosoto", "motosoto", 60, 0.85, r"motosoto open source licen[cs]e"),
    ("nokia", "nokia", 60, 0.85, r"nokia open source licen[cs]e"),
    ("interbase", "interbase", 60, 0.85, r"interbase public licen[cs]e"),
    ("erlang", "erlang", 60, 0.85, r"erlang public licen[cs]e(?: version 1 1)?"),
    ("yahoo", "yahoo", 60, 0.85, r"yahoo public licen[cs]e(?: version 1 [01])?"),
    ("sugarcrm", "sugarcrm", 60, 0.85, r"sugarcrm public licen[cs]e"),
    ("openldap", "openldap", 60, 0.85, r"openldap public licen[cs]e(?: version 2 \d)?"),
    ("mulan", "mulan", 60, 0.9, r"mulan (?:permissive software|psl|publ) ?(?:licen[cs]e)?(?: v ?[12])?"),
    ("osl", "osl", 55, 0.85, r"osl 3 0"),
    ("afl", "afl", 55, 0.85, r"afl 3 0"),
    ("eudatagrid", "datagrid", 60, 0.85, r"eu datagrid software licen[cs]e"),
    ("cua", "cua", 60, 0.85, r"cua office public licen[cs]e"),
    ("entessa", "entessa", 60, 0.85, r"entessa public licen[cs]e"),
    ("frameworx", "frameworx", 60, 0.85, r"frameworx(?: open)? licen[cs]e(?: 1 0)?"),
    ("ecl", "educational", 60, 0.85, r"educational community licen[cs]e(?: version [12] 0)?"),
    ("aal", "assurance", 60, 0.85, r"attribution assurance licen[cs]e"),
    ("ntp", "ntp", 60, 0.85, r"ntp licen[cs]e"),
    ("upl", "permissive", 60, 0.9, r"universal permissive licen[cs]e"),
    ("upl", "upl", 55, 0.85, r"upl (?:version )?1 0"),
    ("blueoak", "oak", 60, 0.9, r"blue oak model licen[cs]e(?: 1 0 0)?"),
    ("w3c", "w3c", 60, 0.85, r"w3c software(?: notice and| and document)?(?: notice)? licen[cs]e"),
    ("icu", "icu", 60, 0.85, r"icu licen[cs]e"),
    ("unicode", "unicode", 60, 0.85, r"unicode licen[cs]e(?: agreement)?(?: v3)?"),
    ("xnet", "net", 55, 0.8, r"x net licen[cs]e"),
    ("eiffel", "eiffel", 60, 0.85, r"eiffel forum licen[cs]e(?: version [12])?"),
    ("intel", "intel", 60, 0.85, r"intel (?:simplified software|open source) licen[cs]e"),
    ("catosl", "associates", 60, 0.85, r"computer associates trusted open source licen[cs]e(?: 1 1)?"),
    ("ogtsl", "group", 60, 0.85, r"open group test suite licen[cs]e"),
    ("naumen", "naumen", 60, 0.85, r"naumen public licen[cs]e"),
    ("vsl", "vovida", 60, 0.85, r"vovida software licen[cs]e(?: v 1 0)?"),
    ("wxwindows", "wxwindows", 60, 0.85, r"wxwindows library licen[cs]e"),
    ("miros", "miros", 60, 0.85, r"miros licen[cs]e"),
    # languages and programs
    ("postgresql", "postgresql", 60, 0.9, r"(?:the )?postgresql licen[cs]e"),
    ("vim", "vim", 60, 0.85, r"vim licen[cs]e"),
    ("php", "php", 60, 0.85, r"php licen[cs]e(?: version \d(?: \d+)?)?"),
    ("ruby", "ruby", 60, 0.85, r"ruby licen[cs]e"),
    ("ruby", "ruby", 65, 0.85, r"under the same terms as ruby(?: itself)?"),
    ("perl", "perl", 60, 0.85, r"under the same terms as perl itself"),
    ("perl", "perl", 55, 0.8, r"same terms as perl"),
    ("tcl", "tcl", 60, 0.85, r"tcl(?: tk)? licen[cs]e"),
    ("lua", "lua", 60, 0.8, r"lua licen[cs]e"),
    ("openssl", "openssl", 60, 0.85, r"openssl licen[cs]e"),
    ("openssl", "openssl", 75, 0.9, r"this product includes software developed by the openssl project"),
    ("json", "json", 60, 0.85, r"json licen[cs]e"),
    ("json", "evil", 80, 0.95, r"the software shall be used for good not evil"),
    ("imagemagick", "imagemagick", 60, 0.85, r"imagemagick licen[cs]e"),
    ("freetype", "freetype", 60, 0.85, r"freetype(?: project)? licen[cs]e"),
    ("ijg", "jpeg", 70, 0.85, r"this software is based in part on the work of the independent jpeg group"),
    ("bzip2", "bzip2", 60, 0.85, r"bzip2 licen[cs]e"),
    ("info-zip", "zip", 60, 0.85, r"info zip licen[cs]e"),
    ("net-snmp", "snmp", 60, 0.85, r"net snmp licen[cs]e"),
    ("python", "cnri", 60, 0.85, r"cnri(?: open source)?(?: python)? licen[cs]e(?: agreement)?"),
    ("python", "beopen", 60, 0.85, r"beopen(?: com)?(?: python)? open source licen[cs]e"),
    ("psf", "psf", 60, 0.85, r"psf licen[cs]e(?: agreement)?"),
    ("jasper", "jasper", 60, 0.85, r"jasper licen[cs]e(?: version 2 0)?"),
    ("mpich", "mpich", 60, 0.85, r"mpich licen[cs]e"),
    ("tmate", "tmate", 60, 0.85, r"tmate open source licen[cs]e"),
    ("ssh", "ssh", 55, 0.8, r"ssh openssh licen[cs]e"),
    ("stlport", "stlport", 60, 0.85, r"stlport licen[cs]e"),
    # public domain and dedications
    ("unlicense", "unlicense", 60, 0.9, r"(?:the )?unlicense"),
    ("unlicense", "unencumbered", 75, 0.9, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone", 65, 0.8, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "wtfpl", 60, 0.9, r"wtfpl"),
    ("wtfpl", "fuck", 70, 0.9, r"do what the fuck you want to(?: public licen[cs]e)?"),
    ("public-domain", "domain", 40, 0.7, r"(?:in|into|to) the public domain"),
    ("public-domain", "domain", 45, 0.75, r"(?:dedicated|released|placed) (?:in|into|to) the public domain"),
    ("public-domain", "domain", 40, 0.7, r"public domain dedication"),
    ("public-domain", "sqlite", 65, 0.8, r"sqlite blessing"),
    ("public-domain", "disclaims", 60, 0.75, r"the author hereby disclaims copyright"),
    ("pddl", "domain", 60, 0.9, r"public domain dedication and licen[cs]e"),
    ("pddl", "pddl", 60, 0.9, r"pddl(?: 1 0)?"),
    ("cc0", "cc0", 60, 0.95, r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "publicdomain", 70, 0.95, r"creativecommons org publicdomain zero 1 0"),
    ("cc0", "commons", 65, 0.9, r"creative commons zero(?: v ?1 0)?(?: universal)?"),
    ("cc-pdm", "publicdomain", 70, 0.9, r"creativecommons org publicdomain mark 1 0"),
    ("glwt", "glwt", 60, 0.8, r"glwt(?: public licen[cs]e)?"),
    # content, data, fonts, models
    ("cc", "commons", 25, 0.5, r"creative commons(?: public)? licen[cs]e"),
    ("cc", "commons", 20, 0.45, r"licensed under (?:a )?creative commons"),
    ("cc-by-igo", "igo", 65, 0.9, r"cc by 3 0 igo"),
    ("odc-by", "odc", 60, 0.9, r"odc by(?: 1 0)?"),
    ("odc-by", "attribution", 60, 0.9, r"open data commons attribution licen[cs]e"),
    ("odbl", "odbl", 58, 0.9, r"open data commons open database licen[cs]e odbl"),
    ("dbcl", "contents", 60, 0.85, r"database contents licen[cs]e"),
    ("ogl-uk", "government", 60, 0.9, r"open government licen[cs]e(?: v ?[123] 0)?"),
    ("etalab", "etalab", 60, 0.9, r"(?:licence ouverte |open licence )?etalab(?: 2 0)?"),
    ("dl-de", "datenlizenz", 60, 0.9, r"datenlizenz deutschland(?: namensnennung| zero)?(?: 2 0)?"),
    ("cdla-permissive", "community", 60, 0.9, r"community data licen[cs]e agreement permissive(?: [12] 0)?"),
    ("cdla-sharing", "community", 60, 0.9, r"community data licen[cs]e agreement sharing(?: 1 0)?"),
    ("cdla-permissive", "cdla", 55, 0.85, r"cdla permissive(?: [12] 0)?"),
    ("c-uda", "computational", 60, 0.85, r"computational use of data agreement"),
    ("free-art", "art", 60, 0.85, r"(?:free art licen[cs]e|licence art libre)(?: 1 3)?"),
    ("opl", "publication", 55, 0.8, r"open publication licen[cs]e(?: v ?1 0)?"),
    ("ofl", "font", 55, 0.85, r"open font licen[cs]e(?: version 1 [01])?"),
    ("ofl", "ofl", 50, 0.85, r"ofl(?: 1 1)"),
    ("bitstream-vera", "vera", 60, 0.85, r"bitstream vera(?: fonts)? (?:licen[cs]e|copyright)"),
    ("ubuntu-font", "ubuntu", 60, 0.85, r"ubuntu font licen[cs]e(?: version 1 0)?"),
    ("arphic", "arphic", 60, 0.85, r"arphic public licen[cs]e"),
    ("ogl-game", "game", 55, 0.8, r"open game licen[cs]e(?: version 1 0a?)?"),
    ("openrail", "openrail", 60, 0.9, r"(?:creativeml |bigcode |bigscience )?openrail(?: m| plus plus m)?(?: licen[cs]e)?"),
    ("rail", "rail", 55, 0.85, r"(?:bigscience )?rail licen[cs]e(?: v ?1 0)?"),
    ("responsible-ai", "responsible", 55, 0.85, r"responsible ai licen[cs]e"),
    ("gutenberg", "gutenberg", 60, 0.85, r"project gutenberg licen[cs]e"),
    ("hippocratic", "hippocratic", 60, 0.9, r"hippocratic licen[cs]e(?: [123] [012])?"),
    ("anti-996", "996", 60, 0.85, r"anti 996 licen[cs]e(?: version 1 0)?"),
    # source available and commercial
    ("sspl", "server", 60, 0.9, r"server side public licen[cs]e(?: version 1| v ?1)?"),
    ("sspl", "sspl", 55, 0.9, r"sspl(?: 1 0)?"),
    ("elastic", "elastic", 60, 0.9, r"elastic licen[cs]e(?: 2 0)?"),
    ("confluent", "confluent", 60, 0.9, r"confluent community licen[cs]e(?: agreement)?"),
    ("redis-source", "redis", 60, 0.9, r"redis source available licen[cs]e"),
    ("functional-source", "functional", 60, 0.9, r"functional source licen[cs]e(?: version 1 [01])?"),
    ("polyform", "polyform", 60, 0.9, r"polyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use)(?: licen[cs]e)?(?: 1 0 [01])?"),
    ("prosperity", "prosperity", 60, 0.85, r"prosperity public licen[cs]e(?: 3 0 0)?"),
    ("parity", "parity", 60, 0.85, r"parity public licen[cs]e(?: 7 0 0)?"),
    ("commons-clause", "clause", 60, 0.85, r"commons clause(?: licen[cs]e)?(?: condition)?"),
    ("timescale", "timescale", 60, 0.85, r"timescale licen[cs]e(?: agreement)?"),
    ("aladdin", "aladdin", 60, 0.85, r"aladdin free public licen[cs]e"),
    ("non-commercial", "commercial", 30, 0.6, r"for non commercial (?:use|purposes|research)(?: only)?"),
    ("non-commercial", "noncommercial", 30, 0.6, r"for noncommercial (?:use|purposes|research)(?: only)?"),
    ("academic-only", "academic", 30, 0.6, r"for academic (?:use|purposes|research)(?: only)?"),
    ("evaluation", "evaluation", 30, 0.6, r"(?:for evaluation purposes only|evaluation licen[cs]e)"),
    ("freeware", "freeware", 25, 0.5, r"freeware"),
    ("shareware", "shareware", 25, 0.5, r"shareware"),
    ("proprietary", "reserved", 10, 0.3, r"all rights reserved"),
    ("proprietary", "proprietary", 20, 0.4, r"proprietary and confidential"),
    ("proprietary", "confidential", 20, 0.4, r"confidential and proprietary"),
    ("proprietary", "proprietary", 20, 0.4, r"proprietary (?:licen[cs]e|software)"),
    ("proprietary", "prohibited", 25, 0.5, r"unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: of this file| or distribution)?(?: via any medium)? is strictly prohibited"),
    ("proprietary", "eula", 25, 0.5, r"eula"),
    ("proprietary", "end", 25, 0.5, r"end user licen[cs]e agreement"),
    ("proprietary", "permission", 20, 0.4, r"may not be reproduced (?:in any form )?without (?:the )?(?:prior )?(?:written )?permission"),
    ("commercial", "commercial", 20, 0.4, r"commercial licen[cs]e"),
    ("commercial", "dual", 20, 0.4, r"dual licensed"),
    # notices that name no license
    ("copyright", "copyright", 5, 0.2, r"copyright (?:c )?\d{4}"),
    ("warranty-disclaimer", "provided", 15, 0.4, r"provided as is without (?:express or implied )?warrant(?:y|ies)(?: of any kind)?"),
    ("warranty-disclaimer", "warranty", 15, 0.4, r"without any warranty without even the implied warranty of merchantability"),
    ("warranty-disclaimer", "liable", 15, 0.4, r"in no event shall the (?:authors?|copyright holders?|regents)(?: or (?:copyright holders|contributors))? be liable"),
    ("generic", "licensed", 5, 0.3, r"licensed under(?: the)?(?: [a-z0-9]+){1,3} licen[cs]e"),
    ("generic", "identifier", 5, 0.3, r"spdx licen[cs]e identifier [a-z0-9]+"),
    # identifiers
    ("mit", "spdx", 90, 1.0, r"spdx license identifier mit"),
    ("isc", "spdx", 90, 1.0, r"spdx license identifier isc"),
    ("0bsd", "spdx", 90, 1.0, r"spdx license identifier 0bsd"),
    ("bsd-2-clause", "spdx", 90, 1.0, r"spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", "spdx", 90, 1.0, r"spdx license identifier bsd 3 clause"),
    ("apache-2.0", "spdx", 90, 1.0, r"spdx license identifier apache 2 0"),
    ("mpl-2.0", "spdx", 90, 1.0, r"spdx license identifier mpl 2 0"),
    ("epl-2.0", "spdx", 90, 1.0, r"spdx license identifier epl 2 0"),
    ("gpl-2-only", "spdx", 90, 1.0, r"spdx license identifier gpl 2 0(?: only)?"),
    ("gpl-2-or-later", "spdx", 95, 1.0, r"spdx license identifier gpl 2 0 or later"),
    ("gpl-3-only", "spdx", 90, 1.0, r"spdx license identifier gpl 3 0(?: only)?"),
    ("gpl-3-or-later", "spdx", 95, 1.0, r"spdx license identifier gpl 3 0 or later"),
    ("lgpl-2.1-only", "spdx", 90, 1.0, r"spdx license identifier lgpl 2 1(?: only)?"),
    ("lgpl-2.1-or-later", "spdx", 95, 1.0, r"spdx license identifier lgpl 2 1 or later"),
    ("lgpl-3-only", "spdx", 90, 1.0, r"spdx license identifier lgpl 3 0(?: only)?"),
    ("agpl-3-only", "spdx", 90, 1.0, r"spdx license identifier agpl 3 0(?: only)?"),
    ("agpl-3-or-later", "spdx", 95, 1.0, r"spdx license identifier agpl 3 0 or later"),
    ("unlicense", "spdx", 90, 1.0, r"spdx license identifier unlicense"),
    ("cc0", "spdx", 90, 1.0, r"spdx license identifier cc0 1 0"),
    ("zlib", "spdx", 90, 1.0, r"spdx license identifier zlib"),
    ("boost-1.0", "spdx", 90, 1.0, r"spdx license identifier bsl 1 0"),
    ("business-source-1.1", "spdx", 90, 1.0, r"spdx license identifier busl 1 1"),
    ("ofl-1.1", "spdx", 90, 1.0, r"spdx license identifier ofl 1 1"),
    ("proprietary", "spdx", 90, 1.0, r"spdx license identifier licenseref proprietary"),
    ("boost", "bsl", 50, 0.8, r"bsl 1 0"),
    ("business-source", "bsl", 50, 0.8, r"bsl 1 1"),
    ("business-source", "busl", 55, 0.9, r"busl(?: 1 1)?"),
]


def rules() -> list[tuple[str, str, int, float, str]]:
    """(label, word that a match holds, priority, weight, pattern): the families spelled out, then the signatures written by hand."""
    out = []
    for (label, names, versions), tail in itertools.product(_VERSIONED, ("", "only", "later")):
        for word, name in names:
            for v in versions:
                number = v.replace(".", " ")
                if v.isdigit() and label in ("gpl", "lgpl", "agpl"):
                    number += "(?: 0)?"
                end = {"": "", "only": " only", "later": " or (?:at your option )?(?:any )?later(?: version)?|@ and later|@\\+"}[tail].split("|@")
                for e in end[:2]:
                    out.append((f"{label}-{v}{'-' + tail if tail == 'only' else '-or-later' if tail else ''}", word, 60 + 10 * bool(tail), 0.95, f"{name} (?:version |v ?)?{number}{e}"))
            if not tail:
                out.append((label, word, 30, 0.7, name if "licen" in name else f"{name} licen[cs]e"))
    for code, words in _CC.items():
        short = code.replace("-", " ")
        for v in _CC_VERSIONS:
            number = v.replace(".", " ")
            out.append((f"cc-{code}-{v}", "cc", 60, 0.95, f"cc {short} {number}"))
            out.append((f"cc-{code}-{v}", "commons", 60, 0.95, f"creative commons {words} {number}"))
            out.append((f"cc-{code}-{v}", "creativecommons", 70, 0.95, f"creativecommons org licenses {short} {number}"))
        out.append((f"cc-{code}", "cc", 40 + len(code), 0.8, f"cc {short}"))
        out.append((f"cc-{code}", "commons", 40 + len(code), 0.8, f"creative commons {words}"))
    return list(dict.fromkeys(out + _SINGLE))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _rule_map(table) -> Column:
    """word -> array of (id, pattern) as one literal."""
    by: dict = {}
    for i, (_, keyword, _, _, pattern) in enumerate(table):
        by.setdefault(keyword, []).append((i, pattern))
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{quoted(k)}, array({', '.join(f'struct({i} as id, {quoted(_bounded(p))} as pattern)' for i, p in v)})" for k, v in by.items()) + ")")


def _bounded(pattern: str) -> str:
    """Whole words only."""
    return f"(?<= )(?:{pattern})(?= )"


@functools.cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(_bounded(pattern))


def detections(norm: Column, table) -> Column:
    """All (start, end, id) of the rules whose word the text holds; offsets count characters."""
    by_keyword = _rule_map(table)
    keywords = F.array_intersect(F.map_keys(by_keyword), F.split(norm, " "))
    chosen = F.flatten(F.transform(keywords, lambda k: F.element_at(by_keyword, k)))

    def places(rule: Column) -> Column:
        found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
        gaps = F.transform(F.split(norm, rule["pattern"], -1), lambda g: F.length(g))
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:int,stop:int,id:int>>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            begin = a["at"] + F.element_at(gaps, a["i"] + 1)
            end = begin + F.length(x)
            return F.struct(end.alias("at"), (a["i"] + 1).alias("i"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("stop"), rule["id"].alias("id")))).alias("out"))

        return F.when(F.size(found) == 0, start["out"]).otherwise(F.aggregate(found, start, step, lambda a: a["out"]))

    return F.flatten(F.transform(chosen, places))


def resolved(found: Column, table) -> Column:
    """The detections that stay: one gives way to another that stays and holds it whole, or overlaps it and has a higher priority.

    Those that no other holds are settled first, by falling priority, and then those within them, which come back if what
    held them is gone. What is suppressed suppresses nothing.
    """
    priority = F.array(*[F.lit(r[2]) for r in table])
    rank = lambda d: F.element_at(priority, d["id"] + 1)
    kind = "array<struct<start:int,stop:int,id:int,priority:int>>"
    plain = lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("stop"), d["id"].alias("id"), (-d["low"]).alias("priority"))
    ordered = F.transform(F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("back"), (-rank(d)).alias("low"), d["id"].alias("id")))), plain)
    start = F.struct(F.lit(-1).alias("to"), F.array().cast(kind).alias("kept"))

    def settled(all_: Column, outer: Column) -> Column:
        first = lambda x: F.transform(F.array_sort(F.transform(x, lambda d: F.struct((-d["priority"]).alias("low"), (d["start"] - d["stop"]).alias("long"), d["start"].alias("start"), (-d["stop"]).alias("back"), d["id"].alias("id")))), plain)
        holds = lambda k, d: (k["start"] <= d["start"]) & (k["stop"] >= d["stop"])
        beats = lambda k, d: (k["priority"] > d["priority"]) & (k["start"] < d["stop"]) & (d["start"] < k["stop"])
        queue = F.concat(first(outer), first(F.array_except(all_, outer)))
        return F.aggregate(queue, F.array().cast(kind), lambda kept, d: F.when(F.exists(kept, lambda k: holds(k, d) | beats(k, d)), kept).otherwise(F.concat(kept, F.array(d))))

    def decided(all_: Column) -> Column:
        outer = F.aggregate(all_, start, lambda a, d: F.when(d["stop"] <= a["to"], a).otherwise(F.struct(d["stop"].alias("to"), F.concat(a["kept"], F.array(d)).alias("kept"))), lambda a: a["kept"])

        def rivals(x: Column) -> Column:
            # ordered by start and by end, so one that overlaps any other overlaps a neighbour; else nothing is at odds
            near = F.transform(x, lambda d, i: F.coalesce(F.try_element_at(x, i + 2)["start"] < d["stop"], F.lit(False)))
            return F.when(F.exists(near, lambda v: v) & (F.size(F.array_distinct(F.transform(x, lambda d: d["priority"]))) > 1), settled(all_, x)).otherwise(x)

        return _let(outer, rivals)

    return _let(ordered, decided)


def scan(docs: DataFrame, base: dict[str, str] = BASE, table=None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of each row."""
    table = table or rules()
    for phrase in base:
        w = phrase.split(" ")
        if any(w[:i] == w[-i:] for i in range(1, len(w))):
            raise ValueError(f"places of {phrase!r} could overlap")
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.btrim(F.regexp_replace(F.translate(text, UPPER, LOWER), SEPARATOR, " "))
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    rows = docs.select("doc_id", F.concat(F.lit(" "), words, F.lit(" ")).alias("norm"))
    rows = rows.withColumn("n_words", F.when(F.col("norm") == "  ", 0).otherwise(spaces(F.col("norm")) - 1).cast("long"))

    def place(phrase: str, label: str) -> Column:
        size = len(phrase.split(" "))
        return _let(F.split("norm", f" {phrase}(?= )", -1), lambda p: F.struct(
            (F.size(p) - 1).alias("n"), F.when(F.size(p) > 1, spaces(F.element_at(p, 1))).alias("first"),
            F.when(F.size(p) > 1, F.col("n_words") - spaces(F.element_at(p, -1)) + 1 - size).alias("last"), F.lit(label).alias("label")))

    found = [place(*x) for x in base.items()]
    rows = rows.withColumns({"base": F.filter(F.array(*found), lambda p: p["n"] > 0), "found": resolved(detections(F.col("norm"), table), table)})
    label, weight = F.array(*[F.lit(r[0]) for r in table]), F.array(*[F.lit(r[3]) for r in table])
    own = F.transform("found", lambda d: F.element_at(label, d["id"] + 1))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda p: p["label"])))
    best = F.array_max(F.concat(F.transform("found", lambda d: F.element_at(weight, d["id"] + 1)), F.transform("base", lambda p: F.lit(1.0)), F.array(F.lit(0.0))))
    return rows.select(
        "doc_id", "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["last"])).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, base_labels))), ",").alias("labels"),
        best.alias("score"),
        F.size("found").alias("n_detections"),
    )


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute(text: str | None, base: dict[str, str] = BASE, table=None) -> tuple:
    """The same for one text without any gate, for tests."""
    table = table or rules()
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = []
    for phrase, label in base.items():
        p = phrase.split()
        at += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    norm = f" {' '.join(words)} "
    found = []
    for i, (_, _, rank, _, pattern) in enumerate(table):
        found += [(m.start(), -m.end(), -rank, i) for m in _compiled(pattern).finditer(norm)]
    spans = [(s, -e, -rank, i) for s, e, rank, i in found]
    holds = lambda k, d: k[0] <= d[0] and k[1] >= d[1]
    # of equal spans the one of the highest priority, then the first rule, holds the others
    inner = [d for d in spans if any(k != d and holds(k, d) and ((k[0], k[1]) != (d[0], d[1]) or (k[2], -k[3]) > (d[2], -d[3])) for k in spans)]
    left: list = []
    for group in ([d for d in spans if d not in inner], inner):
        for d in sorted(group, key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
            if not any(holds(k, d) or (k[2] > d[2] and k[0] < d[1] and d[0] < k[1]) for k in left):
                left.append(d)
    names = sorted({x for _, x in at})
    labels = sorted({*names, *(table[d[3]][0] for d in left)})
    score = max([0.0, *[table[d[3]][3] for d in left], *[1.0 for _ in at]])
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(names), ",".join(labels), score, len(left)
