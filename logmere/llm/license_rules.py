"""Signature rules of the license scan: families of names, and the ways in which they are cited.

Rules see words in lower case with one space between them; other characters are gone.
"""

from __future__ import annotations

from typing import NamedTuple

LICENSE = "licen[sc]e"
#: Phrases that are always reported: words, label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

GPL = f"(?:gpl|general public {LICENSE})"
LGPL = f"(?:lgpl|(?:lesser|library) general public {LICENSE})"
AGPL = f"(?:agpl|affero general public {LICENSE})"
FDL = f"(?:fdl|free documentation {LICENSE})"
VERSION = "(?: version| ver| v)?"
LATER = "(?: or (?:at your option )?(?:any )?later(?: version)?| plus)"
CC = "(?:cc|creative commons)"
BY, NC, SA, ND = "(?:by|attribution)", "(?:nc|non ?commercial)", "(?:sa|share ?alike)", "(?:nd|no ?deriv(?:ative|atives|s)?)"

#: Label, words of its identifier, how its name is written, and what any such name has in it.
FAMILIES = (
    ("apache-1.1", "apache 1 1", f"apache(?: software)?(?: {LICENSE})?{VERSION} v?1 1", (" apache",)),
    ("apache-2.0", "apache 2 0", f"apache(?: software)?(?: {LICENSE})?{VERSION} v?2(?: 0)?", (" apache",)),
    ("apache", "apache", f"apache(?: software)? {LICENSE}", (" apache",)),
    ("mit", "mit", f"(?:mit|expat)(?: x11)? {LICENSE}", (" mit licen", " mit x11", " expat ")),
    ("mit-0", "mit 0", f"mit no attribution(?: {LICENSE})?", (" mit no ",)),
    ("x11", "x11", f"x11 {LICENSE}", (" x11 ",)),
    ("isc", "isc", f"isc {LICENSE}", (" isc licen",)),
    ("0bsd", "0bsd", f"(?:zero clause|0 clause) bsd(?: {LICENSE})?", (" bsd",)),
    ("bsd-2-clause", "bsd 2 clause", f"(?:(?:simplified|two clause|2 clause) bsd|bsd (?:2|two) clause)(?: {LICENSE})?", ("bsd",)),
    ("bsd-3-clause", "bsd 3 clause", f"(?:(?:new|revised|modified|three clause|3 clause) bsd|bsd (?:3|three) clause)(?: {LICENSE})?", ("bsd",)),
    ("bsd-4-clause", "bsd 4 clause", f"(?:(?:original|old|four clause|4 clause) bsd|bsd (?:4|four) clause)(?: {LICENSE})?", ("bsd",)),
    ("bsd", "bsd", f"bsd (?:style )?{LICENSE}", (" bsd",)),
    ("gpl", "gpl", f"(?:gnu )?{GPL}", ("gpl", "general public licen")),
    ("gpl-1.0", "gpl 1 0(?: only)?", f"(?:gnu )?{GPL}{VERSION} ?v?1(?: 0)?", ("gpl", "general public licen")),
    ("gpl-2.0", "gpl 2 0(?: only)?", f"(?:gnu )?{GPL}{VERSION} ?v?2(?: 0)?", ("gpl", "general public licen")),
    ("gpl-2.0-or-later", "gpl 2 0 or later", f"(?:gnu )?{GPL}{VERSION} ?v?2(?: 0)?{LATER}", ("gpl", "general public licen")),
    ("gpl-3.0", "gpl 3 0(?: only)?", f"(?:gnu )?{GPL}{VERSION} ?v?3(?: 0)?", ("gpl", "general public licen")),
    ("gpl-3.0-or-later", "gpl 3 0 or later", f"(?:gnu )?{GPL}{VERSION} ?v?3(?: 0)?{LATER}", ("gpl", "general public licen")),
    ("lgpl-2.0", "lgpl 2 0(?: only)?", f"(?:gnu )?{LGPL}{VERSION} ?v?2(?: 0)?", ("lgpl", "lesser general public", "library general public")),
    ("lgpl-2.1", "lgpl 2 1(?: only)?", f"(?:gnu )?{LGPL}{VERSION} ?v?2 1", ("lgpl", "lesser general public", "library general public")),
    ("lgpl-2.1-or-later", "lgpl 2 1 or later", f"(?:gnu )?{LGPL}{VERSION} ?v?2 1{LATER}", ("lgpl", "lesser general public", "library general public")),
    ("lgpl-3.0", "lgpl 3 0(?: only)?", f"(?:gnu )?{LGPL}{VERSION} ?v?3(?: 0)?", ("lgpl", "lesser general public", "library general public")),
    ("lgpl-3.0-or-later", "lgpl 3 0 or later", f"(?:gnu )?{LGPL}{VERSION} ?v?3(?: 0)?{LATER}", ("lgpl", "lesser general public", "library general public")),
    ("lgpl", "lgpl", f"(?:gnu )?{LGPL}", ("lgpl", "lesser general public", "library general public")),
    ("agpl-3.0", "agpl 3 0(?: only)?", f"(?:gnu )?{AGPL}{VERSION} ?v?3(?: 0)?", ("agpl", "affero")),
    ("agpl-3.0-or-later", "agpl 3 0 or later", f"(?:gnu )?{AGPL}{VERSION} ?v?3(?: 0)?{LATER}", ("agpl", "affero")),
    ("agpl", "agpl", f"(?:gnu )?{AGPL}", ("agpl", "affero")),
    ("gfdl-1.2", "gfdl 1 2(?: only)?", f"(?:gnu )?g?{FDL}{VERSION} ?v?1 2", ("fdl", "free documentation")),
    ("gfdl-1.3", "gfdl 1 3(?: only)?", f"(?:gnu )?g?{FDL}{VERSION} ?v?1 3", ("fdl", "free documentation")),
    ("gfdl", "gfdl", f"gnu {FDL}", ("fdl", "free documentation")),
    ("mpl-1.1", "mpl 1 1", f"(?:mozilla public {LICENSE}|mpl){VERSION} ?v?1 1", (" mpl ", "mozilla public")),
    ("mpl-2.0", "mpl 2 0", f"(?:mozilla public {LICENSE}|mpl){VERSION} ?v?2(?: 0)?", (" mpl ", "mozilla public")),
    ("mpl", "mpl", f"mozilla public {LICENSE}", (" mpl ", "mozilla public")),
    ("epl-1.0", "epl 1 0", f"(?:eclipse public {LICENSE}|epl){VERSION} ?v?1(?: 0)?", (" epl ", "eclipse public")),
    ("epl-2.0", "epl 2 0", f"(?:eclipse public {LICENSE}|epl){VERSION} ?v?2(?: 0)?", (" epl ", "eclipse public")),
    ("epl", "epl", f"eclipse public {LICENSE}", (" epl ", "eclipse public")),
    ("cddl-1.0", "cddl 1 0", f"(?:common development and distribution {LICENSE}|cddl)(?:{VERSION} ?v?1(?: 0)?)?", ("cddl", "common development and")),
    ("cpl-1.0", "cpl 1 0", f"common public {LICENSE}(?:{VERSION} ?v?1(?: 0)?)?", (" common public",)),
    ("eupl-1.2", "eupl 1 2", f"(?:european union public {LICENSE}|eupl)(?:{VERSION} ?v?1 2)?", ("eupl", "european union public")),
    ("ms-pl", "ms pl", f"(?:microsoft public {LICENSE}|ms pl)", (" ms pl ", "microsoft public")),
    ("ms-rl", "ms rl", f"(?:microsoft reciprocal {LICENSE}|ms rl)", (" ms rl ", "microsoft reciprocal")),
    ("artistic-1.0", "artistic 1 0", f"artistic {LICENSE}{VERSION} ?v?1(?: 0)?", (" artistic",)),
    ("artistic-2.0", "artistic 2 0", f"artistic {LICENSE}{VERSION} ?v?2(?: 0)?", (" artistic",)),
    ("artistic", "artistic", f"artistic {LICENSE}", (" artistic",)),
    ("zlib", "zlib", f"zlib(?: libpng)? {LICENSE}", (" zlib",)),
    ("boost-1.0", "bsl 1 0", f"boost software {LICENSE}(?:{VERSION} ?v?1(?: 0)?)?", (" boost",)),
    ("python-2.0", "python 2 0", f"(?:psf|python(?: software foundation)?) {LICENSE}(?:{VERSION} ?v?2(?: 0)?)?", (" psf licen", " python licen", " python software")),
    ("postgresql", "postgresql", f"postgresql {LICENSE}", (" postgresql",)),
    ("openssl", "openssl", f"openssl {LICENSE}", (" openssl",)),
    ("unlicense", "unlicense", "the unlicense", (" unlicense",)),
    ("wtfpl", "wtfpl", "(?:wtfpl|do what the f[^ ]* you want to public licen[sc]e)", ("wtfpl", "do what the f")),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {LICENSE}", (" ncsa",)),
    ("ofl-1.1", "ofl 1 1", f"(?:sil )?open font {LICENSE}(?:{VERSION} ?v?1 1)?", (" open font",)),
    ("odbl-1.0", "odbl 1 0", f"(?:open database {LICENSE}|odbl)(?:{VERSION} ?v?1(?: 0)?)?", ("odbl", "open database")),
    ("odc-by-1.0", "odc by 1 0", f"open data commons attribution {LICENSE}", (" open data",)),
    ("pddl-1.0", "pddl 1 0", f"public domain dedication and {LICENSE}", (" dedication",)),
    ("cc0-1.0", "cc0 1 0", "(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?", ("cc0", "creative commons zero")),
    ("cc-by", "cc by", f"{CC} {BY}(?: {LICENSE})?", ("cc by", "cc attribution", "creative commons")),
    ("cc-by-2.0", "cc by 2 0", f"{CC} {BY}(?: {LICENSE})?{VERSION} 2 0", ("cc by", "cc attribution", "creative commons")),
    ("cc-by-3.0", "cc by 3 0", f"{CC} {BY}(?: {LICENSE})?{VERSION} 3 0", ("cc by", "cc attribution", "creative commons")),
    ("cc-by-4.0", "cc by 4 0", f"{CC} {BY}(?: {LICENSE})?{VERSION} 4 0", ("cc by", "cc attribution", "creative commons")),
    ("cc-by-sa-3.0", "cc by sa 3 0", f"{CC} {BY} {SA}{VERSION} 3 0", ("cc by", "cc attribution", "creative commons")),
    ("cc-by-sa-4.0", "cc by sa 4 0", f"{CC} {BY} {SA}{VERSION} 4 0", ("cc by", "cc attribution", "creative commons")),
    ("cc-by-sa", "cc by sa", f"{CC} {BY} {SA}", ("cc by", "cc attribution", "creative commons")),
    ("cc-by-nc-4.0", "cc by nc 4 0", f"{CC} {BY} {NC}{VERSION} 4 0", ("cc by", "cc attribution", "creative commons")),
    ("cc-by-nc", "cc by nc", f"{CC} {BY} {NC}", ("cc by", "cc attribution", "creative commons")),
    ("cc-by-nd", "cc by nd", f"{CC} {BY} {ND}(?: 4 0)?", ("cc by", "cc attribution", "creative commons")),
    ("cc-by-nc-sa", "cc by nc sa", f"{CC} {BY} {NC} {SA}(?: 4 0)?", ("cc by", "cc attribution", "creative commons")),
    ("cc-by-nc-nd", "cc by nc nd", f"{CC} {BY} {NC} {ND}(?: 4 0)?", ("cc by", "cc attribution", "creative commons")),
    ("afl-3.0", "afl 3 0", f"academic free {LICENSE}(?:{VERSION} ?v?3(?: 0)?)?", (" academic free licen",)),
    ("osl-3.0", "osl 3 0", f"open software {LICENSE}(?:{VERSION} ?v?3(?: 0)?)?", (" open software licen",)),
    ("ecl-2.0", "ecl 2 0", f"educational community {LICENSE}(?:{VERSION} ?v?2(?: 0)?)?", (" educational community licen",)),
    ("cecill", "cecill(?: [bc]|(?: 2)? [01])?", f"cecill(?: [bc])?(?: free software)? {LICENSE}(?: agreement)?", (" cecill",)),
    ("mulan-psl-2.0", "mulanpsl 2 0", f"mulan (?:psl|permissive software {LICENSE})(?:{VERSION} ?v?2(?: 0)?)?", (" mulan",)),
    ("php-3.01", "php 3 01", f"php {LICENSE}(?:{VERSION} ?v?3(?: 01)?)?", (" php licen",)),
    ("ruby", "ruby", f"ruby(?: s)? {LICENSE}", (" ruby licen", " ruby s licen")),
    ("vim", "vim", f"vim {LICENSE}", (" vim licen",)),
    ("qpl-1.0", "qpl 1 0", f"q public {LICENSE}(?:{VERSION} ?v?1(?: 0)?)?", (" q public licen",)),
    ("apsl-2.0", "apsl 2 0", f"apple public source {LICENSE}(?:{VERSION} ?v?2(?: 0)?)?", (" apple public source licen",)),
    ("ipl-1.0", "ipl 1 0", f"ibm public {LICENSE}(?:{VERSION} ?v?1(?: 0)?)?", (" ibm public licen",)),
    ("lppl-1.3c", "lppl 1 3[ac]?", f"latex project public {LICENSE}(?:{VERSION} ?v?1 3[ac]?)?", (" latex project public licen",)),
    ("zpl-2.1", "zpl 2 1", f"zope public {LICENSE}(?:{VERSION} ?v?2 1)?", (" zope public licen",)),
    ("rpl-1.5", "rpl 1 5", f"reciprocal public {LICENSE}(?:{VERSION} ?v?1 5)?", (" reciprocal public licen",)),
    ("spl-1.0", "spl 1 0", f"sun public {LICENSE}(?:{VERSION} ?v?1(?: 0)?)?", (" sun public licen",)),
    ("w3c", "w3c", f"w3c software(?: notice and)? {LICENSE}", (" w3c",)),
    ("unicode", "unicode (?:dfs 2016|3 0|tou)", f"unicode {LICENSE}(?: agreement| v3)?", (" unicode licen",)),
    ("hpnd", "hpnd", "historical permission notice and disclaimer", (" permission notice and disclaimer",)),
    ("curl", "curl", f"curl {LICENSE}", (" curl licen",)),
    ("ftl", "ftl", f"freetype(?: project)? {LICENSE}", (" freetype",)),
    ("ubuntu-font", "ubuntu font 1 0", f"ubuntu font {LICENSE}", (" ubuntu font licen",)),
    ("upl-1.0", "upl 1 0", f"universal permissive {LICENSE}(?:{VERSION} ?v?1(?: 0)?)?", (" universal permissive licen",)),
    ("blueoak-1.0.0", "blueoak 1 0 0", f"blue oak model {LICENSE}(?:{VERSION} ?v?1(?: 0){{0,2}})?", (" blue oak model licen",)),
    ("sspl-1.0", "sspl 1 0", f"server side public {LICENSE}(?:{VERSION} ?v?1(?: 0)?)?", (" server side public licen",)),
    ("elastic-2.0", "elastic 2 0", f"elastic {LICENSE}(?:{VERSION} ?v?2(?: 0)?)?", (" elastic licen",)),
    ("busl-1.1", "busl 1 1", f"business source {LICENSE}(?:{VERSION} ?v?1 1)?", (" business source licen",)),
    ("openrail", "openrail(?: m)?", f"(?:open(?: and)? responsible ai {LICENSE}s?|(?:bigscience |creativeml )?openrail(?: m)?(?: {LICENSE})?)", (" responsible ai licen", "openrail")),
    ("cdla-permissive-2.0", "cdla permissive 2 0", f"community data {LICENSE} agreement permissive(?:{VERSION} ?v?2(?: 0)?)?", (" community data licen",)),
    ("etalab-2.0", "etalab 2 0", f"(?:etalab )?licence ouverte(?:{VERSION} ?v?2(?: 0)?)?", (" licence ouverte",)),
    ("ogl-uk-3.0", "ogl uk 3 0", f"open government {LICENSE}(?:{VERSION} ?v?3(?: 0)?)?", (" open government licen",)),
)

#: Ways to cite a family: order (first wins), confidence, pattern, keyword if not the family's.
GRANT = "(?:licen[sc]ed|released|distributed|available|published|provided|covered)"
CITED = (
    (0, 1.0, "spdx licen[sc]e identifier {id}", (" spdx licen",)),
    (1, 0.95, GRANT + "(?: [^ ]+){{0,3}} under (?:the )?(?:terms of (?:the )?)?{name}", ()),
    (2, 0.7, "{name}", ()),
)

QUOTED = "[^ ]?as is[^ ]?"

#: Passages of license texts, notices, addresses and other signs, each written by hand:
#: label, order, confidence, pattern, what every text that it fits has in it.
SIGNS = (
    # Permissive texts.
    ("mit", 1, 0.9, "permission is hereby granted free of charge to any person obtaining a copy", " hereby granted "),
    ("mit", 1, 0.9, "to deal in the software without restriction including without limitation the rights", " deal in the software "),
    ("mit", 1, 0.8, "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies", " permission notice "),
    ("mit", 1, 0.8, "in no event shall the authors or copyright holders be liable for any claim damages or other liability", " copyright holders "),
    ("ncsa", 1, 0.9, "to deal with the software without restriction including without limitation", " deal with the software "),
    ("isc", 1, 0.9, "permission to use copy modify and(?: or)? distribute this software", " permission to use "),
    ("isc", 1, 0.8, f"the software is provided {QUOTED} and the author disclaims all warranties", " warranties "),
    ("postgresql", 1, 0.9, "distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", " written agreement is hereby granted "),
    ("boost-1.0", 1, 0.9, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", " hereby granted "),
    ("zlib", 1, 0.9, "the origin of this software must not be misrepresented", " must not be misrepresented"),
    ("zlib", 1, 0.9, "altered source versions must be plainly marked as such", " altered source versions "),
    ("zlib", 1, 0.8, f"this software is provided {QUOTED} without any express or implied warranty", " implied warranty "),
    ("bsd", 1, 0.9, "redistribution and use in source and binary forms", " redistribution "),
    ("bsd", 1, 0.9, "redistributions of source code must retain the(?: above)? copyright notice", " redistributions "),
    ("bsd", 1, 0.9, "redistributions in binary form must reproduce the above copyright notice", " redistributions "),
    ("bsd", 1, 0.8, f"this software is provided by(?: [^ ]+){{1,9}} {QUOTED} and any express or implied warranties", " implied warranties "),
    ("bsd-3-clause", 1, 0.9, "neither the names? of(?: [^ ]+){1,14} may be used to endorse or promote products", " endorse or promote "),
    ("bsd-4-clause", 1, 0.9, "all advertising materials mentioning features or use of this software must display", " advertising materials "),
    ("apache-1.1", 1, 0.8, "this product includes software developed by the apache software foundation", " the apache software foundation "),
    ("apache-2.0", 1, 0.95, "apache license version 2 0 january 2004", " apache license "),
    ("apache-2.0", 1, 0.9, "you may not use this file except in compliance with the license", " in compliance with the license "),
    ("apache-2.0", 1, 0.8, "unless required by applicable law or agreed to in writing software distributed under the license", " distributed under the license "),
    ("apache-2.0", 1, 0.9, "perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? (?:copyright|patent) license", " royalty free "),
    ("apache-2.0", 1, 0.8, "subject to the terms and conditions of this license each contributor hereby grants to you", " conditions of this license "),
    ("openssl", 1, 0.9, "this product includes software developed by the openssl project", " the openssl project "),
    ("python-2.0", 1, 0.9, f"psf is making python available to licensee on an {QUOTED} basis", " to licensee "),
    ("artistic-1.0", 1, 0.9, "the intent of this document is to state the conditions under which a package may be copied", " a package may be copied "),
    ("artistic-2.0", 1, 0.9, "this license establishes the terms under which a given free software package may be copied", " software package may be copied "),
    ("json", 1, 0.95, "the software shall be used for good not evil", " for good not evil "),
    ("beerware", 1, 0.95, "you can buy me a beer in return", " buy me a beer "),
    ("beerware", 1, 0.9, "the beer ?ware license", " beerware license ", " beer ware license "),
    ("unlicense", 1, 0.9, "this is free and unencumbered software released into the public domain", " unencumbered "),
    ("unlicense", 1, 0.9, "anyone is free to copy modify publish use compile sell or distribute this software", " distribute this software "),
    ("wtfpl", 1, 0.95, "you just do what the f[^ ]* you want to", " just do what the f"),
    ("wtfpl", 1, 0.8, "copy and distribute verbatim or modified copies of this license document", " this license document "),
    ("cecill", 1, 0.9, "this software is governed by the cecill(?: [bc])? license", " cecill"),
    # Copyleft texts.
    ("gpl", 1, 0.9, "this (?:program|library|file|software) is free software you can redistribute it", " can redistribute it "),
    ("gpl", 1, 0.8, "everyone is permitted to copy and distribute verbatim copies of this license document", " this license document "),
    ("gpl", 1, 0.9, "you should have received a copy of the gnu general public license", " the gnu general public license "),
    ("gpl-2.0", 1, 0.95, "gnu general public license version 2 june 1991", " gnu general public license "),
    ("gpl-2.0", 1, 0.9, "the licenses for most software are designed to take away your freedom", " the licenses for most software "),
    ("gpl-2.0", 1, 0.9, "activities other than copying distribution and modification are not covered by this license", " not covered by this license "),
    ("gpl-3.0", 1, 0.95, "gnu general public license version 3 29 june 2007", " gnu general public license "),
    ("gpl-3.0", 1, 0.9, "the gnu general public license is a free copyleft license", " copyleft license "),
    ("gpl-3.0", 1, 0.9, "the licenses for most software and other practical works are designed to take away your freedom", " the licenses for most software "),
    ("gpl-3.0", 1, 0.8, "no covered work shall be deemed part of an effective technological measure", " no covered work "),
    ("gpl-exception", 1, 0.9, "as a special exception(?: [^ ]+){0,12} give(?:s)? (?:you )?permission to link", " permission to link "),
    ("gpl-exception", 1, 0.9, "(?:classpath|gcc runtime library|font|linux syscall note) exception", " classpath exception ", " gcc runtime library exception ", " font exception ", " linux syscall note exception "),
    ("lgpl", 1, 0.9, "you should have received a copy of the gnu (?:lesser|library) general public license", " general public license "),
    ("lgpl-2.1", 1, 0.95, "gnu lesser general public license version 2 1 february 1999", " lesser general public license "),
    ("lgpl-2.1", 1, 0.9, "contains no derivative of any portion of the library but is designed to work with the library", " portion of the library "),
    ("lgpl-3.0", 1, 0.95, "gnu lesser general public license version 3 29 june 2007", " lesser general public license "),
    ("agpl", 1, 0.9, "you should have received a copy of the gnu affero general public license", " affero general public license "),
    ("agpl-3.0", 1, 0.95, "gnu affero general public license version 3 19 november 2007", " affero general public license "),
    ("agpl-3.0", 1, 0.9, "remote network interaction use with the gnu general public license", " the gnu general public license "),
    ("gfdl", 1, 0.9, "permission is granted to copy distribute and or modify this document", " permission is granted "),
    ("gfdl", 1, 0.9, "no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts", " no invariant sections "),
    ("mpl-1.1", 1, 0.95, "the contents of this file are subject to the mozilla public license version 1 1", " the mozilla public license "),
    ("mpl-2.0", 1, 0.95, "this source code form is subject to the terms of the mozilla public license v 2 0", " the mozilla public license "),
    ("mpl-2.0", 1, 0.9, "if a copy of the mpl was not distributed with this file", " a copy of the mpl "),
    ("epl", 1, 0.9, "the accompanying program is provided under the terms of this eclipse public license", " this eclipse public license "),
    ("epl", 1, 0.9, "this program and the accompanying materials are made available under the terms of the eclipse public license", " the eclipse public license "),
    ("cddl-1.0", 1, 0.95, "the contents of this file are subject to the terms of the common development and distribution license", " common development and distribution license "),
    ("ofl-1.1", 1, 0.95, "this font software is licensed under the sil open font license", " open font license "),
    ("ofl-1.1", 1, 0.8, "neither the font software nor any of its individual components(?: [^ ]+){0,6} may be sold by itself", " the font software "),
    ("sspl-1.0", 1, 0.9, "offering the program as a service(?: [^ ]+){0,40} service source code", " service source code "),
    ("busl-1.1", 1, 0.8, "additional use grant(?: [^ ]+){0,60} change date", " additional use grant "),
    ("elastic-2.0", 1, 0.9, "you may not provide the software to third parties as a hosted or managed service", " hosted or managed service "),
    ("commons-clause", 1, 0.95, "commons clause license condition", " commons clause license "),
    ("commons-clause", 1, 0.9, "the grant of rights under the license will not include and the license does not grant to you the right to sell the software", " right to sell the software "),
    ("llama", 1, 0.9, "llama [0-9]+(?: [0-9]+)?(?: version)? community license(?: agreement)?", " community license "),
    # Creative Commons deeds, texts and notices.
    ("creative-commons", 1, 0.7, "creative commons corporation (?:[^ ]+ )?is not a law firm and does not provide legal services", " creative commons "),
    ("creative-commons", 2, 0.6, "some rights reserved", " some rights reserved "),
    ("cc-by", 1, 0.7, "you must give appropriate credit provide a link to the license and indicate if changes were made", " appropriate credit "),
    ("cc-by-sa", 1, 0.8, "you must distribute your contributions under the same license as the original", " the same license as the original "),
    ("cc-by-nc", 1, 0.8, "you may not use the material for commercial purposes", " the material for commercial purposes "),
    ("cc-by-nd", 1, 0.8, "you may not distribute the modified material", " the modified material "),
    ("cc0-1.0", 1, 0.9, "the person who associated a work with this deed has dedicated the work to the public domain", " to the public domain "),
    ("cc0-1.0", 1, 0.9, "to the extent possible under law(?: [^ ]+){0,12} waived all copyright and related or neighboring rights", " waived all copyright "),
    # Addresses.
    ("mit", 1, 0.9, "opensource org licenses? mit(?: license)?", " opensource org licen"),
    ("bsd-2-clause", 1, 0.9, "opensource org licenses? bsd 2 clause", " opensource org licen"),
    ("bsd-3-clause", 1, 0.9, "opensource org licenses? bsd 3 clause", " opensource org licen"),
    ("isc", 1, 0.9, "opensource org licenses? isc(?: license)?", " opensource org licen"),
    ("apache-2.0", 1, 0.95, "apache org licenses license 2 0", " apache org licenses "),
    ("gpl-2.0", 1, 0.9, "gnu org licenses (?:old licenses )?gpl 2 0", " gnu org licenses "),
    ("gpl-3.0", 1, 0.9, "gnu org licenses gpl 3 0", " gnu org licenses "),
    ("gpl", 1, 0.8, "gnu org (?:licenses|copyleft) gpl", " gnu org licenses ", " gnu org copyleft "),
    ("lgpl-2.1", 1, 0.9, "gnu org licenses (?:old licenses )?lgpl 2 1", " gnu org licenses "),
    ("lgpl-3.0", 1, 0.9, "gnu org licenses lgpl 3 0", " gnu org licenses "),
    ("agpl-3.0", 1, 0.9, "gnu org licenses agpl 3 0", " gnu org licenses "),
    ("gfdl", 1, 0.8, "gnu org (?:licenses|copyleft) fdl", " gnu org licenses ", " gnu org copyleft "),
    ("mpl-2.0", 1, 0.95, "mozilla org mpl 2 0", " mozilla org mpl "),
    ("mpl-1.1", 1, 0.9, "mozilla org mpl mpl 1 1", " mozilla org mpl "),
    ("epl-1.0", 1, 0.9, "eclipse org legal epl v ?10", " eclipse org legal epl "),
    ("epl-2.0", 1, 0.9, "eclipse org legal epl (?:2 0|v ?20)", " eclipse org legal epl "),
    ("boost-1.0", 1, 0.9, "boost org license 1 0(?: txt)?", " boost org license "),
    ("unlicense", 1, 0.9, "unlicense org", " unlicense org "),
    ("ofl-1.1", 1, 0.9, "(?:scripts sil|openfontlicense) org(?: ofl)?", " scripts sil org ", " openfontlicense "),
    ("odbl-1.0", 1, 0.9, "opendatacommons org licenses odbl", " opendatacommons org licenses "),
    ("odc-by-1.0", 1, 0.9, "opendatacommons org licenses by", " opendatacommons org licenses "),
    ("pddl-1.0", 1, 0.9, "opendatacommons org licenses pddl", " opendatacommons org licenses "),
    ("cc0-1.0", 1, 0.95, "creativecommons org publicdomain zero 1 0", " creativecommons org "),
    ("public-domain", 1, 0.8, "creativecommons org publicdomain mark 1 0", " creativecommons org "),
    ("cc-by", 1, 0.8, "creativecommons org licenses by", " creativecommons org "),
    ("cc-by-2.0", 1, 0.95, "creativecommons org licenses by 2 0", " creativecommons org "),
    ("cc-by-3.0", 1, 0.95, "creativecommons org licenses by 3 0", " creativecommons org "),
    ("cc-by-4.0", 1, 0.95, "creativecommons org licenses by 4 0", " creativecommons org "),
    ("cc-by-sa", 1, 0.9, "creativecommons org licenses by sa", " creativecommons org "),
    ("cc-by-sa-3.0", 1, 0.95, "creativecommons org licenses by sa 3 0", " creativecommons org "),
    ("cc-by-sa-4.0", 1, 0.95, "creativecommons org licenses by sa 4 0", " creativecommons org "),
    ("cc-by-nc", 1, 0.9, "creativecommons org licenses by nc", " creativecommons org "),
    ("cc-by-nc-4.0", 1, 0.95, "creativecommons org licenses by nc 4 0", " creativecommons org "),
    ("cc-by-nd", 1, 0.9, "creativecommons org licenses by nd(?: 4 0)?", " creativecommons org "),
    ("cc-by-nc-sa", 1, 0.9, "creativecommons org licenses by nc sa(?: 4 0)?", " creativecommons org "),
    ("cc-by-nc-nd", 1, 0.9, "creativecommons org licenses by nc nd(?: 4 0)?", " creativecommons org "),
    # Public domain, rights, secrecy, warranty.
    ("public-domain", 2, 0.6, "(?:released |placed )?in(?:to)? the public domain", " the public domain "),
    ("public-domain", 2, 0.7, "dedicate[sd]?(?: [^ ]+){0,8} to the public domain", " to the public domain "),
    ("public-domain", 2, 0.7, "(?:is|are) not subject to copyright(?: protection)?(?: in the united states)?", " subject to copyright "),
    ("copyright", 3, 0.4, "copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", " copyright "),
    ("copyright", 3, 0.4, "[^ ]*\u00a9[^ ]* ?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", "\u00a9"),
    ("reserved", 2, 0.6, "todos los derechos reservados", " derechos reservados "),
    ("reserved", 2, 0.6, "tous droits r[e\u00e9]serv[e\u00e9]s", " tous droits r"),
    ("reserved", 2, 0.6, "alle rechte vorbehalten", " rechte vorbehalten "),
    ("reserved", 2, 0.6, "tutti i diritti riservati", " diritti riservati "),
    ("reserved", 2, 0.6, "todos os direitos reservados", " direitos reservados "),
    ("no-reproduction", 2, 0.7, "no part of this (?:publication|book|document|work|website|site) may be (?:reproduced|copied)", " no part of this "),
    ("no-reproduction", 2, 0.7, "(?:may not be|must not be) (?:copied|reproduced|republished|redistributed)", " not be copied ", " not be reproduced ", " not be republished ", " not be redistributed "),
    ("no-reproduction", 2, 0.7, "reproduction(?: [^ ]+){0,6} is (?:strictly )?(?:prohibited|forbidden)", " reproduction "),
    ("proprietary", 2, 0.6, "(?:proprietary and confidential|confidential and proprietary)", " proprietary "),
    ("proprietary", 2, 0.8, "unauthorized copying of this (?:file|software|document)(?: [^ ]+){0,5} is strictly prohibited", " unauthorized copying "),
    ("proprietary", 2, 0.7, "contains (?:the )?(?:proprietary|confidential)(?: and (?:proprietary|confidential))? information", " proprietary ", " confidential "),
    ("non-commercial", 2, 0.6, "for (?:personal(?: and| or)? )?non ?commercial use only", " commercial use only ", " noncommercial use only "),
    ("academic-use", 2, 0.6, "for (?:academic|educational|research)(?: (?:and|or) (?:academic|educational|research))? (?:use|purposes) only", " use only ", " purposes only "),
    ("no-warranty", 3, 0.3, "without (?:any )?warrant(?:y|ies) of any kind", " of any kind "),
    ("no-warranty", 3, 0.3, "without even the implied warranty of merchantability", " implied warranty "),
    ("no-warranty", 3, 0.3, "merchantability(?: or)? fitness for a particular purpose", " merchantability "),
)

#: Any keyword of a rule has one of these in it; only texts with one are looked at further.
GATES = (
    "licen", "copy", "gpl", "bsd", "software", "public", "creative", "cc by", "cc attribution", "cc0", "reserv", "riservati",
    "vorbehalten", "droits r", "permission", "warrant", "granted", "apache", "artistic", " boost", " mit ", " x11 ", " expat ",
    " mpl ", " epl ", " ms pl ", " ms rl ", "buy me a beer", "cecill", "exception ", "use only ", "purposes only ", " dedication",
    "confidential", "proprietary", "endorse or promote", "advertising materials", "freetype", "for good not evil",
    "managed service ", "do what the f", "merchantability", " mulan", "misrepresented", " ncsa", "covered work",
    "invariant sections", "no part of this ", "not be re", " of any kind ", "open data", " open font", "openssl", "of the library ",
    "postgresql", "redistribution", "reproduction ", "royalty free", "scripts sil", "service source code", "the material for comm",
    "modified material", "unencumbered", "additional use grant", " w3c", "zlib", "affero", "cddl", "development and", "eupl", "fdl",
    "free documentation", "odbl", "openrail", "wtfpl", "source versions ", "be copied", "appropriate credit", "redistribute", "microsoft", "\u00a9",
)


class Rule(NamedTuple):
    label: str
    order: int
    confidence: float
    pattern: str
    keywords: tuple[str, ...]


def _words(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def all_rules() -> list[Rule]:
    """Several hundred rules; one of its keywords is in every text that a rule fits."""
    rules = [Rule(label, 2, 0.6, _words(phrase), (f" {phrase} ",)) for phrase, label in BASE]
    rules += [Rule(a, o, c, _words(p), tuple(k)) for a, o, c, p, *k in SIGNS]
    for label, identifier, name, keywords in FAMILIES:
        for order, confidence, form, sign in CITED:
            pattern = _words(form.format(id=identifier, name=name))
            rules.append(Rule(label, order, confidence, pattern, sign or keywords))
    return rules
