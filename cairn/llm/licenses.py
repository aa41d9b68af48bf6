"""License scans by ordered signature rules, in DataFrame operations alone.

A text is brought to words (A-Z lower-cased, all between words one space). A rule is a label, a priority, a regular
expression over words, and a keyword: a literal that every match must hold. SIGNATURES are sentences of licence texts and notices; names
of licences with their versions make up the other rules (a tag, the full name, "under" and the short name). Few documents pass
the gate, a list of substrings one of which every match holds; in those a rule's expression runs only if its keyword
occurs. Every match is an interval. A match that lies within a
match of the same or a better priority is suppressed, so "general public license version 2" doesn't also count as
"public license", nor "cc by nc 4 0" as "cc by". Matches that merely overlap both stay.

The phrases of PHRASES are always found, and their labels always stay. ``score`` is the confidence of the best label:
CONFIDENCE of its rule's priority, PHRASE_SCORE for phrases, 0 without any.

Defined results: a null, empty or wordless text has no words and no labels. Rows alike in doc_id and text get the same
labels. Other columns play no part.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of, written

#: What stands between words, before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_PHRASE = " (?:" + "|".join(PHRASES) + ")(?= )"
PHRASE_SCORE = 0.5
#: By priority: a tag, a full name, a short name after "under", a general statement.
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.75, 4: 0.5}
#: Words one of which most keywords hold; the gate has these and the keywords that hold none.
GATE = ("licen", "copyright", "reserved", "cc by", "cc0", "creative", "spdx", "public domain", "copyleft", "confidential", "warrant", "redistribut", "proprietary", "opensource", "bsd", " under ", "permission", "permitted", "software", "trademark", "patent")


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


#: label stem, words of the full name, short name, versions ("" for none).
FAMILIES = (
    ("apache", "apache(?: software)? licen[sc]e", "apache", ("1.0", "1.1", "2.0", "")),
    ("mit", "(?:the )?mit licen[sc]e", "mit", ("",)),
    ("x11", "x11 licen[sc]e", "x11", ("",)),
    ("isc", "isc licen[sc]e", "isc", ("",)),
    ("bsd-0-clause", "(?:zero clause bsd|0 ?bsd|bsd 0 clause)(?: licen[sc]e)?", "0bsd", ("",)),
    ("bsd-2-clause", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)(?: licen[sc]e)?", "bsd 2 clause", ("",)),
    ("bsd-3-clause", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: licen[sc]e)?", "bsd 3 clause", ("",)),
    ("bsd-4-clause", "(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[sc]e)?", "bsd 4 clause", ("",)),
    ("bsd", "bsd licen[sc]e", "bsd", ("",)),
    ("gpl", "(?:gnu )?general public licen[sc]e", "(?:gnu )?gpl", ("1.0", "2.0", "3.0", "")),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[sc]e", "(?:gnu )?lgpl", ("2.0", "2.1", "3.0", "")),
    ("agpl", "(?:gnu )?affero general public licen[sc]e", "(?:gnu )?agpl", ("1.0", "3.0", "")),
    ("gfdl", "(?:gnu )?free documentation licen[sc]e", "(?:gnu )?fdl", ("1.1", "1.2", "1.3", "")),
    ("mpl", "mozilla public licen[sc]e", "mpl", ("1.0", "1.1", "2.0", "")),
    ("epl", "eclipse public licen[sc]e", "epl", ("1.0", "2.0", "")),
    ("cpl", "common public licen[sc]e", "cpl", ("1.0", "")),
    ("ipl", "ibm public licen[sc]e", "ipl", ("1.0", "")),
    ("cddl", "common development and distribution licen[sc]e", "cddl", ("1.0", "1.1", "")),
    ("cpal", "common public attribution licen[sc]e", "cpal", ("1.0", "")),
    ("eupl", "european union public licen[sc]e", "eupl", ("1.0", "1.1", "1.2", "")),
    ("osl", "open software licen[sc]e", "osl", ("1.0", "2.0", "2.1", "3.0", "")),
    ("afl", "academic free licen[sc]e", "afl", ("1.1", "2.0", "2.1", "3.0", "")),
    ("artistic", "artistic licen[sc]e", "artistic", ("1.0", "2.0", "")),
    ("zlib", "zlib(?: libpng)? licen[sc]e", "zlib", ("",)),
    ("bsl", "boost software licen[sc]e", "boost", ("1.0", "")),
    ("unlicense", "(?:the )?unlicense", "unlicense", ("",)),
    ("wtfpl", "do what the fuck you want to public licen[sc]e", "wtfpl", ("2.0", "")),
    ("psf", "python software foundation licen[sc]e", "psf", ("2.0", "")),
    ("php", "php licen[sc]e", "php", ("3.0", "3.01", "")),
    ("openssl", "openssl licen[sc]e", "openssl", ("",)),
    ("postgresql", "postgresql licen[sc]e", "postgresql", ("",)),
    ("ncsa", "university of illinois(?: ncsa)? open source licen[sc]e", "ncsa", ("",)),
    ("ofl", "(?:sil )?open font licen[sc]e", "ofl", ("1.0", "1.1", "")),
    ("odbl", "open database licen[sc]e", "odbl", ("1.0", "")),
    ("odc-by", "open data commons attribution licen[sc]e", "odc by", ("1.0", "")),
    ("pddl", "public domain dedication and licen[sc]e", "pddl", ("1.0", "")),
    ("ms-pl", "microsoft public licen[sc]e", "ms pl", ("",)),
    ("ms-rl", "microsoft reciprocal licen[sc]e", "ms rl", ("",)),
    ("cecill", "cecill(?: free software)? licen[sc]e", "cecill", ("1.0", "2.0", "2.1", "")),
    ("upl", "universal permissive licen[sc]e", "upl", ("1.0", "")),
    ("busl", "business source licen[sc]e", "busl", ("1.1", "")),
    ("sspl", "server side public licen[sc]e", "sspl", ("1.0", "")),
    ("elastic", "elastic licen[sc]e", "elastic", ("2.0", "")),
    ("ruby", "ruby licen[sc]e", "ruby", ("",)),
    ("vim", "vim licen[sc]e", "vim", ("",)),
    ("beerware", "beer ?ware licen[sc]e", "beerware", ("",)),
    ("w3c", "w3c(?: software)?(?: notice and)? licen[sc]e", "w3c", ("",)),
    ("cc0", "(?:creative commons zero|cc0)(?: universal)?(?: licen[sc]e)?", "cc0", ("1.0", "")),
)
#: Parts of Creative Commons names, with the words that say them.
CC_PARTS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
CC_KINDS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0", "")
#: Sentences by which the texts and notices of licences are known, and statements about rights.
SIGNATURES = (
    # Permissive texts.
    ("mit", 2, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 3, "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[sc]e"),
    ("mit", 3, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 3, "(?:distributed|released|available|licen[sc]ed) under (?:the )?(?:terms of (?:the )?)?mit"),
    ("mit-0", 2, "permission is hereby granted free of charge to any person obtaining a copy of this software [a-z ]{1,120}without restriction [a-z ]{1,160}and to permit persons to whom the software is furnished to do so(?= the software is provided)"),
    ("x11", 2, "except as contained in this notice the name of [a-z0-9 ]{1,60} shall not be used in advertising"),
    ("isc", 2, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 2, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", 2, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?= the software is provided)"),
    ("hpnd", 2, "permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee|without fee) is hereby granted"),
    ("hpnd", 3, "that both that copyright notice and this permission notice appear in supporting documentation"),
    ("bsd", 2, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 3, "redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 3, "redistributions in binary form must reproduce the (?:above )?copyright notice this list of conditions"),
    ("bsd-3-clause", 2, "neither the names? of [a-z0-9 ]{1,80} nor the names of (?:its|their|any|the) contributors may be used to endorse or promote"),
    ("bsd-4-clause", 2, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-clear", 2, "no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e"),
    ("bsd-patent", 2, "subject to the terms and conditions of this licen[sc]e each copyright holder and contributor hereby grants to those receiving rights under this licen[sc]e"),
    ("apache-1.1", 2, "the end user documentation included with the redistribution if any must include the following acknowledge?ment"),
    ("apache-1.1", 3, "products derived from this software may not be called apache"),
    ("apache-2.0", 2, "licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e"),
    ("apache-2.0", 2, "you may obtain a copy of the licen[sc]e at (?:https? )?(?:www )?apache org licenses license 2 0"),
    ("apache-2.0", 3, "you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", 3, "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("apache-2.0", 3, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e"),
    ("apache", 3, "apache org licenses(?: license)?"),
    ("zlib", 2, "this software is provided as is without any express or implied warranty in no event will the authors? be held liable"),
    ("zlib", 2, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 3, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib-acknowledgement", 3, "if you use this software in a product an acknowledge?ment in the product documentation is required"),
    ("bsl-1.0", 2, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e"),
    ("bsl-1.0", 3, "machine executable object code generated by a source language processor"),
    ("unlicense", 2, "this is free and unencumbered software released into the public domain"),
    ("unlicense", 3, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", 2, "you just do what the fuck you want to"),
    ("wtfpl", 2, "everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document and changing it is allowed as long as the name is changed"),
    ("beerware", 2, "you can buy me a beer in return"),
    ("beerware", 3, "as long as you retain this notice you can do whatever you want with this stuff"),
    ("psf-2.0", 2, "(?:the )?python software foundation psf and the individual or organization"),
    ("psf", 3, "psf hereby grants licen[sc]ee a nonexclusive royalty free world wide licen[sc]e"),
    ("cnri-python", 2, "cnri hereby grants licen[sc]ee a nonexclusive royalty free world wide licen[sc]e"),
    ("php-3.01", 2, "this product includes php software freely available from"),
    ("php", 3, "products derived from this software may not be called php nor may php appear in their name"),
    ("openssl", 2, "this product includes software developed by the openssl project"),
    ("ssleay", 2, "this product includes cryptographic software written by eric young"),
    ("postgresql", 2, "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("ncsa", 2, "to deal with the software without restriction including without limitation the rights to use"),
    ("w3c", 2, "the full text of this notice in a location viewable to users of the redistributed or derivative work"),
    ("curl", 2, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("icu", 2, "provided that the above copyright notices? and this permission notice appear in all copies of the software and that both"),
    ("unicode", 2, "to deal in the data files or software without restriction"),
    ("libpng", 2, "the png reference library is supplied as is"),
    ("ijg", 2, "this software is based in part on the work of the independent jpeg group"),
    ("freetype", 2, "portions of this software are copyright [a-z0-9 ]{1,30}the freetype project"),
    ("tcl", 2, "the authors hereby grant permission to use copy modify distribute and licen[sc]e this software and its documentation for any purpose"),
    ("vim", 2, "there are no restrictions on distributing unmodified copies of vim"),
    ("ruby", 2, "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("bzip2", 2, "julian seward bzip org"),
    ("afl", 2, "licen[sc]ed under the academic free licen[sc]e version [0-9]"),
    ("artistic-1.0", 2, "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", 2, "this licen[sc]e establishes the terms under which a given free software package may be copied modified distributed"),
    ("ecl-2.0", 2, "educational community licen[sc]e version 2 0"),
    ("upl-1.0", 2, "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("mulan-psl-2.0", 2, "mulan (?:permissive software licen[sc]e|psl)(?: version| v)? ?v?2"),
    ("blueoak-1.0.0", 2, "blue oak model licen[sc]e"),
    # Copyleft texts.
    ("gpl", 2, "is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl", 2, "you should have received a copy of the gnu general public licen[sc]e along with"),
    ("gpl-2.0", 2, "gnu general public licen[sc]e as published by the free software foundation either version 2"),
    ("gpl-3.0", 2, "gnu general public licen[sc]e as published by the free software foundation either version 3"),
    ("gpl-2.0-only", 2, "under the terms of (?:the )?gnu general public licen[sc]e version 2 (?:only|as published)"),
    ("gpl", 3, "the gnu general public licen[sc]e does not permit incorporating your program into proprietary programs"),
    ("gpl", 3, "the licen[sc]es for most software (?:and other practical works )?are designed to take away your freedom to share and change"),
    ("gpl", 3, "gnu org (?:licenses|copyleft) gpl(?: html)?"),
    ("gpl-3.0", 3, "the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works"),
    ("gpl-classpath-exception", 2, "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-font-exception", 2, "if you create a document which uses this font and embed this font"),
    ("gpl-bison-exception", 2, "you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-runtime-exception", 2, "gcc runtime library exception"),
    ("gpl-linking-exception", 3, "as a special exception [a-z0-9 ]{1,80}permission to link"),
    ("lgpl", 2, "is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("lgpl", 2, "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with"),
    ("lgpl-2.1", 2, "gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1"),
    ("lgpl-3.0", 2, "gnu lesser general public licen[sc]e as published by the free software foundation either version 3"),
    ("lgpl", 3, "gnu org licenses lgpl(?: html)?"),
    ("agpl", 2, "under the terms of the gnu affero general public licen[sc]e"),
    ("agpl-3.0", 2, "gnu affero general public licen[sc]e as published by the free software foundation either version 3"),
    ("agpl", 3, "remote network interaction use with the gnu general public licen[sc]e"),
    ("gfdl", 2, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("gfdl-no-invariants", 3, "with no invariant sections no front cover texts and no back cover texts"),
    ("gnu-all-permissive", 2, "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("fsf-unlimited", 3, "this file is free software the free software foundation gives unlimited permission to copy and or distribute it"),
    ("mpl-1.1", 2, "the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("mpl-2.0", 2, "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("mpl-2.0", 3, "mozilla org mpl 2 0"),
    ("mpl", 3, "mozilla org mpl"),
    ("npl-1.1", 2, "the contents of this file are subject to the netscape public licen[sc]e"),
    ("epl-1.0", 2, "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0"),
    ("epl-2.0", 2, "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e 2 0"),
    ("epl", 3, "eclipse org legal epl(?: v10| 2 0)?"),
    ("edl-1.0", 2, "eclipse distribution licen[sc]e v ?1 0"),
    ("cddl", 2, "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("cddl-gpl", 2, "either the gnu general public licen[sc]e version 2 only gpl or the common development and distribution licen[sc]e"),
    ("cpl-1.0", 2, "made available under the terms of the common public licen[sc]e v1 0"),
    ("eupl", 2, "licen[sc]ed under the eupl"),
    ("osl", 2, "licen[sc]ed under the open software licen[sc]e version [0-9]"),
    ("cecill", 2, "this software is governed by the cecill"),
    ("cecill", 3, "abiding by the rules of distribution of free software you can use modify and or redistribute the software"),
    ("sleepycat", 2, "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("qpl-1.0", 2, "q public licen[sc]e"),
    ("apsl-2.0", 2, "apple public source licen[sc]e"),
    ("rpl-1.5", 2, "reciprocal public licen[sc]e"),
    ("sspl-1.0", 2, "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("parity-7.0.0", 2, "parity public licen[sc]e"),
    # Data, fonts and works.
    ("ofl-1.1", 2, "this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1"),
    ("ofl", 3, "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("bitstream-vera", 2, "bitstream vera is a trademark of bitstream"),
    ("ubuntu-font", 2, "ubuntu font licen[sc]e"),
    ("odbl-1.0", 2, "made available under the open database licen[sc]e"),
    ("odbl", 3, "opendatacommons org licenses odbl"),
    ("odc-by", 3, "opendatacommons org licenses by"),
    ("pddl", 3, "opendatacommons org licenses pddl"),
    ("cdla-permissive", 2, "community data licen[sc]e agreement permissive"),
    ("cdla-sharing", 2, "community data licen[sc]e agreement sharing"),
    ("ogl-uk", 2, "contains public sector information licen[sc]ed under the open government licen[sc]e"),
    ("ogl-uk", 3, "open government licen[sc]e"),
    ("etalab", 2, "licen[sc]e ouverte(?: open licen[sc]e)?"),
    ("dl-de-by-2.0", 2, "datenlizenz deutschland namensnennung"),
    ("cc0-1.0", 2, "to the extent possible under law [a-z0-9 ]{1,80}(?:has|have) waived all copyright and related or neighboring rights"),
    ("cc0-1.0", 3, "creativecommons org publicdomain zero 1 0"),
    ("public-domain-mark", 3, "creativecommons org publicdomain mark"),
    ("cc", 3, "this work is licen[sc]ed under a creative commons"),
    ("cc", 4, "some rights reserved"),
    ("free-art-1.3", 2, "free art licen[sc]e"),
    ("free-art-1.3", 2, "licence art libre"),
    ("us-government", 3, "work of the (?:united states|u s) government"),
    # Source available and proprietary.
    ("busl-1.1", 2, "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licen[sc]ed work"),
    ("elastic-2.0", 2, "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 2, "commons clause licen[sc]e condition"),
    ("commons-clause", 2, "the grant of rights under the licen[sc]e will not include and the licen[sc]e does not grant to you the right to sell"),
    ("polyform", 2, "polyform (?:noncommercial|shield|strict|small business|internal use|perimeter|free trial) licen[sc]e"),
    ("prosperity", 2, "prosperity public licen[sc]e"),
    ("fair-source", 3, "fair source licen[sc]e"),
    ("functional-source", 2, "functional source licen[sc]e"),
    ("json", 2, "the software shall be used for good not evil"),
    ("openrail", 2, "responsible ai licen[sc]e"),
    ("openrail", 3, "openrail"),
    ("llama-community", 2, "llama [0-9 ]{0,4}community licen[sc]e"),
    ("non-commercial", 3, "non ?commercial (?:use|purposes) only"),
    ("non-commercial", 3, "for personal (?:use|purposes) only"),
    ("non-commercial", 3, "academic (?:use|purposes) only"),
    ("non-commercial", 3, "research (?:use|purposes) only"),
    ("no-commercial-use", 3, "(?:may|must) not be used for commercial purposes"),
    ("evaluation", 3, "for evaluation purposes only"),
    ("eula", 3, "end user licen[sc]e agreement"),
    ("proprietary", 3, "proprietary (?:software|and confidential|licen[sc]e|information)"),
    ("proprietary", 3, "confidential (?:and|or) proprietary"),
    ("proprietary", 3, "this software is the (?:confidential and proprietary information|property) of"),
    ("proprietary", 3, "unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)"),
    ("proprietary", 3, "no part of this (?:publication|document|work|book|site) may be (?:reproduced|copied|used)"),
    ("proprietary", 3, "(?:reproduction|redistribution|copying) (?:is )?(?:strictly )?prohibited"),
    ("no-redistribution", 3, "(?:may|must) not (?:be )?(?:copied(?: or)? )?redistributed?"),
    ("trade-secret", 3, "(?:contains|constitutes?) trade secrets? of"),
    ("patent-pending", 4, "patents? pending"),
    ("trademark", 4, "(?:is a|are) (?:registered )?trademarks? of"),
    # Notices.
    ("copyright", 4, "copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*"),
    ("reserved", 4, "(?:all|no) rights(?: are)? reserved"),
    ("public-domain", 3, "(?:placed in|released into|dedicated to|in) the public domain"),
    ("public-domain", 4, "public domain"),
    ("copyleft", 4, "copyleft"),
    ("osi-approved", 3, "opensource org licenses [a-z0-9 ]{2,20}"),
    ("spdx", 4, "spdx license identifier [a-z0-9]+"),
    ("dual-licence", 3, "dual licen[sc]ed(?: under)?"),
    ("licensed", 4, "(?:re)?licen[sc]ed under(?: the)?(?: terms of)?(?: the)? [a-z0-9]+"),
    ("licence-file", 4, "see the (?:accompanying )?licen[sc]e(?: txt| md)? file"),
    ("licence-terms", 4, "subject to the terms (?:and conditions )?of th(?:e|is) licen[sc]e"),
    ("free-licence", 4, "free software licen[sc]e"),
    ("no-warranty", 4, "(?:without|no) warrant(?:y|ies)(?: of any kind)?"),
    ("as-is", 4, "provided as is without (?:any )?warranty"),
    ("no-liability", 4, "in no event shall the (?:authors?|copyright holders?|regents|contributors)"),
    ("merchantability", 4, "(?:implied )?warrant(?:y|ies) of merchantability"),
)


def literals(pattern: str) -> list[str]:
    """The literals outside groups, all of which every match of a pattern holds; no pattern has a bar outside groups."""
    plain, depth, k = [""], 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "(":
            depth += 1
            plain.append("")
        elif c == ")":
            depth -= 1
            plain.append("")
        elif c == "[":
            k = pattern.index("]", k)
            plain.append("")
        elif c in "?*+":
            if plain[-1]:
                plain[-1] = plain[-1][:-1]
            plain.append("")
        elif c == "{":
            k = pattern.index("}", k)
            plain.append("")
        elif not depth:
            plain[-1] += c
        k += 1
    return plain


def keyword(pattern: str) -> str:
    """The longest literal that every match of a pattern holds, though "under" and "licence" only if there is no other; else ""."""
    return max(literals(pattern), key=lambda x: (x.strip() not in ("under", "licen", "e"), len(x)))


def _version(v: str) -> str:
    """1.0 as "version 1 0", "v1 0", "1" and the like."""
    major, _, minor = v.partition(".")
    return f"(?: version| v)? ?v?{major}" + (f"(?: {minor})?" if minor == "0" else f" {minor}")


def rules() -> list[Rule]:
    """All rules, best priority first: for each name and version a tag, the full name and the short name."""
    out = []
    for stem, full, short, versions in FAMILIES:
        for v in versions:
            label = f"{stem}-{v}" if v else stem
            tail = _version(v) if v else ""
            tag = stem.replace("-", " ") + (" " + v.replace(".", " ") if v else "")
            out.append((label, 1, f"spdx license identifier {tag}(?: only| or later)?"))
            out.append((label, 2, full + tail + ("(?: or later)?" if v else "")))
            out.append((label, 3, f"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?{short}{tail}"))
    for kind in CC_KINDS:
        parts = kind.split("-")
        for v in CC_VERSIONS:
            label, tail = f"cc-{kind}" + (f"-{v}" if v else ""), _version(v) if v else ""
            short = " ".join(parts)
            out.append((label, 1, f"cc {short}{tail}"))
            out.append((label, 2, "creative commons " + " ".join(CC_PARTS[p] for p in parts) + f"(?: licen[sc]e)?(?: international| unported)?{tail}"))
            out.append((label, 2, f"creativecommons org licenses {short}" + (f" {v.replace('.', ' ')}" if v else "")))
    out += SIGNATURES
    return sorted((Rule(label, priority, keyword(pattern), pattern) for label, priority, pattern in out), key=lambda r: r.priority)


def _as_words(text):
    """Words with one space between them and around them; A-Z stay."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, BETWEEN, " ")), F.lit(" "))


def _n_words(spaced):
    """Of spaced words: their spaces but one."""
    return (F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit(""))) - 1).cast("long")


def _lowered(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def gate() -> tuple[str, ...]:
    """Every match of a rule or phrase holds one of these."""
    own = {p: [p] for p in PHRASES} | {r.pattern: literals(r.pattern) for r in rules()}
    # Names of BSD and CC0 licences are groups of alternatives; each has a word of GATE.
    short = {p for p in own if p.startswith(("(?:zero clause bsd", "(?:simplified bsd", "(?:new bsd", "(?:original bsd", "(?:creative commons zero"))}
    return GATE + tuple(sorted({max(own[p], key=len) for p in own.keys() - short if not any(g in x for g in GATE for x in own[p])}))


def _words(docs: DataFrame) -> DataFrame:
    """doc_id, th, w (spaced words, as they are), u (lower-cased where the gate opens, else null)."""
    t = text_of()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), _as_words(t).alias("w"))
    opened = F.lit(False)
    for g in gate():
        opened = opened | F.contains(F.col("low"), F.lit(g))
    return d.withColumn("low", F.lower("w")).select("doc_id", "th", "w", F.when(opened, _lowered(F.col("w"))).alias("u"))


def detections(docs: DataFrame) -> DataFrame:
    """doc_id, th, label, priority, start, end (in characters of the spaced words), suppressed, of every match."""
    return _detections(_words(docs).select("doc_id", "th", "u"))


def _detections(d: DataFrame) -> DataFrame:
    table = F.array(*(F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.keyword).alias("keyword"), F.lit(f" (?:{r.pattern})(?= )").alias("pattern")) for r in rules()))
    # Outer generators: before others Spark puts a filter that would work out their whole input once more.
    d = d.select("*", F.explode_outer(F.filter(table, lambda r: F.contains(F.col("u"), r["keyword"]))).alias("r")).where("r is not null")
    d = d.select("doc_id", "th", "r.label", "r.priority", "u", F.col("r.pattern").alias("p"), F.regexp_extract_all("u", F.col("r.pattern"), F.lit(0)).alias("hits"))
    d = d.withColumn("gaps", F.when(F.size("hits") > 0, F.split("u", F.col("p"), -1)))
    sizes = F.arrays_zip(F.transform("gaps", lambda g: F.char_length(g)).alias("g"), F.transform("hits", lambda h: F.char_length(h)).alias("h"))
    d = d.select("doc_id", "th", "label", "priority", "p", F.posexplode_outer(sizes).alias("k", "x")).where("x.h is not null")
    d = d.select("doc_id", "th", "label", "priority", "p", "k", "x.g", "x.h").distinct()  # repeated rows count once
    upto = W.partitionBy("doc_id", "th", "p").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("g") + F.col("h")).over(upto)
    d = d.select("doc_id", "th", "label", "priority", end.alias("end"), (end - F.col("h")).alias("start"))
    earlier = W.partitionBy("doc_id", "th").orderBy("start", F.col("end").desc(), "priority", "label").rowsBetween(W.unboundedPreceding, -1)
    inside = F.lit(False)
    for p in CONFIDENCE:
        inside = inside | ((F.col("priority") >= p) & F.coalesce(F.max(F.when(F.col("priority") == p, F.col("end"))).over(earlier) >= F.col("end"), F.lit(False)))
    return d.withColumn("suppressed", inside)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; a row for each row of docs."""
    d = _words(docs).withColumn("hits", F.when(F.col("u").isNotNull(), F.regexp_extract_all("u", F.lit(_PHRASE), F.lit(0))))
    d = d.withColumn("gaps", F.when(F.size("hits") > 0, F.split("u", _PHRASE, -1)))
    n = F.when(F.col("w") == "  ", F.lit(0)).otherwise(_n_words(F.col("w"))).cast("long")
    tail = F.size(F.split(F.element_at("hits", -1), " ")) - 1 + _n_words(F.element_at("gaps", -1))
    named = [F.when(F.array_contains("hits", " " + p), F.lit(label)) for p, label in PHRASES.items()]
    # The texts are read once: what passed the gate is written, and detections start from there.
    base = d.select(
        "doc_id",
        "th",
        "u",
        n.alias("n_words"),
        F.coalesce(F.when(F.size("hits") > 0, F.size("hits")), F.lit(0)).cast("long").alias("n_base"),
        F.when(F.size("hits") > 0, _n_words(F.element_at("gaps", 1)) + 1).cast("long").alias("first_word"),
        F.when(F.size("hits") > 0, n - tail).cast("long").alias("last_word"),
        F.when(F.size("hits") > 0, F.array_sort(F.array_distinct(F.array_compact(F.array(*named))))).otherwise(F.array().cast("array<string>")).alias("base"),
    )
    base = written(base, "words")
    confidence = F.coalesce(*(F.when(F.col("priority") == p, F.lit(c)) for p, c in CONFIDENCE.items()))
    found = _detections(base.where("u is not null").select("doc_id", "th", "u")).where("not suppressed").groupBy(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th")).agg(F.collect_set("label").alias("found"), F.max(confidence).alias("best"))
    both = base.join(found, base["doc_id"].eqNullSafe(found["f_id"]) & (base["th"] == found["f_th"]), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, PHRASE_SCORE).otherwise(0.0))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
