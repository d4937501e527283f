"""Operator 6: license scans by ordered signature rules.  DataFrame functions only.

A rule is a keyword, a regular expression over the text with A-Z in lower case, a
label, a priority and a weight.  A text is held only against the rules whose keyword
it contains.  Each match is a detection with its interval; one that lies within the
interval of a detection of higher priority, or within a longer one of the same
priority, is suppressed, and of equal intervals the first rule's stays.

Rules are of five forms, from the identifier tag (most specific) down to the bare name.
Sentences of license texts, notices and exhibits are written by hand one by one
(``SENTENCES``); where licenses share their sentences, a rule requires several, and the
longer text hides the shorter ones within it; the other four forms follow from license families (``FAMILIES``: label,
name, versions, address, also written by hand).  The four base phrases are found apart from the rules, as consecutive
words, and always stay.

Matches of one rule are placed by splitting the text at them and summing lengths in a
window, and containment is decided by running maxima of interval ends, one for each
priority, so the work grows with the number of detections, not with its square.

Defined results: null or empty text has no words, no labels and score 0; repeated
rows have the same result; other columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.decontaminate import lowered, words_of

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# License families (label, name, versions, address).
FAMILIES = [
    ("agpl", r"(?:gnu )?affero general public license|agpl", "3.0", r"gnu\.org/licenses/agpl"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public license|lgpl", "2.0 2.1 3.0", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("gpl", r"(?:gnu )?general public license|gnu gpl|gpl", "1.0 2.0 3.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("gfdl", r"(?:gnu )?free documentation license|gfdl", "1.1 1.2 1.3", r"gnu\.org/licenses/(?:old-licenses/)?fdl"),
    ("apache", r"apache(?: software)? license|apache public license", "1.0 1.1 2.0", r"apache\.org/licenses"),
    ("mit", r"mit license|expat license|mit/x11 license", "", r"opensource\.org/licenses?/mit"),
    ("bsd-2-clause", r"(?:bsd 2-clause|2-clause bsd|simplified bsd|freebsd) license", "", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", r"(?:bsd 3-clause|3-clause bsd|new bsd|modified bsd|revised bsd) license", "", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", r"(?:bsd 4-clause|4-clause bsd|original bsd) license", "", r"spdx\.org/licenses/bsd-4-clause"),
    ("0bsd", r"(?:zero-clause bsd|0-clause bsd|free public) license", "", r"opensource\.org/licenses?/0bsd"),
    ("isc", r"isc license", "", r"opensource\.org/licenses?/isc"),
    ("mpl", r"mozilla public license|mpl", "1.0 1.1 2.0", r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl", r"eclipse public license|epl", "1.0 2.0", r"eclipse\.org/(?:legal/|org/documents/)epl"),
    ("edl", r"eclipse distribution license", "1.0", r"eclipse\.org/org/documents/edl"),
    ("cddl", r"common development and distribution license|cddl", "1.0 1.1", r"opensource\.org/licenses?/cddl"),
    ("cpl", r"common public license", "1.0", r"opensource\.org/licenses?/cpl"),
    ("cecill", r"cecill(?:-[bc])? license|cecill", "1.0 2.0 2.1", r"cecill\.info"),
    ("eupl", r"european union public licen[cs]e|eupl", "1.1 1.2", r"joinup\.ec\.europa\.eu/.{0,40}eupl"),
    ("artistic", r"(?:perl )?artistic license", "1.0 2.0", r"opensource\.org/licenses?/artistic"),
    ("bsl", r"boost software license", "1.0", r"boost\.org/license"),
    ("zlib", r"zlib(?:/libpng)? license", "", r"zlib\.net/zlib_license"),
    ("libpng", r"libpng license", "2.0", r"libpng\.org/pub/png/src/libpng-license"),
    ("unlicense", r"the unlicense|unlicense license", "", r"unlicense\.org"),
    ("wtfpl", r"do what the f[u*]ck you want to public license|wtfpl license", "", r"wtfpl\.net"),
    ("cc0", r"cc0 license|creative commons zero|cc0 public domain", "1.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-nc-nd", r"cc[ -]by-nc-nd|creative commons attribution-noncommercial-noderivatives", "2.0 2.5 3.0 4.0", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", r"cc[ -]by-nc-sa|creative commons attribution-noncommercial-sharealike", "2.0 2.5 3.0 4.0", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc", r"cc[ -]by-nc|creative commons attribution-noncommercial", "2.0 2.5 3.0 4.0", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", r"cc[ -]by-nd|creative commons attribution-noderivatives", "2.0 2.5 3.0 4.0", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-sa", r"cc[ -]by-sa|creative commons attribution-sharealike", "2.0 2.5 3.0 4.0", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by", r"cc[ -]by|creative commons attribution", "2.0 2.5 3.0 4.0", r"creativecommons\.org/licenses/by/"),
    ("odbl", r"open (?:data commons )?database license|odbl", "1.0", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", r"open data commons attribution license", "1.0", r"opendatacommons\.org/licenses/by"),
    ("pddl", r"public domain dedication and license", "1.0", r"opendatacommons\.org/licenses/pddl"),
    ("ofl", r"(?:sil )?open font license|ofl", "1.0 1.1", r"scripts\.sil\.org/ofl"),
    ("psf", r"python software foundation license|psf license", "2.0", r"python\.org/psf/license"),
    ("php", r"php license", "3.0 3.01", r"php\.net/license"),
    ("ruby", r"ruby license", "", r"ruby-lang\.org/.{0,20}license"),
    ("openssl", r"openssl license", "", r"openssl\.org/source/license"),
    ("postgresql", r"postgresql license", "", r"postgresql\.org/about/licen"),
    ("ms-pl", r"microsoft public license|ms-pl", "", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", r"microsoft reciprocal license|ms-rl", "", r"opensource\.org/licenses?/ms-rl"),
    ("ncsa", r"(?:university of illinois/)?ncsa open source license", "", r"opensource\.org/licenses?/ncsa"),
    ("upl", r"universal permissive license", "1.0", r"oss\.oracle\.com/licenses/upl"),
    ("w3c", r"w3c (?:software|document) (?:notice and )?license", "", r"w3\.org/consortium/legal"),
    ("vim", r"vim license", "", r"vimdoc\.sourceforge\.net"),
    ("sspl", r"server side public license", "1.0", r"mongodb\.com/licensing/server-side"),
    ("busl", r"business source license", "1.1", r"mariadb\.com/bsl11"),
    ("elastic", r"elastic license", "2.0", r"elastic\.co/licensing/elastic-license"),
    ("proprietary", r"all rights reserved|proprietary and confidential", "", ""),
]
#: How a text of the BSD family begins; which of them it is, its later clauses say.
_BSD = r"redistribution and use in source and binary forms, with or without\s+modification"
# Sentences of license texts, notices and exhibits that identify a license by themselves (label, keyword, pattern).
SENTENCES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", "copyright notice", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all\s+copies"),
    ("mit-modern", "permission is hereby granted", r"permission is hereby granted, without written agreement and without\s+license or royalty fees"),
    ("x11", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person(?s:.{1,1600}?)except as contained in this notice, the names? of (?:the )?(?:above )?(?:copyright holders?|x consortium) shall not be used"),
    ("ncsa", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person(?s:.{1,900}?)redistributions of source code must retain(?s:.{1,900}?)endorse or promote"),
    ("isc", "permission to use, copy", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any\s+purpose with or without\s+fee"),
    ("hpnd", "permission to use, copy", r"permission to use, copy, modify,? and distribute this software and its\s+documentation for any purpose"),
    ("ntp", "permission to use, copy", r"permission to use, copy, modify,? and distribute this software and its\s+documentation for any purpose with or without\s+fee"),
    ("bsd-4-clause", "advertising materials", rf"{_BSD}(?s:.{{1,1200}}?)all advertising materials mentioning features or use(?s:.{{1,700}}?)endorse or promote"),
    ("bsd-3-clause", "endorse or promote", rf"{_BSD}(?s:.{{1,1600}}?)names?(?s:.{{1,200}}?)endorse or promote"),
    ("bsd-2-clause", "redistributions", rf"{_BSD}(?s:.{{1,700}}?)redistributions in binary form must reproduce the above copyright\s+notice"),
    ("bsd-source-code", "redistributions", rf"{_BSD}(?s:.{{1,400}}?)redistributions of source code must retain the above copyright\s+notice"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of .{1,80}? nor the names of (?:its|their)\s+contributors may be used to endorse or promote"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software\s+must display"),
    ("0bsd", "permission to use, copy", r"permission to use, copy, modify,? and/or distribute this software for any\s+purpose with or without fee is hereby granted\.\s+the software is provided \"as is\""),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "recognize copyright laws", r"in jurisdictions that recognize copyright laws, the author or authors\s+of this software dedicate"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|donated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", r"this (?:file|work|code|software|document) is (?:hereby )?in the public domain"),
    ("cc0", "copyright", r"to the extent possible under law, .{1,120}? waived all copyright and related"),
    ("cc0", "affirmer", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives"),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty"),
    ("zlib", "of this software must not", r"the origin of this software must not be misrepresented; you must not\s+claim"),
    ("libpng", "contributing authors", r"the contributing authors and group 42, inc\. disclaim all warranties"),
    ("apache-2.0", "licensed under the apache", r"licensed under the apache license, version 2\.0 \(the \"license\"\)"),
    ("apache-2.0", "compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "without warranties", r"distributed on an \"as is\" basis,\s+without warranties or conditions of any kind"),
    ("apache-2.0", "perpetual, worldwide", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge"),
    ("apache-1.1", "software developed by", r"this product includes software developed by the\s+apache software foundation"),
    ("apache-1.0", "software developed by", r"this product includes software developed by the\s+apache group for use in the apache http server project"),
    ("gpl", "free software foundation", r"gnu general public license as published by\s+the free software foundation"),
    ("gpl-2.0-or-later", "free software foundation", r"free software foundation; either version 2 of the license, or\s+\(at your option\) any later version"),
    ("gpl-3.0-or-later", "free software foundation", r"free software foundation,? either version 3 of the license, or\s+\(at your option\) any later version"),
    ("gpl-2.0-only", "free software foundation", r"under the terms of (?:version 2 of the gnu general public license|the gnu general public license version 2)(?: only)?,? as published by\s+the free software foundation"),
    ("gpl", "everyone is permitted", r"everyone is permitted to copy and distribute verbatim copies\s+of this license document, but changing it is not allowed"),
    ("gpl", "licenses for most software", r"the licenses for most software(?: and other practical works)? are designed to take away your\s+freedom"),
    ("gpl-3.0", "copyleft license for", r"the gnu general public license is a free, copyleft license for\s+software and other kinds of works"),
    ("gpl", "without even the implied", r"without even the implied warranty of\s+merchantability or fitness for a particular purpose\.\s+see the\s+gnu general public license"),
    ("gpl-classpath", "special exception", r"as a special exception, the copyright holders of this library give you\s+permission to link this library"),
    ("gpl-font", "special exception", r"as a special exception, if you create a document which uses this font"),
    ("gpl-autoconf", "special exception", r"as a special exception to the gnu general public license, if you\s+distribute this file as part of a program that contains a\s+configuration script"),
    ("lgpl-2.1-or-later", "free software foundation", r"gnu lesser general public license as published by\s+the free software foundation; either\s+version 2\.1 of the license, or"),
    ("lgpl-2.0-or-later", "free software foundation", r"gnu library general public license as published by\s+the free software foundation; either\s+version 2 of the license, or"),
    ("lgpl", "without even the implied", r"without even the implied warranty of\s+merchantability or fitness for a particular purpose\.\s+see the\s+gnu (?:lesser|library) general public license"),
    ("lgpl-3.0", "general public license", r"this version of the gnu lesser general public license incorporates\s+the terms and conditions of version 3"),
    ("agpl-3.0-or-later", "free software foundation", r"gnu affero general public license as\s+published by the free software foundation,? either version 3"),
    ("agpl-3.0", "interacting with it remotely", r"all users\s+interacting with it remotely through a computer network"),
    ("gfdl", "permission is granted to copy", r"permission is granted to copy, distribute and/or modify this document\s+under the terms of the gnu free documentation license"),
    ("gfdl", "invariant sections", r"with no invariant sections, no front-cover texts,? and no back-cover\s+texts"),
    ("fsf-all-permissive", "copying and distribution", r"copying and distribution of this file, with or without modification,\s+are permitted in any medium"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public\s+license, v\. ?2\.0"),
    ("mpl-2.0", "secondary licenses", r"this source code form is \"incompatible with secondary licenses\""),
    ("mpl-1.1", "public license", r"the contents of this file are subject to the mozilla public license\s+version 1\.1"),
    ("mpl-1.0", "public license", r"the contents of this file are subject to the mozilla public license\s+version 1\.0"),
    ("npl", "public license", r"the contents of this file are subject to the netscape public license"),
    ("cddl-1.0", "distribution license", r"the contents of this file are subject to the terms of the\s+common development and distribution license"),
    ("epl-1.0", "accompanying materials", r"accompanying materials\s+are made available under the terms of the eclipse public license v1\.0"),
    ("epl-2.0", "accompanying materials", r"accompanying materials\s+are made available under the\s+terms of the eclipse public license (?:v\. ?)?2\.0"),
    ("cpl-1.0", "common public license", r"the accompanying program is provided under the terms of this common public\s+license"),
    ("ipl", "ibm public license", r"the accompanying program is provided under the terms of this ibm public\s+license"),
    ("osl-3.0", "open software license", r"licensed under the open software license version 3\.0"),
    ("afl-3.0", "academic free license", r"licensed under the academic free license version 3\.0"),
    ("eupl-1.2", "eupl", r"licensed under the eupl(?:,? version 1\.2)? (?:only |or - as soon )"),
    ("artistic-1.0", "copied", r"the intent of this document is to state the conditions under which a\s+package may be copied"),
    ("artistic-2.0", "free software", r"this license establishes the terms under which a given free software\s+package may be copied"),
    ("perl", "same terms as perl", r"(?:redistribute it and/or\s+modify it )?under the same terms as perl itself"),
    ("bsl-1.0", "boost software license", r"distributed under the boost software license, version 1\.0"),
    ("bsl-1.0", "machine-executable", r"machine-executable object code generated by\s+a source language processor"),
    ("ofl-1.1", "font software", r"this font software is licensed under the sil open font license, version 1\.1"),
    ("ofl", "font software", r"the font software,? (?:may be )?(?:used, studied, modified|including any derivative works)"),
    ("python-2.0", "licensee", r"the psf is making python available to licensee on an \"as is\"\s+basis"),
    ("php-3.01", "php license", r"this source file is subject to version 3\.01 of the php license"),
    ("php-3.0", "php license", r"this source file is subject to version 3\.0 of the php license"),
    ("openssl", "software developed by", r"this product includes software developed by the openssl project"),
    ("ssleay", "software written by", r"this product includes cryptographic software written by\s+eric young"),
    ("postgresql", "permission to use, copy", r"permission to use, copy, modify,? and distribute this software and its\s+documentation for any purpose, without fee, and without a written agreement"),
    ("curl", "copyright", r"copyright (?:\(c\) )?(?:[0-9]{4} ?- ?[0-9]{4}, )?daniel stenberg"),
    ("tcl", "copyrighted by the regents", r"copyrighted by the regents of the university of california, sun\s+microsystems"),
    ("icu", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy of the unicode data files"),
    ("w3c", "this software and its", r"distribute this software and its documentation, with or without\s+modification, for any purpose and without fee"),
    ("ms-pl", "accompanying software", r"this license governs use of the accompanying software\. if you use the software, you\s+accept this license"),
    ("wtfpl", "what the", r"you just do what the f[u*]ck you want to"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("json", "the software shall be used", r"the software shall be used for good, not evil"),
    ("vim", "uganda", r"vim is charityware|help poor children in uganda"),
    ("cc-by", "creative commons", r"this work is licensed under a creative commons attribution [0-9.]+ (?:international|unported|generic)"),
    ("cc-by-sa", "creative commons", r"this work is licensed under a creative commons attribution-sharealike [0-9.]+ (?:international|unported|generic)"),
    ("cc-by-nc", "creative commons", r"this work is licensed under a creative commons attribution-noncommercial [0-9.]+ (?:international|unported|generic)"),
    ("cc-by-nc-sa", "creative commons", r"this work is licensed under a creative commons attribution-noncommercial-sharealike [0-9.]+"),
    ("cc-by-nc-nd", "creative commons", r"this work is licensed under a creative commons attribution-noncommercial-noderiv(?:ative)?s [0-9.]+"),
    ("cc-by-nd", "creative commons", r"this work is licensed under a creative commons attribution-noderiv(?:ative)?s [0-9.]+"),
    ("odbl-1.0", "open database license", r"made available under the open database license"),
    ("odc-by-1.0", "open data commons", r"made available under the open data commons attribution license"),
    ("pddl-1.0", "public domain", r"made available under the public domain dedication and license"),
    ("busl-1.1", "change license", r"change date:.{0,40}?\s+change license:"),
    ("sspl-1.0", "third parties as a service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed\s+service"),
    ("commons-clause", "sell the software", r"the license does not grant to you, the right to sell the software"),
    ("polyform-noncommercial", "noncommercial", r"any noncommercial purpose is a permitted purpose"),
    ("llama", "community license", r"llama [0-9.]+ is licensed under the llama [0-9.]+ community license"),
    ("openrail", "use-based restrictions", r"use-based restrictions (?:as )?referenced in paragraph 5"),
    ("proprietary", "proprietary", r"this software is (?:the )?(?:confidential and )?proprietary (?:information|property) of"),
    ("proprietary", "may be reproduced", r"no part of this (?:publication|document|work|book) may be reproduced"),
    ("proprietary", "without the express", r"may not be (?:copied|reproduced|distributed)[^.]{0,60} without the express(?:ed)? (?:prior )?written"),
    ("shareware", "shareware", r"this (?:program|software) is shareware|if you continue to use it (?:after|beyond) [0-9]+ days"),
    ("freeware", "freeware", r"this (?:program|software) is freeware"),
    ("evaluation", "evaluation", r"for (?:evaluation|trial) purposes only"),
]
#: Parts that several keywords share.
STEMS = ["software", "commons", "public", "permi", "copy", "without", "free", "serv", "material", "cc"]
#: Priorities of the five forms, and their weights.
TAG, SENTENCE, ADDRESS, VERSIONED, NAMED = 5, 4, 3, 2, 1
WEIGHTS = {TAG: 1.0, SENTENCE: 0.95, ADDRESS: 0.9, VERSIONED: 0.85, NAMED: 0.7}
BASE_WEIGHT = 0.6
_EDGE = r"(?<![0-9a-z\x{80}-\x{10FFFF}])", r"(?![0-9a-z\x{80}-\x{10FFFF}])"
_GAP = r"(?:,? v?\.? ?|,? version |,? ver\.? |[ -]v?)"


def _spaced(name: str) -> str:
    return name.replace(" ", r"[\s_-]{1,4}")


def _alternatives(name: str) -> list[str]:
    """The name's outermost alternatives, ``[ -]`` spelled out."""
    depth, parts = 0, [""]
    for c in name:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return [x for p in parts for x in ([p.replace("[ -]", " ", 1), p.replace("[ -]", "-", 1)] if "[ -]" in p else [p])]


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """(rule, label, keyword, pattern, priority, weight), most specific first."""
    made = [(label, word, pattern, SENTENCE) for label, word, pattern in SENTENCES]
    for label, name, versions, address in FAMILIES:
        named = [("licen" if "licen" in x else x, f"{_EDGE[0]}(?:{_spaced(x) if 'licen' in x else x})") for x in _alternatives(name)]
        for v in versions.split():
            number = v.replace(".0", r"(?:\.0)?") if v.endswith(".0") else v.replace(".", r"\.")
            made.append((f"{label}-{v}", "spdx-license", rf"spdx-license-identifier:\s*{label}-{v.replace('.', '[.]')}(?:-only|-or-later|\+)?", TAG))
            made += [(f"{label}-{v}", word, rf"{spelled}{_GAP}{number}(?![0-9])", VERSIONED) for word, spelled in named]
        made.append((label, "spdx-license", rf"spdx-license-identifier:\s*{label}(?![0-9a-z.-])", TAG))
        if address:
            made.append((label, "://", rf"https?://(?:www\.)?{address}", ADDRESS))
        made += [(label, word, f"{spelled}{_EDGE[1]}", NAMED) for word, spelled in named]
    order = sorted(made, key=lambda r: -r[3])
    return [(k, label, word, pattern, priority, WEIGHTS[priority]) for k, (label, word, pattern, priority) in enumerate(order)]


def keywords(text: Column) -> Column:
    """The rules' keywords that a lower-cased text contains.

    A keyword that holds another one, or a stem of ``STEMS``, is looked for only where that has been found.
    """
    wanted = sorted({r[2] for r in rules()})
    every = sorted({*wanted, *STEMS})
    above = {w: max((x for x in every if x != w and x in w), key=lambda x: (len(x), x), default=None) for w in every}

    def found(w: str) -> Column:
        below = [found(x) for x in every if above[x] == w]
        own = [F.array(F.lit(w))] if w in wanted else []
        return F.when(text.contains(w), F.concat(*own, *below) if own or below else F.array().cast("array<string>")).otherwise(F.array().cast("array<string>"))

    return F.concat(*(found(w) for w in every if above[w] is None))


def _phrase(phrase: str) -> str:
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"{_EDGE[0]}{gap.join(phrase.split())}{_EDGE[1]}"


def _base(text: Column) -> dict[str, Column]:
    """Columns of the base phrases in a lower-cased text."""
    any_phrase = "|".join(map(_phrase, BASE))
    near = text.contains("license") | text.contains("cc")
    gated = F.when(near, text).otherwise(F.lit(""))
    count = F.regexp_count(gated, F.lit(any_phrase))
    first = F.size(words_of(F.split(gated, any_phrase, 2)[0]))
    last = F.size(words_of(F.regexp_extract(gated, f"(?s)^(.*)(?:{any_phrase})", 1)))
    found = F.array_compact(F.array(*(F.when(gated.rlike(_phrase(p)), F.lit(label)) for p, label in BASE.items())))
    return {"n_base": count, "first_word": F.when(count > 0, first), "last_word": F.when(count > 0, last), "base": found}


def detections(texts: DataFrame) -> DataFrame:
    """(k, rule, label, start, end, priority, weight) that stay, of distinct texts (k, t, words); t is lower-cased."""
    held = texts.sparkSession.createDataFrame(rules(), "rule int, label string, keyword string, pattern string, priority int, weight double")
    rows = texts.select("k", "t", F.explode("words").alias("keyword")).join(F.broadcast(held), "keyword")  # a constant table
    matched = F.regexp_extract_all(F.col("t"), F.col("pattern"), F.lit(0))
    rows = rows.withColumn("m", matched).where(F.size("m") > 0)
    gaps = F.transform(F.split("t", F.col("pattern"), -1), lambda x: F.char_length(x))
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size("m")).alias("gap"), F.transform("m", lambda x: F.char_length(x)).alias("len"))
    rows = rows.select("k", "rule", "label", "priority", "weight", F.posexplode(pairs).alias("i", "x"))
    upto = Window.partitionBy("k", "rule").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("x.gap") + F.col("x.len")).over(upto)).withColumn("start", F.col("end") - F.col("x.len"))
    same = Window.partitionBy("k", "start", "end", "priority").orderBy("rule")
    rows = rows.withColumn("first", F.row_number().over(same)).where("first = 1")
    here = Window.partitionBy("k").orderBy("start")
    to_here, before = here.rangeBetween(Window.unboundedPreceding, 0), here.rangeBetween(Window.unboundedPreceding, -1)
    hidden = []
    for p in sorted(WEIGHTS):
        own, above = F.when(F.col("priority") == p, F.col("end")), F.when(F.col("priority") > p, F.col("end"))
        wider = (F.max(own).over(before) >= F.col("end")) | (F.max(own).over(to_here) > F.col("end")) | (F.max(above).over(to_here) >= F.col("end"))
        hidden.append((F.col("priority") == p) & F.coalesce(wider, F.lit(False)))
    rows = rows.withColumn("hidden", reduce(lambda a, b: a | b, hidden)).where("not hidden")
    return rows.select("k", "rule", "label", "start", "end", "priority", "weight")


def license_scan(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per document."""
    # the partition's number keeps Spark from moving filters below this step, where each would lower the text anew
    rows = documents.select("doc_id", F.struct(F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id")).alias("k"), lowered(F.col("text")).alias("t"), F.spark_partition_id().alias("part"))
    gated = rows.withColumn("words", keywords(F.col("t"))).where("part >= 0 and size(words) > 0")
    found = detections(gated.dropDuplicates(["k"]).select("k", "t", "words"))
    found = found.groupBy("k").agg(F.collect_set("label").alias("found"), F.max("weight").alias("weight"))
    base = _base(F.col("t"))
    out = rows.select("doc_id", "k", F.size(words_of(F.col("t"))).alias("n_words"), *(c.alias(n) for n, c in base.items())).join(found, "k", "left")
    empty = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", empty)))
    score = F.greatest(F.coalesce("weight", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(BASE_WEIGHT)).otherwise(F.lit(0.0)))
    return out.select(
        "doc_id", *(F.col(c).cast("long").alias(c) for c in ("n_words", "n_base", "first_word", "last_word")),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )
