"""Licence detection: ordered signature rules over a text's words.

A rule is a regular expression over lower-cased words joined by single spaces, with a label, a worth and keywords of
several letters, one of which every match holds. Only texts that hold some keyword are looked at, and of the rules only
those of whose keywords the text holds one. Rules are ordered: sentences of licences and notices first, then addresses,
then names, each from the most particular on. A name is matched together with the words that it is spoken of with ("licensed
under the terms of the ..."), which decide what it is worth. Of detections whose places overlap, one inside a detection of
a higher rule is suppressed.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import match_spans

#: Places of these phrases always count.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: What is not part of a word; A-Z are, before they are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _version(major: str, minor: str = "") -> str:
    """How a version follows a name: "3", "v3", "v 3", "version 3", "version v3", with ".0" or without."""
    return rf"(?: version| ver)?(?: v ?| ?v| )?{major}" + (rf" {minor}" if minor else "(?: 0)?")


def _family(label: str, name: str, keywords: str, *versions: tuple[str, ...], bare: bool = True) -> list[tuple[str, str, str]]:
    """Rules (label, regex, keywords) of a licence's name: each version, then the name alone where that says enough."""
    made = [(f"{label}-{'.'.join(v)}", name + _version(*v), keywords) for v in versions]
    return made + ([(label, name, keywords)] if bare else [])


_L = "licen[sc]e"


def families() -> list[tuple[str, str, str]]:
    """(label, regex of the name, keywords), the more particular first. Keywords are separated by |."""
    made = [
        *_family("agpl", rf"(?:gnu )?(?:affero general public {_L}|agpl)", "affero|agpl", ("3",), ("1",)),
        *_family("lgpl", rf"(?:gnu )?(?:(?:lesser|library) general public {_L}|lgpl)", "lesser general|library general|lgpl", ("2", "1"), ("3",), ("2",)),
        *_family("gfdl", rf"(?:gnu )?free documentation {_L}|gfdl", "free documentation|gfdl", ("1", "3"), ("1", "2"), ("1", "1")),
        ("gpl-2-classpath", rf"(?:gnu general public {_L}|gnu gpl|gpl){_version('2')} with (?:the )?classpath exception", "classpath"),
        *_family("gpl", rf"(?:gnu general public {_L}|gnu gpl|gpl)", "general public|gpl", ("3",), ("2",), ("1",)),
        ("apache-2-llvm", rf"apache(?: {_L})?{_version('2')} with (?:the )?llvm exceptions?", "llvm"),
        ("apache-1.1", rf"apache(?: software)? {_L}{_version('1', '1')}", "apache"),
        ("apache-1", rf"apache(?: software)? {_L}{_version('1')}", "apache"),
        ("apache-2", rf"(?:apache(?: software)? {_L}{_version('2')}|apache{_version('2')}|asl 2 0)", "apache|asl 2"),
        ("apache", rf"apache(?: software)? {_L}", "apache"),
        ("mit-0", rf"mit (?:no attribution|0)", "mit no attribution|mit 0"),
        ("mit-modern", rf"mit modern (?:variant|{_L})", "mit modern"),
        ("mit", rf"(?:mit|expat) {_L}", "mit licen|expat licen"),
        ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd|four clause bsd)", "bsd|4 clause|four clause"),
        ("bsd-3-clause-clear", r"(?:bsd 3 clause clear|clear bsd)", "bsd"),
        ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|(?:new|modified|revised) bsd)", "bsd"),
        ("bsd-2-clause-patent", r"bsd (?:2 clause )?plus patent|bsd 2 clause patent", "bsd"),
        ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|(?:simplified|freebsd) bsd)", "bsd"),
        ("bsd-1-clause", r"bsd 1 clause", "bsd"),
        ("0bsd", r"(?:0bsd|bsd zero clause|zero clause bsd|bsd 0 clause)", "0bsd|bsd|zero clause"),
        ("bsd", rf"bsd (?:style )?{_L}", "bsd"),
        *_family("mpl", rf"(?:mozilla public {_L}|mpl)", "mozilla|mpl", ("2",), ("1", "1"), ("1",), bare=False),
        ("mpl", rf"mozilla public {_L}", "mozilla"),
        *_family("epl", rf"(?:eclipse public {_L}|epl)", "eclipse|epl", ("2",), ("1",), bare=False),
        ("epl", rf"eclipse public {_L}", "eclipse"),
        ("edl-1", rf"eclipse distribution {_L}", "eclipse"),
        *_family("cddl", rf"(?:common development and distribution {_L}|cddl)", "common development|cddl", ("1", "1"), ("1",)),
        ("cpl-1", rf"common public {_L}", "common public"),
        ("cpal-1", rf"(?:common public attribution {_L}|cpal)", "common public attribution|cpal"),
        ("ipl-1", rf"ibm public {_L}", "ibm public"),
        *_family("eupl", rf"(?:european union public {_L}|eupl)", "european union public|eupl", ("1", "2"), ("1", "1"), ("1",)),
        *_family("artistic", rf"artistic {_L}", "artistic", ("2",), ("1",)),
        ("boost-1", rf"(?:boost software {_L}|bsl 1 0)", "boost software|bsl 1 0"),
        ("zlib", rf"zlib(?: libpng)? {_L}", "zlib"),
        ("libpng", rf"libpng {_L}", "libpng"),
        ("isc", rf"isc {_L}", "isc licen"),
        ("unlicense", r"(?:the )?unlicense", "unlicense"),
        ("wtfpl", rf"(?:do what the fuck you want to public {_L}|wtfpl)", "do what the|wtfpl"),
        ("postgresql", rf"postgresql {_L}", "postgresql"),
        ("python-2", rf"(?:python software foundation|psf) {_L}{_version('2')}", "python software|psf"),
        ("python", rf"(?:python software foundation|psf|python) {_L}", "python|psf"),
        ("ruby", rf"ruby {_L}", "ruby"),
        ("php-3", rf"php {_L}", "php licen"),
        ("perl-5", r"same terms as perl(?: itself)?", "terms as perl"),
        ("tcl", rf"tcl(?: tk)? {_L}", "tcl"),
        ("curl", rf"curl {_L}", "curl"),
        ("ms-pl", rf"(?:microsoft public {_L}|ms pl)", "microsoft public|ms pl"),
        ("ms-rl", rf"(?:microsoft reciprocal {_L}|ms rl)", "microsoft reciprocal|ms rl"),
        ("sspl-1", rf"(?:server side public {_L}|sspl)", "server side public|sspl"),
        *_family("elastic", rf"elastic {_L}", "elastic", ("2",)),
        ("busl-1.1", rf"(?:business source {_L}|busl|bsl 1 1)", "business source|busl|bsl 1 1"),
        ("fsl-1.1", rf"functional source {_L}", "functional source"),
        ("commons-clause", r"commons clause", "commons clause"),
        ("polyform-noncommercial-1", rf"polyform noncommercial(?: {_L})?", "polyform"),
        ("polyform-small-business-1", rf"polyform small business(?: {_L})?", "polyform"),
        ("ofl-1.1", rf"(?:sil open font {_L}|open font {_L}|ofl 1 1)", "open font|ofl 1 1"),
        ("odbl-1", rf"(?:open (?:data commons open )?database {_L}|odbl)", "database licen|odbl"),
        ("odc-by-1", rf"(?:open data commons attribution(?: {_L})?|odc by)", "data commons attribution|odc by"),
        ("pddl-1", rf"(?:public domain dedication and {_L}|pddl)", "public domain dedication|pddl"),
        ("cdla-permissive-2", rf"(?:community data {_L} agreement|cdla) permissive{_version('2')}", "community data|cdla"),
        ("cdla-permissive-1", rf"(?:community data {_L} agreement|cdla) permissive{_version('1')}", "community data|cdla"),
        ("cdla-sharing-1", rf"(?:community data {_L} agreement|cdla) sharing", "community data|cdla"),
        ("cdla", rf"community data {_L} agreement", "community data"),
        ("ogl-uk-3", rf"open government {_L}(?: v3)?", "open government"),
        ("etalab-2", r"(?:licence ouverte|open licence) etalab|etalab(?: 2 0)?", "etalab"),
        ("dl-de-by-2", r"datenlizenz deutschland", "datenlizenz"),
        ("bigscience-rail", rf"bigscience (?:bloom )?rail(?: {_L})?", "bigscience"),
        ("openrail", rf"(?:responsible ai {_L}|(?:creativeml )?openrail(?: m)?)", "responsible ai|openrail"),
        ("llama-community", rf"(?:meta )?llama(?: [234](?: [0-9])?)? community {_L}", "llama"),
        ("gemma", r"gemma terms of use", "gemma"),
        ("vim", rf"vim {_L}", "vim licen"),
        ("x11", rf"x11 {_L}", "x11"),
        ("hpnd", r"historical permission notice and disclaimer", "historical permission"),
        ("ncsa", rf"(?:university of illinois open source|university of illinois ncsa|ncsa) {_L}", "illinois|ncsa"),
        ("openssl", rf"openssl {_L}", "openssl"),
        ("ssleay", rf"ssleay {_L}", "ssleay"),
        ("ecl-2", rf"educational community {_L}", "educational community"),
        ("osl-3", rf"open software {_L}", "open software"),
        ("afl-3", rf"academic free {_L}", "academic free"),
        ("upl-1", rf"universal permissive {_L}", "universal permissive"),
        ("mulan-2", r"mulan (?:psl|permissive software)", "mulan"),
        ("cecill-b", r"cecill b", "cecill"),
        ("cecill-c", r"cecill c", "cecill"),
        ("cecill-2.1", r"cecill", "cecill"),
        ("cc0-1", r"(?:creative commons zero|cc0)(?: 1 0)?(?: universal)?", "commons zero|cc0"),
        ("sleepycat", rf"sleepycat {_L}", "sleepycat"),
        ("spl-1", rf"sun public {_L}", "sun public"),
        ("qpl-1", rf"(?:q public {_L}|qpl)", "q public|qpl"),
        ("npl-1.1", rf"netscape public {_L}", "netscape"),
        ("rpl-1.5", rf"reciprocal public {_L}", "reciprocal public"),
        ("watcom-1", rf"sybase open watcom public {_L}", "watcom"),
        ("lppl-1.3", rf"(?:latex project public {_L}|lppl)", "latex project|lppl"),
        ("imagemagick", rf"imagemagick {_L}", "imagemagick"),
        ("ijg", rf"independent jpeg group {_L}", "jpeg group"),
        ("unicode-3", rf"unicode (?:{_L}(?: v3)?|terms of use)", "unicode"),
        ("blueoak-1", rf"blue oak model {_L}", "blue oak"),
        ("hippocratic", rf"hippocratic {_L}", "hippocratic"),
        ("json", rf"json {_L}", "json licen"),
        ("beerware", rf"beer ?ware {_L}", "beer"),
    ]
    # Creative Commons: every allowed combination of parts with every version.
    for short, long in CC_PARTS:
        name = rf"(?:cc {short}|creative commons attribution{' ' + long if long else ''})"
        made += [(f"cc-{short.replace(' ', '-')}{'-' + v if v else ''}", name + tail, "cc by|creative commons") for v, tail in CC_VERSIONS]
    return made


#: Parts of Creative Commons names, the longest first, and versions.
CC_PARTS = (("by nc nd", "non ?commercial no ?deriv\\w*"), ("by nc sa", "non ?commercial share ?alike"), ("by nc", "non ?commercial"), ("by nd", "no ?deriv\\w*"), ("by sa", "share ?alike"), ("by", ""))
CC_VERSIONS = (("4", " 4 0(?: international)?"), ("3", " 3 0(?: unported)?"), ("2.5", " 2 5(?: generic)?"), ("2", " 2 0(?: generic)?"), ("1", " 1 0(?: generic)?"), ("", ""))
#: How a licence is spoken of: the words before its name and what the match is worth; the longest first.
FORMS = (
    (r"(?:is |are )?(?:dual )?(?:licen[sc]ed|released|distributed|available|published|covered|provided|governed) (?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?", 0.95),
    (r"(?:spdx licen[sc]e identifier|licen[sc]e|licensed) ", 0.9),
    (r"under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?", 0.8),
)
#: What a name alone is worth.
ALONE = 0.5
#: The last word of every form: before a name that says nothing alone, one of them stands.
LEADS = ("under", "by", "the", "of", "identifier", "license", "licence", "licensed")
#: Short names that count only after a form: label, first word, what may follow it.
SPOKEN = (
    ("mit", "mit", ""), ("mit", "expat", ""), ("isc", "isc", ""), ("zlib", "zlib", ""), ("libpng", "libpng", "(?: 2 0)?"), ("postgresql", "postgresql", ""), ("ruby", "ruby", ""), ("php-3", "php", " 3(?: 0)?(?: 0?1)?"),
    ("tcl", "tcl", ""), ("curl", "curl", ""), ("vim", "vim", ""), ("x11", "x11", ""), ("ncsa", "ncsa", ""), ("openssl", "openssl", ""), ("json", "json", ""), ("python-2", "python", " 2(?: 0)?(?: 1)?"), ("python-2", "psf", " 2(?: 0)?"),
    ("artistic-2", "artistic", " 2 0"), ("artistic-1", "artistic", " 1 0(?: perl| cl8)?"), ("elastic-2", "elastic", " 2 0"), ("ecl-2", "ecl", " 2 0"), ("osl-3", "osl", " 3 0"), ("afl-3", "afl", " 3 0"), ("upl-1", "upl", " 1 0"),
    ("ipl-1", "ipl", " 1 0"), ("cpl-1", "cpl", " 1 0"), ("spl-1", "spl", " 1 0"), ("npl-1.1", "npl", " 1 1"), ("rpl-1.5", "rpl", " 1 5"), ("watcom-1", "watcom", " 1 0"), ("imagemagick", "imagemagick", ""), ("ijg", "ijg", ""),
    ("unicode-3", "unicode", " (?:3 0|dfs 201[56]|tou)"), ("blueoak-1", "blueoak", " 1 0(?: 0)?"), ("hippocratic", "hippocratic", " 2 1"), ("beerware", "beerware", ""), ("sleepycat", "sleepycat", ""), ("mulan-2", "mulanpsl", "(?: 2 0)?"),
    ("ogl-uk-3", "ogl", " uk 3 0"), ("dl-de-by-2", "dl", " de by 2 0"), ("hpnd", "hpnd", ""), ("bsd-3-clause", "bsd", " 3"), ("bsd-2-clause", "bsd", " 2"), ("bsd", "bsd", ""), ("apache-1.1", "apache", " 1 1"), ("apache-1", "apache", " 1 0"),
)
#: Rules that are not about a name: label, regex, keywords, worth. Sentences of licences and notices, then addresses.
OTHERS = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge", 1.0),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "above copyright notice and this permission", 1.0),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee", 1.0),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted", "without fee is hereby granted", 1.0),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", "all advertising materials", 1.0),
    ("bsd-3-clause", r"neither the name of (?:the )?(?:\w+ ){1,8}nor the names of its contributors may be used to endorse or promote", "names of its contributors", 1.0),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", 1.0),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions of source code", 0.9),
    ("apache-2", r"you may not use this file except in compliance with the license", "in compliance with the license", 0.9),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "agreed to in writing", 0.9),
    ("gpl-3", r"either version 3 of the license or at your option any later version", "version 3 of the license", 0.95),
    ("gpl-2", r"either version 2 of the license or at your option any later version", "version 2 of the license", 0.95),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of", "free software you can redistribute", 0.9),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of", "free software you can redistribute", 0.9),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license v 2 0", "source code form is subject", 1.0),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", "contents of this file are subject", 1.0),
    ("cddl-1", r"the contents of this file are subject to the terms of the common development and distribution license", "contents of this file are subject", 1.0),
    ("epl-1", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", "accompanying materials", 1.0),
    ("epl-2", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "accompanying materials", 1.0),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "without any express or implied warranty", 1.0),
    ("zlib", r"the origin of this software must not be misrepresented", "must not be misrepresented", 1.0),
    ("boost-1", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "any person or organization obtaining", 1.0),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered software", 1.0),
    ("wtfpl", r"you just do what the fuck you want to", "just do what the", 0.9),
    ("beerware", r"you can buy me a beer in return", "buy me a beer", 1.0),
    ("artistic-2", r"everyone is permitted to copy and distribute verbatim copies of this license document", "verbatim copies", 0.4),
    ("cc0-1", r"(?:has )?waived all copyright and related or neighboring rights", "neighboring rights", 1.0),
    ("ofl-1.1", r"this font software is licensed under the sil open font license", "font software", 1.0),
    ("openssl", r"this product includes software developed by the openssl project", "openssl project", 0.9),
    ("perl-5", r"this (?:library|program|module) is free software you can redistribute it and or modify it under the same terms as perl itself", "terms as perl", 1.0),
    ("json", r"the software shall be used for good not evil", "good not evil", 1.0),
    ("ogl-uk-3", r"contains public sector information licensed under the open government licence", "public sector information", 1.0),
    ("public-domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", "public domain", 0.8),
    ("public-domain", r"no copyright (?:is|was) claimed|this work is not subject to copyright", "copyright", 0.8),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary", 0.8),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|distribution|reproduction|disclosure) (?:of this \w+ )?(?:via any medium )?(?:is )?(?:strictly )?prohibited", "unauthori", 0.8),
    ("proprietary", r"may not be (?:reproduced|copied|distributed|redistributed) (?:\w+ ){0,6}without (?:the )?(?:prior |express )?(?:written )?permission", "may not be", 0.8),
    ("proprietary", r"all rights reserved", "all rights reserved", 0.4),
    ("proprietary", r"end user licen[sc]e agreement", "end user licen", 0.6),
    ("noncommercial", r"(?:for )?(?:non ?commercial|personal|educational|research) use only", "use only", 0.7),
    ("noncommercial", r"not (?:for|to be used for) commercial (?:use|purposes)", "commercial", 0.7),
    ("no-ai-training", r"may not be used (?:for|to) (?:\w+ ){0,3}(?:train|training)(?: \w+){0,3} (?:ai|models?|machine learning)", "may not be used", 0.8),
    ("copyright", r"copyright (?:c |© )?(?:19|20)\d\d", "copyright", 0.3),
    ("mit", r"opensource org licenses mit(?: license)?", "opensource org", 0.95),
    ("apache-2", r"apache org licenses license 2 0", "apache org licenses", 0.95),
    ("bsd-3-clause", r"opensource org licenses bsd 3 clause", "opensource org", 0.95),
    ("bsd-2-clause", r"opensource org licenses bsd 2 clause", "opensource org", 0.95),
    ("isc", r"opensource org licenses isc", "opensource org", 0.95),
    ("gpl-3", r"gnu org licenses gpl 3 0", "gnu org licenses", 0.95),
    ("agpl-3", r"gnu org licenses agpl(?: 3 0)?", "gnu org licenses", 0.95),
    ("lgpl-3", r"gnu org licenses lgpl 3 0", "gnu org licenses", 0.95),
    ("gpl-2", r"gnu org licenses old licenses gpl 2 0", "gnu org licenses", 0.95),
    ("lgpl-2.1", r"gnu org licenses old licenses lgpl 2 1", "gnu org licenses", 0.95),
    ("gfdl", r"gnu org licenses fdl(?: 1 3)?", "gnu org licenses", 0.95),
    ("mpl-2", r"mozilla org mpl 2 0", "mozilla org", 0.95),
    ("mpl-1.1", r"mozilla org mpl mpl 1 1", "mozilla org", 0.95),
    ("epl-2", r"eclipse org legal epl 2 0", "eclipse org", 0.95),
    ("epl-1", r"eclipse org legal epl v10", "eclipse org", 0.95),
    ("unlicense", r"unlicense org", "unlicense", 0.95),
    ("boost-1", r"boost org license 1 0", "boost org", 0.95),
    ("ofl-1.1", r"scripts sil org ofl", "sil org", 0.95),
    ("cc0-1", r"creativecommons org publicdomain zero 1 0", "creativecommons org", 0.95),
    ("public-domain", r"creativecommons org publicdomain mark 1 0", "creativecommons org", 0.95),
)


def rules() -> list[tuple[str, str, tuple[str, ...], float | None]]:
    """(label, regex, keywords, worth) in the order of priority: sentences and addresses, those of Creative Commons too, then names. The worth of a name is told by its form."""
    made = [(label, rx, tuple(kw.split("|")), worth) for label, rx, kw, worth in OTHERS]
    for short, _ in CC_PARTS:
        for v, _ in CC_VERSIONS[:-1]:
            tail = f"{v} 0" if "." not in v else v.replace(".", " ")
            made.append((f"cc-{short.replace(' ', '-')}-{v}", rf"creativecommons org licenses {short} {tail}", ("creativecommons org",), 0.95))
    said = "|".join(rx for rx, _ in FORMS)
    made += [(label, rf"(?:{said})?(?:{name})", tuple(kw.split("|")), None) for label, name, kw in families()]
    # Short names come last, so that what a longer name takes is not taken again.
    made += [(label, rf"(?:{said})(?:{first}{rest})", tuple(f"{lead} {first}" for lead in LEADS), None) for label, first, rest in SPOKEN]
    return made


def gate() -> str:
    """A regex that finds some keyword of some rule, or a base phrase, at the start of a word; case aside."""
    words = sorted({k for _, _, kws, _ in rules() for k in kws} | {phrase for phrase, _ in BASE})
    heads = [w for w in words if not any(w != o and w.startswith(o) for o in words)]  # a longer keyword adds nothing to one that it begins with
    by_letter: dict[str, list[str]] = {}
    for w in heads:
        by_letter.setdefault(w[0], []).append(w[1:])
    return "(?i) (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items())) + ")"


def words_of(text: Column) -> Column:
    """Words, as written, with one space before, between and after; a text without words is two spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BETWEEN, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _places(row: Column, phrase: str) -> Column:
    """array<long>: the words at which the phrase starts, of an array of words."""
    first, *rest = phrase.split()

    def at(word, i):
        fits = word == first
        for k, w in enumerate(rest, 1):
            fits = fits & (F.get(row, i + k) == w)
        return F.when(fits, i.cast("long"))

    return F.filter(F.transform(row, at), lambda i: i.isNotNull())


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, n_words, n_base, first_word, last_word, base_labels, labels, detections, score.

    Words are counted from 0. detections are those left of the method, as array<struct<label, start, end, worth>> in code
    points of the words joined by spaces. score is the largest worth of what was found, 1 for a base phrase, 0 for nothing.
    Null and empty texts have no words. Repeated rows are rows of their own. Other columns play no part. No shuffle.
    """
    rows = docs.select(F.col(key).alias("key"), words_of(F.col(text)).alias("raw"))
    n_words = F.when(F.col("raw") == "  ", 0).otherwise(_spaces(F.col("raw")) - 1).cast("long")
    # What follows is looked at in few texts: the others' words go on as null.
    lowered = F.translate("raw", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rows.select("key", n_words.alias("n_words"), F.when(F.col("raw").rlike(gate()), lowered).alias("words"))
    nowhere = F.expr("cast(array() as array<bigint>)")
    for i, (phrase, _) in enumerate(BASE):
        rows = rows.withColumn(f"at{i}", F.when(F.col("words").contains(f" {phrase} "), _places(F.split(F.trim("words"), " "), phrase)).otherwise(nowhere))
    at = [F.col(f"at{i}") for i in range(len(BASE))]
    table = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(label).alias("label"), F.lit(rf"(?<= )(?:{rx})(?= )").alias("rx"), F.array(*[F.lit(f" {k}") for k in kws]).alias("kws"), F.lit(worth).cast("double").alias("worth")) for i, (label, rx, kws, worth) in enumerate(rules())])
    matched = F.filter(table, lambda r: F.exists(r["kws"], lambda k: F.col("words").contains(k)) & F.regexp_like(F.col("words"), r["rx"]))
    none = F.expr("cast(array() as array<struct<rank:int,label:string,worth:double,start:int,end:int>>)")

    def intervals(r):
        worth = lambda s: F.coalesce(r["worth"], F.coalesce(*[F.when(s.rlike(f"^(?:{rx})"), F.lit(w)) for rx, w in FORMS], F.lit(ALONE)))
        return F.transform(match_spans(F.col("words"), r["rx"]), lambda m: F.struct(r["rank"].alias("rank"), r["label"].alias("label"), worth(m["span"]).alias("worth"), m["start"].alias("start"), m["end"].alias("end")))

    rows = rows.withColumn("hits", F.when(F.col("words").isNotNull(), F.flatten(F.transform(matched, intervals))).otherwise(none))
    # A detection inside one of a higher rule goes; of equal places the higher rule's stays.
    kept = F.filter("hits", lambda h: ~F.exists("hits", lambda o: (o["rank"] < h["rank"]) & (o["start"] <= h["start"]) & (o["end"] >= h["end"])))
    rows = rows.withColumn("kept", kept)
    every = F.concat(*at)
    base = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(a) > 0, F.lit(label)) for a, (_, label) in zip(at, BASE, strict=True)]), lambda x: x.isNotNull())))
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform("kept", lambda k: k["label"]))))
    score = F.when(F.size(every) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("kept", lambda k: k["worth"])), F.lit(0.0)))
    return rows.select(
        F.col("key").alias(key),
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).alias("first_word"),
        F.array_max(every).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.transform("kept", lambda k: F.struct(k["label"].alias("label"), k["start"].alias("start"), k["end"].alias("end"), k["worth"].alias("worth"))).alias("detections"),
        score.cast("double").alias("score"),
    )
