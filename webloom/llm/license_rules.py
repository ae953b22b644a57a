"""Signature rules for licence texts.

A rule is (label, priority, confidence, first word, pattern): the pattern is matched against the lower-case words from the first word on,
joined by single blanks.  Patterns use only syntax that Java, RE2 and Python share.  Rules stand in order: where two
with the same priority match equally many words, the earlier one wins.
"""

from __future__ import annotations

from dataclasses import dataclass

SPAN = 32  # words a pattern may look at

_V = r"(?: v(?:ersion)?)?(?: ?[0-9]+)?(?: [0-9]+)?(?: or (?:any )?later(?: version)?| only)?"

# (label, name pattern; its first word is literal)
NAMES = [
    ("agpl", r"gnu affero general public licen[cs]e" + _V),
    ("agpl", r"affero general public licen[cs]e" + _V),
    ("agpl", r"agpl" + _V),
    ("agpl", r"agplv3"),
    ("lgpl", r"gnu (?:lesser|library) general public licen[cs]e" + _V),
    ("lgpl", r"lesser general public licen[cs]e" + _V),
    ("lgpl", r"gnu lgpl" + _V),
    ("lgpl", r"lgpl" + _V),
    ("gpl", r"gnu general public licen[cs]e" + _V),
    ("gpl", r"gnu public licen[cs]e" + _V),
    ("gpl", r"general public licen[cs]e" + _V),
    ("gpl", r"gnu gpl" + _V),
    ("gpl", r"gpl (?:v(?:ersion)? ?)?[23](?: 0)?(?: or later| only)?"),
    ("gpl", r"gplv[23]"),
    ("gfdl", r"gnu free documentation licen[cs]e" + _V),
    ("apache", r"apache software licen[cs]e" + _V),
    ("apache", r"apache licen[cs]e" + _V),
    ("apache", r"apache 2 0(?: licen[cs]e)?"),
    ("apache", r"asl 2 0"),
    ("mit", r"mit(?: x11)? licen[cs]e"),
    ("mit", r"expat licen[cs]e"),
    ("mit", r"x11 licen[cs]e"),
    ("mit-0", r"mit no attribution(?: licen[cs]e)?"),
    ("bsd-2-clause", r"bsd 2 clause(?: licen[cs]e)?"),
    ("bsd-2-clause", r"simplified bsd licen[cs]e"),
    ("bsd-3-clause", r"bsd 3 clause(?: licen[cs]e)?"),
    ("bsd-3-clause", r"(?:modified|new|revised) bsd licen[cs]e"),
    ("bsd-4-clause", r"bsd 4 clause(?: licen[cs]e)?"),
    ("0bsd", r"zero clause bsd(?: licen[cs]e)?"),
    ("bsd", r"bsd(?: style)? licen[cs]e"),
    ("isc", r"isc licen[cs]e"),
    ("mpl", r"mozilla public licen[cs]e" + _V),
    ("mpl", r"mpl 2 0"),
    ("epl", r"eclipse public licen[cs]e" + _V),
    ("epl", r"epl [12] 0"),
    ("eupl", r"european union public licen[cs]e" + _V),
    ("cddl", r"common development and distribution licen[cs]e" + _V),
    ("cpl", r"common public licen[cs]e" + _V),
    ("artistic", r"artistic licen[cs]e" + _V),
    ("zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("boost", r"boost software licen[cs]e" + _V),
    ("psf", r"python software foundation licen[cs]e" + _V),
    ("php", r"php licen[cs]e" + _V),
    ("ofl", r"sil open font licen[cs]e" + _V),
    ("odbl", r"open (?:data commons open )?database licen[cs]e" + _V),
    ("odc-by", r"open data commons attribution licen[cs]e" + _V),
    ("ms-pl", r"microsoft public licen[cs]e" + _V),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e" + _V),
    ("unlicense", r"the unlicense"),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", r"creative commons zero" + _V),
    ("cc0", r"cc zero" + _V),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [0-9] 0)?"),
    ("cc-by-nc-nd", r"cc by nc nd(?: [0-9] [0-9])?"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: [0-9] 0)?"),
    ("cc-by-nc-sa", r"cc by nc sa(?: [0-9] [0-9])?"),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: [0-9] 0)?"),
    ("cc-by-nc", r"cc by nc(?: [0-9] [0-9])?"),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [0-9] 0)?"),
    ("cc-by-nd", r"cc by nd(?: [0-9] [0-9])?"),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: [0-9] 0)?"),
    ("cc-by-sa", r"cc by sa(?: [0-9] [0-9])?"),
    ("cc-by", r"creative commons attribution(?: [0-9] 0)?"),
    ("cc-by", r"cc by(?: [0-9] [0-9])?"),
    ("creative-commons", r"creative commons licen[cs]e"),
    ("public-domain", r"public domain dedication"),
    ("proprietary", r"proprietary licen[cs]e"),
]

# a name behind one of these is a statement about the text, not a mention
OPENERS = ["licensed", "released", "distributed", "published", "available", "provided", "covered", "redistributed"]
_UNDER = r" (?:under|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?(?: version [0-9](?: 0)? of the)? "

# (label, pattern) of licence texts themselves
NOTICES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", r"neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used"),
    ("apache", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", r"you may not use this file except in compliance with the license"),
    ("gpl", r"free software you can redistribute it and or modify it under the terms of the gnu general public license" + _V),
    ("lgpl", r"free software you can redistribute it and or modify it under the terms of the gnu lesser general public license" + _V),
    ("agpl", r"free software you can redistribute it and or modify it under the terms of the gnu affero general public license" + _V),
    ("mpl", r"source code form is subject to the terms of the mozilla public license" + _V),
    ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("zlib", r"altered source versions must be plainly marked as such"),
    ("unlicense", r"free and unencumbered software released into the public domain"),
    ("public-domain", r"released into the public domain"),
    ("public-domain", r"dedicated to the public domain"),
    ("proprietary", r"all rights reserved"),
    ("proprietary", r"unauthorized (?:copying|reproduction|distribution)"),
    ("proprietary", r"confidential and proprietary"),
]

SPDX = [
    ("agpl", r"agpl 3 0"), ("lgpl", r"lgpl [23] [01]"), ("gpl", r"gpl [123] 0"), ("apache", r"apache 2 0"), ("mit-0", r"mit 0"), ("mit", r"mit"),
    ("bsd-2-clause", r"bsd 2 clause"), ("bsd-3-clause", r"bsd 3 clause"), ("isc", r"isc"), ("mpl", r"mpl 2 0"), ("epl", r"epl [12] 0"), ("cc0", r"cc0 1 0"),
    ("cc-by-sa", r"cc by sa [0-9] 0"), ("cc-by-nc", r"cc by nc [0-9] 0"), ("cc-by", r"cc by [0-9] 0"), ("zlib", r"zlib"), ("boost", r"bsl 1 0"), ("unlicense", r"unlicense"), ("wtfpl", r"wtfpl"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    first: str
    keyword: str  # has to stand among the words before the pattern is tried
    pattern: str


def _first_words(pattern: str) -> list[str]:
    head = pattern.split(" ")[0]
    if head.startswith("(?:"):
        return pattern[3 : pattern.index(")")].split("|")
    return [head.split("(?:")[0].replace("v[23]", "v2"), head.replace("v[23]", "v3")] if "[23]" in head else [head.split("(?:")[0]]


def _keyword(pattern: str) -> str:
    """A literal word that every match holds: the longest plain word outside groups."""
    flat, depth = [], 0
    for c in pattern:
        depth += c == "("
        if not depth:
            flat.append(c)
        elif c == ")":
            flat.append("(")  # a group touches its neighbours
        depth -= c == ")"
    plain = [w for w in "".join(flat).split(" ") if w.isalnum()]
    return max(plain, key=len, default="")


def rules() -> list[Rule]:
    out = [Rule(label, 90, 0.99, "spdx", "identifier", rf"spdx licen[cs]e identifier {p}(?: or later| only)?") for label, p in SPDX]
    out += [Rule(label, 80, 0.95, first, _keyword(p), p) for label, p in NOTICES for first in _first_words(p)]
    out += [Rule(label, 70, 0.9, opener, _keyword(p) or first, opener + _UNDER + p) for opener in OPENERS for label, p in NAMES for first in _first_words(p)[:1]]
    out += [Rule(label, 50, 0.7, first, _keyword(p), p) for label, p in NAMES for first in _first_words(p)]
    return out


# fixed values of the contract: phrase, label
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
