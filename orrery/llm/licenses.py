"""Licence recognition by sentence rules, in DataFrame expressions alone.

A text is cut into sentences, each sentence is normalised (lower case, runs of anything but letters, digits and dots that
join digits become one space), and looked up among known licence sentences. Sentences end at blank lines and at the marks
``.;:!?`` (not at the colon of a licence tag); a known sentence may be wrapped over lines, and starts and ends where a sentence or a line does. What remains is the text's sequence of sentence
identifiers in order; a licence rule is an ordered list of identifiers that must occur in it in that order, with
nothing but unknown sentences between them. Longer rules are tried first and consume the identifiers they match, so a rule
that is part of another is not reported beside it.

Everything happens inside the row: no shuffle, no Python, memory bounded by one text. Texts that hold none of the words that every
known sentence has one of (``hints``, taken from the table itself) are not normalised.

Defined results: null, empty and licence-free texts give empty lists; repeated rows are returned as often as they come;
an empty table gives an empty result; columns pass through, and the added ones replace input columns of the same name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of licences that a file may carry as a tag.
SPDX = ("MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "MPL-2.0", "ISC", "BSL-1.0", "EPL-2.0", "CC0-1.0", "Unlicense", "Zlib")

# Public licence sentences, in normalised form, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "Apache2Grant",
    "licensed under the apache license version 2.0 the license": "Apache2GrantThe",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopyAt",
    "released under the mit license": "MITGrant",
    "licensed under the mit license": "MITGrant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "MITPermission",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITPermission",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "the software is provided as is without warranty of any kind": "MITWarranty",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITWarranty",
    "this work is licensed under the gnu general public license version 3": "GPL3Grant",
    "this work is licensed under the gnu general public license version 2": "GPL2Grant",
    "this program is free software": "GPLFree",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "GPLTerms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPLTerms",
    "either version 3 of the license or at your option any later version": "GPL3Version",
    "either version 2 of the license or at your option any later version": "GPL2Version",
    **{
        f"you can redistribute it and or modify it under the terms of the gnu general public license {rest}": f"GPL{v}Terms"
        for v in (3, 2)
        for rest in (
            f"as published by the free software foundation either version {v} of the license or at your option any later version",
            f"as published by the free software foundation version {v} of the license",
            f"as published by the free software foundation version {v}",
            f"version {v} as published by the free software foundation",
        )
    },
    "this library is free software": "LibraryFree",
    **{
        f"you can redistribute it and or modify it under the terms of the gnu {name} general public license as published by the free software foundation either version {v} of the license or at your option any later version": f"{i}Terms"
        for name, v, i in (("lesser", "2.1", "LGPL21"), ("lesser", "3", "LGPL3"), ("library", "2", "LGPL2"), ("affero", "3", "AGPL3"))
    },
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCPermission",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "ZeroBSDPermission",
    "this is free and unencumbered software released into the public domain": "UnlicenseGrant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibPermission",
    "licensed under cc by nc 4.0": "CCBYNC4Grant",
    "licensed under cc by 4.0": "CCBY4Grant",
    "licensed under cc by sa 4.0": "CCBYSA4Grant",
    "this work is licensed under a creative commons attribution 4.0 international license": "CCBY4Grant",
    "redistribution and use in source and binary forms with or without modification are permitted": "BSDPermission",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDPermission",
    "redistributions of source code must retain the above copyright notice": "BSDSource",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice": "BSDBinary",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "BSDEndorse",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "MPL2Grant",
    "distributed under the boost software license version 1.0": "BoostGrant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BoostPermission",
    **{f"this program and the accompanying materials are made available under the terms of the eclipse public license {rest}": "EPL2Grant" for rest in ("2.0", "v 2.0", "2.0 which is available at https", "2.0 which is available at http")},
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "CC0Waiver",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "MIT0Permission",
    "you can redistribute it and or modify it under the terms of the artistic license 2.0": "Artistic2Terms",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "WTFPLCopy",
    **{f"spdx license identifier {i.lower().replace('-', ' ')}": f"SPDX:{i}" for i in SPDX},
    "all rights reserved": "AllRights",
}

# Identifiers that licence texts begin with, behind a copyright line.
OPENINGS = ("BSDPermission", "MITPermission", "ISCPermission", "ZeroBSDPermission", "ZlibPermission", "BoostPermission", "MIT0Permission")

# Licence rules, longest first.
RULES = [
    ("BSD-3-Clause", ["BSDPermission", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("BSD-2-Clause", ["BSDPermission", "BSDSource", "BSDBinary"]),
    ("MIT", ["MITPermission", "MITNotice", "MITWarranty"]),
    ("Apache-2.0", ["Apache2GrantThe", "ApacheComply", "ApacheCopyAt"]),
    ("GPL-3.0", ["GPLFree", "GPLTerms", "GPL3Version"]),
    ("GPL-2.0", ["GPLFree", "GPLTerms", "GPL2Version"]),
    ("GPL-3.0", ["GPLFree", "GPL3Terms"]),
    ("GPL-2.0", ["GPLFree", "GPL2Terms"]),
    ("AGPL-3.0", ["GPLFree", "AGPL3Terms"]),
    ("LGPL-3.0", ["LibraryFree", "LGPL3Terms"]),
    ("LGPL-2.1", ["LibraryFree", "LGPL21Terms"]),
    ("LGPL-2.0", ["LibraryFree", "LGPL2Terms"]),
    # without a version any may be chosen
    ("GPL-1.0-or-later", ["GPLFree", "GPLTerms"]),
    ("MIT", ["MITPermission", "MITNotice"]),
    ("Apache-2.0", ["Apache2Grant"]),
    ("Apache-2.0", ["Apache2GrantThe"]),
    ("MIT", ["MITGrant"]),
    ("MIT", ["MITPermission"]),
    ("GPL-3.0", ["GPL3Grant"]),
    ("GPL-2.0", ["GPL2Grant"]),
    ("CC-BY-NC-4.0", ["CCBYNC4Grant"]),
    ("CC-BY-4.0", ["CCBY4Grant"]),
    ("CC-BY-SA-4.0", ["CCBYSA4Grant"]),
    ("MPL-2.0", ["MPL2Grant"]),
    ("ISC", ["ISCPermission"]),
    ("0BSD", ["ZeroBSDPermission"]),
    ("Unlicense", ["UnlicenseGrant"]),
    ("Zlib", ["ZlibPermission"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("BSL-1.0", ["BoostPermission"]),
    ("EPL-2.0", ["EPL2Grant"]),
    ("CC0-1.0", ["CC0Waiver"]),
    ("MIT-0", ["MIT0Permission"]),
    ("Artistic-2.0", ["Artistic2Terms"]),
    ("WTFPL", ["WTFPLCopy"]),
    *[(i, [f"SPDX:{i}"]) for i in SPDX],
    ("LicenseRef-all-rights-reserved", ["AllRights"]),
]

# Where the owner's own name may stand, and the words used for it in the table.
OWNED = "neither the name of "
OWNER = "the copyright holder"


def hints() -> list[str]:
    """Words of which every known sentence holds one, whatever owner it names: again and again the word that most of those left hold.

    A word of plain letters is left by normalising as it stands but for its case, so a text that holds none holds no known sentence.
    """
    plain = re.compile(r"[a-jl-z]{4,}")  # the Kelvin sign is lowered to k
    left = {frozenset(w for w in s.replace(OWNER, "").split() if plain.fullmatch(w)) for s in SENTENCES}
    found = []
    while left:
        words = sorted({w for s in left for w in s})
        found.append(max(words, key=lambda w: sum(w in s for s in left)))
        left = {s for s in left if found[-1] not in s}
    return found


def known_pattern() -> str:
    """Known sentences in normal form, wrapped anywhere, from one sentence or line end to another."""
    wrapped = lambda s: "[ \\n]".join(re.escape(w) for w in s.split())
    one = lambda s: wrapped(OWNED) + r"[ \n][^|]+?[ \n]" + wrapped(s[len(OWNED + OWNER) :]) if s.startswith(OWNED + OWNER) else wrapped(s)
    return r"(?<=[|\n])(?:" + "|".join(map(one, sorted(SENTENCES, key=len, reverse=True))) + r")(?=[|\n])"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    # sentence ends become bars, line ends stay; "v. 2.0" is no end
    normal = F.concat(F.lit("|"), F.translate(F.lower(text), "|", " "), F.lit("|"))
    for pattern, by in (
        (r"[;!?]+|(?<!spdx-license-identifier):|(?<!\bv)\.(?=[\s|])", "|"),
        (r"[^\p{L}\p{N}.|\r\n]+", " "),
        (r"\.(?!\d)|(?<!\d)\.", ""),
        (r" +", " "),
        (r" ?(?:\r\n?|\n) ?", "\n"),
        (r"\n\n+| ?\| ?", "|"),
    ):
        normal = F.regexp_replace(normal, pattern, by)
    found = F.transform(F.regexp_extract_all(normal, F.lit(known_pattern()), F.lit(0)), lambda s: F.element_at(known, F.regexp_replace(F.translate(s, "\n", " "), f"^{OWNED}.+? nor the names", f"{OWNED}{OWNER} nor the names")))
    # normalising may join what dots part
    return F.when(F.replace(text, F.lit("."), F.lit("")).rlike("(?i)" + "|".join(hints())), found).otherwise(F.array().cast("array<string>"))


def licences(ids: Column) -> Column:
    """Sorted distinct licences whose rules match a sequence of identifiers.

    A reservation of rights at the head of a licence text is overridden by it, and part of its rule.
    """
    line = F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|"))
    hits = []
    for name, rule in [x for n, r in RULES for x in ([(n, ["AllRights", *r])] if r[0] in OPENINGS else []) + [(n, r)]]:
        pattern = "".join(f"|{x}|" for x in rule)
        hits.append(F.when(F.contains(line, F.lit(pattern)), F.lit(name)))
        line = F.replace(line, F.lit(pattern), F.lit("#"))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))


def scan_licences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids`` and ``licences``."""
    ids = F.coalesce(sentence_ids(F.col(text_col)), F.array().cast("array<string>"))
    # the identifiers are made once: the rules read the projected column
    return docs.withColumn("sentence_ids", ids).withColumn("licences", F.when(F.size("sentence_ids") > 0, licences(F.col("sentence_ids"))).otherwise(F.array().cast("array<string>")))
