"""Licence scan with DataFrame functions only: known sentences become identifiers, and identifier sequences are matched to rules.

A text is cut into sentences (after . ! ? ; : before white space and no small letter or digit, or before a list number such as ``1.`` or
``(a)``, after ``);`` and after the line of an ``SPDX-License-Identifier:``, which is not cut itself), each is normalised (list numbers in front dropped, lower case,
everything but letters, digits and dots inside numbers becomes one space), and a sentence that is known gives its identifier. One that is
not known is read by its paragraphs, these by stops before line ends or wide gaps, what is still not known by its lines and these by all stops, so
wrapped sentences, those on lines of their own and those after a small letter are found beside each other, in the order of the text. A licence rule is an ordered
sequence of identifiers; it matches where they occur in this order among the document's known sentences, other text in between or
not. Of the rules that match, those whose sequence is part of a longer matching rule of the same licence are dropped.

Null and empty texts, and texts without a known sentence, have no licence: empty lists. Repeated sentences keep their places and
match once. Repeated rows are scanned alike; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences, normalised. Wording of public licence notices.
SENTENCES = {
    "mit-ref": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "spdx license identifier mit"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "as-is": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "apache-ref": ("licensed under the apache license version 2.0", "released under the apache license version 2.0", "licensed under the apache license version 2.0 the license", "spdx license identifier apache 2.0"),
    "apache-comply": ("you may not use this file except in compliance with the license",),
    "apache-basis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "gpl3-ref": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "spdx license identifier gpl 3.0 only", "spdx license identifier gpl 3.0 or later"),
    "gpl-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "gpl-warranty": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "bsd-grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "cc-by-ref": ("licensed under cc by 4.0", "this work is licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"),
    "cc-by-sa-ref": ("licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license"),
    "cc-by-nc-ref": ("licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"),
    "cc0-ref": ("released under cc0 1.0", "licensed under cc0 1.0", "this work has been dedicated to the public domain"),
    "mpl-ref": ("this source code form is subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license version 2.0"),
    "lgpl21-ref": ("licensed under the gnu lesser general public license version 2.1", "spdx license identifier lgpl 2.1 only", "spdx license identifier lgpl 2.1 or later"),
    "lgpl3-ref": ("licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3.0 only", "spdx license identifier lgpl 3.0 or later"),
    "lgpl21-free": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",),
    "lgpl-warranty": ("this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "agpl3-ref": ("licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3.0 only", "spdx license identifier agpl 3.0 or later"),
    "agpl3-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "gpl2-ref": ("licensed under the gnu general public license version 2", "spdx license identifier gpl 2.0 only", "spdx license identifier gpl 2.0 or later"),
    "gpl2-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "isc-ref": ("licensed under the isc license", "released under the isc license", "spdx license identifier isc"),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "isc-warranty": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "unlicense-free": ("this is free and unencumbered software released into the public domain",),
    "unlicense-anyone": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "epl2-ref": ("licensed under the eclipse public license version 2.0", "spdx license identifier epl 2.0"),
    "epl2-free": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v. 2.0"),
    "bsd3-ref": ("licensed under the bsd 3 clause license", "spdx license identifier bsd 3 clause"),
    "bsd2-ref": ("licensed under the bsd 2 clause license", "spdx license identifier bsd 2 clause"),
    "all-rights": ("all rights reserved",),
}
#: Licence, and the identifiers in order.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-ref",)),
    ("Apache-2.0", ("apache-ref", "apache-comply", "apache-basis")),
    ("Apache-2.0", ("apache-ref",)),
    ("GPL-3.0", ("gpl-free", "gpl-warranty")),
    ("GPL-3.0", ("gpl-free",)),
    ("GPL-3.0", ("gpl3-ref",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("GPL-2.0", ("gpl2-free", "gpl-warranty")),
    ("GPL-2.0", ("gpl2-free",)),
    ("GPL-2.0", ("gpl2-ref",)),
    ("LGPL-2.1", ("lgpl21-free", "lgpl-warranty")),
    ("LGPL-2.1", ("lgpl21-free",)),
    ("LGPL-2.1", ("lgpl21-ref",)),
    ("LGPL-3.0", ("lgpl3-ref",)),
    ("AGPL-3.0", ("agpl3-free", "gpl-warranty")),
    ("AGPL-3.0", ("agpl3-free",)),
    ("AGPL-3.0", ("agpl3-ref",)),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-ref",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("EPL-2.0", ("epl2-free",)),
    ("EPL-2.0", ("epl2-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("MPL-2.0", ("mpl-ref",)),
    ("proprietary", ("all-rights",)),
)
#: A rule of the first licence that matches hides the second's.
STRONGER = (("BSD-3-Clause", "BSD-2-Clause"),)
#: Letters that stand together in every known sentence, one of these in each, so a text without any has no known sentence.
MARKERS = ("licen", "software", "permi", "copyright", "redistribution", "rights", "domain", "program", "cc0", "warranty")
#: List numbers with what comments put before them: ``1.``, ``2)``, ``(a)``, ``[3]``, ``(iv)``.
_NUMBER = "[(\\[]?(?:[0-9]{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)\\]]\\s"
_STOP = "(?<=[;:.!?])(?<!(?i:spdx-license-identifier):)"
_TAG = "(?i:spdx-license-identifier):\\s{1,4}[A-Za-z0-9.+-]{1,40}[ \\t]{0,4}"
_END = f"{_STOP}\\s++(?=[^a-z0-9]|{_NUMBER})|(?<=\\);)\\s+|[\\r\\n]++(?<={_TAG}[\\r\\n]{{1,8}})"
#: Ends of paragraphs (a line without letters and digits, or before a list number), of sentences at line ends and wide gaps, of lines, and of
#: sentences before any letter.
_BREAKS = (
    f"(?>\\r\\n?|\\n)(?:[^\\p{{L}}\\p{{N}}]*[\\n\\r]|(?=[^\\p{{L}}\\p{{N}}(\\[\\n\\r]*{_NUMBER}))",
    f"{_STOP}(?:\\s{{2,}}|[\\n\\r])",
    "[\\n\\r]+",
    f"{_STOP}(?<!\\b[vV]\\.)\\s+",
)
_CLEAN = "(?<![0-9v])\\.|\\.(?![0-9 ])|[^a-z0-9.]+|\\.$"


def normalised(sentence: Column) -> Column:
    bare = F.regexp_replace(sentence, f"^(?:[^A-Za-z0-9(\\[]*{_NUMBER}){{1,4}}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), _CLEAN, " "), " +", " "))


def _known() -> Column:
    return F.create_map(*[F.lit(x) for code, texts in SENTENCES.items() for s in texts for x in (s, code)])


def _codes(piece: Column, sizes: list[int], known: list[str], breaks: tuple[str, ...] = _BREAKS) -> Column:
    """Identifiers of a piece of text: its own if all of it is one known sentence, or else those of the pieces between its breaks."""
    # only a sentence of a known length can be known: most are dropped before the lookup
    own = F.transform(F.filter(F.array(normalised(piece)), lambda s: F.length(s).isin(*sizes) & s.isin(*known)), lambda s: F.element_at(_known(), s))
    if not breaks:
        return own
    parts = F.flatten(F.transform(F.split(piece, breaks[0]), lambda p: _codes(p, sizes, known, breaks[1:])))
    return F.when(piece.rlike("[\\n\\r;:.!?]\\s|[\\n\\r]|\\s\\s"), F.when(F.size(own) > 0, own).otherwise(parts)).otherwise(own)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licenses): identifiers in order of the text, and the distinct licences that match, sorted."""
    known = sorted(s for texts in SENTENCES.values() for s in texts)
    sizes = sorted({len(s) for s in known})
    low = F.lower("text")
    possible = low.contains(MARKERS[0])
    for m in MARKERS[1:]:
        possible = possible | low.contains(m)
    codes = F.flatten(F.transform(F.split("text", _END), lambda s: _codes(s, sizes, known)))
    found = docs.select("doc_id", F.when(possible, codes).otherwise(F.array().cast("array<string>")).alias("sentence_ids"))
    found = found.withColumn("line", F.concat(F.lit(" "), F.concat_ws(" ", "sentence_ids"), F.lit(" ")))
    hits = [F.when(F.col("line").rlike(".* ".join(f" {p}" for p in parts).replace(".*  ", "( .*)? ") + " "), name) for name, parts in RULES]
    names = F.array_sort(F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    for first, second in STRONGER:
        names = F.when(F.array_contains(names, first), F.array_remove(names, second)).otherwise(names)
    return found.select("doc_id", "sentence_ids", names.alias("licenses"))
