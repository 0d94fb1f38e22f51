"""Licence scans: sentences become identifiers of known licence sentences; their sequences are matched to ordered rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.words import map_batches

#: Lower-cases A-Z; any byte that is no ASCII letter or digit becomes a space.
FOLD = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def normalise(sentence: bytes) -> bytes:
    """ASCII letters and digits in lower case, with one space for anything between."""
    return b" ".join(sentence.translate(FOLD).split())


#: Known licence sentences by identifier, as normalised text.
SENTENCES = {
    "apache2_ref": "licensed under the apache license version 2 0",
    "apache2_use": "licensed under the apache license version 2 0 the license",
    "apache2_comply": "you may not use this file except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license at",
    "apache2_asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2_see": "see the license for the specific language governing permissions and limitations under the license",
    "mit_ref": "released under the mit license",
    "mit_under": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit_liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd3_ref": "licensed under the bsd 3 clause license",
    "bsd2_ref": "licensed under the bsd 2 clause license",
    "gpl3_ref": "this work is licensed under the gnu general public license version 3",
    "gpl2_ref": "this work is licensed under the gnu general public license version 2",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_program": "this program is free software",
    "gpl_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl3_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl3_later": "either version 3 of the license or at your option any later version",
    "gpl2_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2_later": "either version 2 of the license or at your option any later version",
    "gpl_useful": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl_implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_details": "see the gnu general public license for more details",
    "mpl2_ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2_form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2_copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "ccby4_ref": "licensed under cc by 4 0",
    "ccbysa4_ref": "licensed under cc by sa 4 0",
    "ccbync4_ref": "licensed under cc by nc 4 0",
    "cc0_ref": "released under cc0 1 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense_do": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "lgpl_library": "this library is free software",
    "lgpl21_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl21_later": "either version 2 1 of the license or at your option any later version",
    "lgpl_useful": "this library is distributed in the hope that it will be useful but without any warranty",
    "lgpl_details": "see the gnu lesser general public license for more details",
    "agpl3_terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl_terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "agpl_details": "see the gnu affero general public license for more details",
    "mpl2_full": "this source code form is subject to the terms of the mozilla public license version 2 0",
    "epl2_made": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl2_v": "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0",
    "epl1_made": "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "boost_ref": "distributed under the boost software license version 1 0",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib_asis": "this software is provided as is without any express or implied warranty",
    "zlib_liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib_origin": "the origin of this software must not be misrepresented",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "wtfpl_do": "you just do what the fuck you want to",
    "bsd0_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "cc0_dedicate": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "ccby4_full": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4_full": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync4_full": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "apache2_plain": "licensed under the apache license 2 0",
    "title_mit": "mit license",
    "title_the_mit": "the mit license",
    "title_isc": "isc license",
    "title_bsd2": "bsd 2 clause license",
    "title_bsd3": "bsd 3 clause license",
    "title_apache": "apache license version 2 0 january 2004",
    "title_gpl3": "gnu general public license version 3 29 june 2007",
    "title_gpl2": "gnu general public license version 2 june 1991",
    "title_lgpl21": "gnu lesser general public license version 2 1 february 1999",
    "title_lgpl3": "gnu lesser general public license version 3 29 june 2007",
    "title_agpl3": "gnu affero general public license version 3 19 november 2007",
    "title_mpl2": "mozilla public license version 2 0",
    "title_epl2": "eclipse public license v 2 0",
    "title_boost": "boost software license version 1 0 august 17th 2003",
    "spdx": "spdx license identifier",
    "reserved": "all rights reserved",
}
#: Licence identifiers that follow the words of an SPDX line, normalised; a comment's end may follow.
SPDX = (
    "Apache-2.0", "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-1.0", "EPL-2.0",
    "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "WTFPL", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0",
)
SENTENCES |= {f"spdx {x}": normalise(x.encode()).decode() for x in SPDX}
#: The pieces in which real GPL notices come, as sentences end at ; and : too: with and without the opening words and the warranty.
_GPL = tuple(
    (f"GPL-{v}.0-or-later", (*opening, *terms, *warranty))
    for opening in (("gpl_program",), ())
    for warranty in (("gpl_useful", "gpl_implied", "gpl_details"), ())
    for v in (3, 2)
    for terms in ((f"gpl{v}_terms",), ("gpl_terms", f"gpl{v}_later"))
)
#: Licence rules in the order in which they are tried: the licence and the identifiers that must follow one another.
RULES = (
    ("Apache-2.0", ("apache2_use", "apache2_comply", "apache2_copy", "apache2_asis", "apache2_see")),
    ("Apache-2.0", ("apache2_use", "apache2_comply")),
    ("MIT", ("mit_grant", "mit_notice", "mit_asis", "mit_liable")),
    ("MIT", ("mit_grant", "mit_notice", "mit_asis")),
    ("ISC", ("isc_grant", "isc_asis")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_asis")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_asis")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope", "gpl_details")),
    ("GPL-2.0-or-later", ("gpl2_free", "gpl_hope", "gpl_details")),
    ("GPL-3.0-or-later", ("gpl_free",)),
    ("GPL-2.0-or-later", ("gpl2_free",)),
    *_GPL,
    *((f"{name}-or-later", (*opening, *terms, *warranty))
      for opening in (("lgpl_library",), ("gpl_program",), ())
      for warranty in (("lgpl_useful", "gpl_implied", "lgpl_details"), ("gpl_useful", "gpl_implied", "lgpl_details"), ("gpl_useful", "gpl_implied", "agpl_details"), ())
      for name, terms in (("LGPL-2.1", ("lgpl21_terms",)), ("LGPL-2.1", ("lgpl_terms", "lgpl21_later")), ("LGPL-3.0", ("lgpl3_terms",)), ("LGPL-3.0", ("lgpl_terms", "gpl3_later")),
                          ("AGPL-3.0", ("agpl3_terms",)), ("AGPL-3.0", ("agpl_terms", "gpl3_later")))),
    *((x, ("spdx", f"spdx {x}")) for x in SPDX),
    ("MPL-2.0", ("mpl2_full", "mpl2_copy")),
    ("MPL-2.0", ("mpl2_full",)),
    ("MPL-2.0", ("mpl2_ref", "mpl2_copy")),
    ("MPL-2.0", ("mpl2_ref",)),
    ("MPL-2.0", ("mpl2_form", "mpl2_copy")),
    ("MPL-2.0", ("mpl2_form",)),
    ("Apache-2.0", ("apache2_use",)),
    ("Apache-2.0", ("apache2_ref",)),
    ("MIT", ("mit_ref",)),
    ("MIT", ("mit_under",)),
    ("BSD-3-Clause", ("bsd3_ref",)),
    ("BSD-2-Clause", ("bsd2_ref",)),
    ("GPL-3.0", ("gpl3_ref",)),
    ("GPL-2.0", ("gpl2_ref",)),
    ("CC-BY-4.0", ("ccby4_ref",)),
    ("CC-BY-SA-4.0", ("ccbysa4_ref",)),
    ("CC-BY-NC-4.0", ("ccbync4_ref",)),
    ("CC0-1.0", ("cc0_ref",)),
    ("Unlicense", ("unlicense", "unlicense_do")),
    ("Unlicense", ("unlicense",)),
    ("EPL-2.0", ("epl2_made",)),
    ("EPL-2.0", ("epl2_v",)),
    ("EPL-1.0", ("epl1_made",)),
    ("BSL-1.0", ("title_boost", "boost_grant")),
    ("BSL-1.0", ("boost_grant",)),
    ("BSL-1.0", ("boost_ref",)),
    ("Zlib", ("zlib_asis", "zlib_liable", "zlib_grant")),
    ("Zlib", ("zlib_asis", "zlib_liable")),
    ("Zlib", ("zlib_grant", "zlib_origin")),
    ("WTFPL", ("wtfpl",)),
    ("WTFPL", ("wtfpl_do",)),
    ("0BSD", ("bsd0_grant", "isc_asis")),
    ("CC0-1.0", ("cc0_dedicate",)),
    ("CC-BY-4.0", ("ccby4_full",)),
    ("CC-BY-SA-4.0", ("ccbysa4_full",)),
    ("CC-BY-NC-4.0", ("ccbync4_full",)),
    ("Apache-2.0", ("apache2_plain",)),
    ("MIT", ("title_mit",)),
    ("MIT", ("title_the_mit",)),
    ("ISC", ("title_isc",)),
    ("BSD-2-Clause", ("title_bsd2",)),
    ("BSD-3-Clause", ("title_bsd3",)),
    ("Apache-2.0", ("title_apache",)),
    ("GPL-3.0", ("title_gpl3",)),
    ("GPL-2.0", ("title_gpl2",)),
    ("LGPL-2.1", ("title_lgpl21",)),
    ("LGPL-3.0", ("title_lgpl3",)),
    ("AGPL-3.0", ("title_agpl3",)),
    ("MPL-2.0", ("title_mpl2",)),
    ("EPL-2.0", ("title_epl2",)),
)
#: A sentence ends at . ; : ! or ? before white space or the end, and at a blank line. Each mark is looked at once.
SENTENCE_END = re.compile(rb"(?<![.;:!?])[.;:!?]++(?=[ \t\r\n]|\Z)|\n[ \t\r]*+\n")
#: Positions from one sentence of a rule to the next at most: one unknown sentence may lie between.
GAP = 2

Match = tuple[str, int, int]


class Recogniser:
    """Sentences to identifiers, and identifier sequences to licences."""

    def __init__(self, sentences: dict[str, str] | None = None, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> None:
        known = SENTENCES if sentences is None else sentences
        self.identifier = {normalise(text.encode()): name for name, text in known.items()}
        self.by_first: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
        for licence, names in rules:
            self.by_first.setdefault(names[0], []).append((licence, names))

    def identifiers(self, text: str | None) -> tuple[int, list[tuple[int, str]]]:
        """Number of sentences, and (position, identifier) of those that are known.

        A sentence that isn't known as a whole is read line by line too, as notices often stand on a line of their
        own under text without a full stop; its known lines have its position. What names a licence in an SPDX line counts
        right after the words of one only.
        """
        found, n = [], 0
        for part in SENTENCE_END.split((text or "").encode("utf-8", "surrogatepass")):
            if not part.strip():
                continue
            name = self.identifier.get(normalise(part))
            if name:
                names = [name]
            else:
                names = [self.identifier[line] for line in map(normalise, part.split(b"\n")) if line in self.identifier] if b"\n" in part else []
            for name in names:
                if name[:5] != "spdx " or found and found[-1] == (n - 1, "spdx"):
                    found.append((n, name))
            n += 1
        return n, found

    def licences(self, found: list[tuple[int, str]]) -> list[Match]:
        """(licence, first and last position) of the rules that match, left to right; the first rule that fits wins.

        The sentences of a rule follow one another among the known ones, with at most one unknown one between two.
        """
        out, i = [], 0
        while i < len(found):
            for licence, names in self.by_first.get(found[i][1], ()):
                run = found[i : i + len(names)]
                if tuple(name for _, name in run) == names and all(b - a <= GAP for (a, _), (b, _) in zip(run, run[1:])):
                    out.append((licence, run[0][0], run[-1][0]))
                    i += len(names)
                    break
            else:
                i += 1
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recogniser: Recogniser | None = None) -> DataFrame:
    """id, n_sentences, identifiers (position, name), matches (licence, first, last): one row for each row of docs.

    One pass over the whole texts, however long, in time linear in them; no shuffle. Null, empty and blank texts have no
    sentences; of rules that fit at one place the first one listed wins; repeated rows and ids keep a row each; an empty
    table gives no rows; other columns of docs, whatever their names, are not read.
    """
    engine = recogniser or Recogniser()
    ids = pa.list_(pa.struct([("position", pa.int64()), ("name", pa.string())]))
    matches = pa.list_(pa.struct([("licence", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, known, licences = [], [], []
            for text in batch.column(1):
                count, found = engine.identifiers(text.as_py())
                n.append(count)
                known.append([{"position": p, "name": x} for p, x in found])
                licences.append([{"licence": x, "first": a, "last": b} for x, a, b in engine.licences(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(known, ids), pa.array(licences, matches)], ["id", "n_sentences", "identifiers", "matches"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, 
        run, "id long, n_sentences long, identifiers array<struct<position:long,name:string>>, matches array<struct<licence:string,first:long,last:long>>"
    )
