"""License scans: sentences to known identifiers, sequences of identifiers to licences.

The lines of each paragraph are joined (licence texts are often wrapped) and split into sentences. Sentences are
normalised: only letters a-z, digits and single spaces are left, so quotes, dashes and comment signs play no part. A normalised
sentence that is known gives its identifier; one that is not is read again line by line, so identifiers of both
readings stand in the order of the text; a holder's name after "copyright" or in the BSD clause
about names does not matter. Then the ordered rules run over the identifiers: each rule is a sequence; wherever it
stands, it is taken out as its licence, and later rules see what is left. Identifiers that no rule
takes are reported as unmatched.

All of it is one projection of built-in expressions: no shuffle, no join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.bind import let

# Known sentences as they are usually written, with their identifiers.
SENTENCES: dict[str, str] = {
    # references to a licence
    "Released under the MIT License.": "MITref",
    "Licensed under the MIT License.": "MITref",
    "This project is licensed under the MIT License.": "MITref",
    "Distributed under the MIT License.": "MITref",
    "SPDX-License-Identifier: MIT": "MITref",
    "Licensed under the Apache License, Version 2.0.": "Apache2ref",
    'Licensed under the Apache License, Version 2.0 (the "License")': "Apache2ref",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "Apache2ref",
    "Released under the Apache License, Version 2.0.": "Apache2ref",
    "SPDX-License-Identifier: Apache-2.0": "Apache2ref",
    "This work is licensed under the GNU General Public License, version 3.": "GPL3ref",
    "Licensed under the GNU General Public License, version 3.": "GPL3ref",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL3ref",
    "SPDX-License-Identifier: GPL-3.0-or-later": "GPL3plusref",
    "This work is licensed under the GNU General Public License, version 2.": "GPL2ref",
    "Licensed under the GNU General Public License, version 2.": "GPL2ref",
    "SPDX-License-Identifier: GPL-2.0-only": "GPL2ref",
    "SPDX-License-Identifier: GPL-2.0-or-later": "GPL2plusref",
    "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL3ref",
    "Licensed under the GNU Affero General Public License, version 3.": "AGPL3ref",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL2ref",
    "SPDX-License-Identifier: MPL-2.0": "MPL2ref",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD3ref",
    "SPDX-License-Identifier: BSD-2-Clause": "BSD2ref",
    "Licensed under the BSD License.": "BSDref",
    "Licensed under CC BY-NC 4.0.": "CCBYNC4ref",
    "Licensed under CC BY 4.0.": "CCBY4ref",
    "Licensed under CC BY-SA 4.0.": "CCBYSA4ref",
    "Licensed under CC BY-ND 4.0.": "CCBYND4ref",
    "Licensed under CC BY-NC-SA 4.0.": "CCBYNCSA4ref",
    "Licensed under CC0 1.0.": "CC0ref",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CCBY4ref",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CCBYNC4ref",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CCBYSA4ref",
    # sentences of licence texts
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:": "MITgrant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "MITnotice",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.": "MITnowarranty",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.": "MITnoliability",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISCgrant",
    "You may obtain a copy of the License at": "Apache2copy",
    "http://www.apache.org/licenses/LICENSE-2.0": "Apache2link",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.": "Apache2nowarranty",
    "See the License for the specific language governing permissions and limitations under the License.": "Apache2see",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "GPL3grant",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "GPL2grant",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "GPLnowarranty",
    "See the GNU General Public License for more details.": "GPLsee",
    "You should have received a copy of the GNU General Public License along with this program.": "GPLcopy",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSDgrant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "BSDsource",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "BSDbinary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSDname",
    "This is free and unencumbered software released into the public domain.": "Unlicense1",
    "All rights reserved.": "AllRights",
}

# Ordered rules; the first ones are tried first.
RULES: list[tuple[tuple[str, ...], str]] = [
    (("MITgrant", "MITnotice", "MITnowarranty", "MITnoliability"), "MIT"),
    (("BSDgrant", "BSDsource", "BSDbinary", "BSDname"), "BSD-3-Clause"),
    (("BSDgrant", "BSDsource", "BSDbinary"), "BSD-2-Clause"),
    (("Apache2ref", "Apache2copy", "Apache2link", "Apache2nowarranty", "Apache2see"), "Apache-2.0"),
    (("GPL3grant", "GPLnowarranty", "GPLsee", "GPLcopy"), "GPL-3.0-or-later"),
    (("GPL3grant", "GPLnowarranty", "GPLsee"), "GPL-3.0-or-later"),
    (("GPL2grant", "GPLnowarranty", "GPLsee", "GPLcopy"), "GPL-2.0-or-later"),
    (("GPL2grant", "GPLnowarranty", "GPLsee"), "GPL-2.0-or-later"),
    (("MITgrant", "MITnotice"), "MIT"),
    (("GPL3grant",), "GPL-3.0-or-later"),
    (("GPL2grant",), "GPL-2.0-or-later"),
    (("ISCgrant",), "ISC"),
    (("Unlicense1",), "Unlicense"),
    (("MITref",), "MIT"),
    (("Apache2ref",), "Apache-2.0"),
    (("GPL3plusref",), "GPL-3.0-or-later"),
    (("GPL3ref",), "GPL-3.0-only"),
    (("GPL2plusref",), "GPL-2.0-or-later"),
    (("GPL2ref",), "GPL-2.0-only"),
    (("LGPL3ref",), "LGPL-3.0-only"),
    (("AGPL3ref",), "AGPL-3.0-only"),
    (("MPL2ref",), "MPL-2.0"),
    (("BSD3ref",), "BSD-3-Clause"),
    (("BSD2ref",), "BSD-2-Clause"),
    (("BSDref",), "BSD"),
    (("CCBYNCSA4ref",), "CC-BY-NC-SA-4.0"),
    (("CCBYNC4ref",), "CC-BY-NC-4.0"),
    (("CCBYND4ref",), "CC-BY-ND-4.0"),
    (("CCBYSA4ref",), "CC-BY-SA-4.0"),
    (("CCBY4ref",), "CC-BY-4.0"),
    (("CC0ref",), "CC0-1.0"),
    (("AllRights",), "Proprietary"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END, JOINT = "\u0001", "\u0002"  # of a sentence, between two lines of one
NOTICE = "\u0003"  # before a copyright notice
LEAD = r"(conditions|are met):"  # a colon that ends a sentence
STOP = r"[.!?]+"
SPACE = r"[ \t\n\x0B\f\r]"
PARAGRAPH = rf"\n[ \t]*\n{SPACE}*"  # an empty line
WRAP = r"\n[ \t#*/;-]*"  # a line break with the comment signs after it
EMPTY = r"\n[ \t\r#*/;-]*\n[ \t\n\x0B\f\r#*/;-]*"  # PARAGRAPH, also with comment signs in the line and after it
RESERVED = r"(?i)(\brights[^A-Za-z0-9]+reserved\b[^A-Za-z0-9\n]*)\n"  # a line that ends so
HOLDER = r"(?:^| )copyright [^\n]*? all rights reserved$"  # of a normalised sentence
# The clause about names, whoever is named, by its tail: a stop in the name ends a sentence.
NAMED = r"(?:^| )may (?:not )?be used to endorse or promote products derived from this software without (?:specific )?prior written permission$"


def normalised(sentence: str) -> str:
    """A known sentence by the rule of ``_sentences``; of one with inner stops the longest part."""
    lowered = re.sub(LEAD, r"\1.", sentence.translate(str.maketrans(UPPER, LOWER)))
    parts = re.split(rf"{STOP}({SPACE})", lowered)
    return max((" ".join(re.sub(r"[^a-z0-9]+", " ", part).split()) for part in parts), key=len)


def _any(words: set[str]) -> str:
    return "(?:" + "|".join(sorted(map(re.escape, words)) or ["(?!)"]) + ")"


def _notices(text: Column, known: dict[str, str]) -> Column:
    """``text`` with END instead of the break after each line that holds a copyright notice.

    A notice is not one that a known sentence may run through ("the copyright holders", or its beginning after a stop), nor
    one that goes on to "rights reserved". Notices are marked first, then each line is looked at from its last
    stop before the beginning of a known sentence on, so the time grows with the text alone.
    """
    inner = _any({word for s in known for word in re.findall(r"\bcopyright ([a-z0-9]+)", s)})
    first = _any({s.split(" ")[0] for s in known})
    begins = rf"(\bcopyright\b(?![^A-Za-z0-9]*{inner}\b)|©|\(c\)[ \t]*[12][0-9]{{3}})"
    reserved = r"[^.!?]{0,400}\brights[^A-Za-z0-9]+reserved\b"
    marked = F.regexp_replace(text, rf"(?i){begins}(?!{reserved})", f"{NOTICE}$1")

    def closed(line: Column) -> Column:
        rest = F.regexp_replace(line, rf"(?i)^.*[.!?](?=[ \t]+[^A-Za-z0-9]*{first}\b)", "")
        return F.when(F.contains(rest, F.lit(NOTICE)), F.concat(line, F.lit(END))).otherwise(F.concat(line, F.lit("\n")))

    def by_lines(marked: Column) -> Column:
        # the text after the last break has no break behind it
        lines = F.split(marked, "\n", -1)
        all_but_last = let(lines, lambda ls: F.concat(F.array_join(F.transform(F.slice(ls, 1, F.size(ls) - 1), closed), ""), F.element_at(ls, -1)))
        return F.when(F.contains(marked, F.lit(NOTICE)), F.translate(all_but_last, NOTICE, "")).otherwise(marked)

    return let(marked, by_lines)


def _sentences(text: Column, known: dict[str, str]) -> Column:
    """Normalised sentences in order, the lines of each joined by JOINT. A sentence ends at the end of a paragraph, at . ! or ?
    before white space, or at a colon by LEAD; a notice of the holder is a paragraph of its own."""
    text = F.translate(text, UPPER + END + JOINT + NOTICE, LOWER + "   ")
    text = F.regexp_replace(_notices(text, known), RESERVED, "$1" + END)
    joined = F.regexp_replace(F.regexp_replace(text, EMPTY, END), WRAP, " " + JOINT)
    lead = LEAD.replace(" ", f"[ {JOINT}]+")
    split = F.regexp_replace(F.regexp_replace(joined, lead, "$1. "), rf"{STOP}{SPACE}", END)
    plain = F.regexp_replace(split, f"[^a-z0-9{END}{JOINT}]+", " ")
    lines = F.regexp_replace(plain, f"[ {JOINT}]*{JOINT}[ {JOINT}]*", JOINT)
    tidy = F.regexp_replace(lines, f"[ {JOINT}]?{END}[ {END}{JOINT}]*", END)
    return F.split(F.btrim(tidy, F.lit(f" {END}{JOINT}")), END)


def _identifiers(sentences: Column, known: dict[str, str]) -> Column:
    """Identifiers of the known sentences, each between two bars: |a||b|. One that is not known as a
    whole gives those of its lines, and that of a pattern it ends in."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    tail = " all rights reserved"
    patterns = {
        # HOLDER, asked from its end, as the time of the pattern grows with the square of the number of its first words
        "AllRights": lambda s: F.endswith(s, F.lit(tail)) & F.rlike(F.left(s, F.char_length(s) - len(tail)), F.lit("(?:^| )copyright ")),
        "BSDname": lambda s: F.rlike(s, F.lit(NAMED)),
    }

    def exact(sentence: Column) -> Column:
        return F.concat(F.lit("|"), F.try_element_at(table, sentence), F.lit("|"))

    def by_pattern(sentence: Column) -> Column:
        own = [F.when(fits(sentence), f"|{i}|") for i, fits in patterns.items() if i in known.values()]
        return F.coalesce(*own, F.lit(""))

    def by_lines(sentence: Column) -> Column:
        inner = F.transform(F.split(sentence, JOINT), lambda line: F.coalesce(exact(line), by_pattern(line)))
        whole = by_pattern(F.translate(sentence, JOINT, " "))
        return let(F.concat_ws("", inner), lambda a: let(whole, lambda b: F.when(F.endswith(a, b), a).otherwise(F.concat(a, b))))

    def one(sentence: Column) -> Column:
        several = F.when(F.contains(sentence, F.lit(JOINT)), by_lines(sentence))
        return F.coalesce(exact(F.translate(sentence, JOINT, " ")), several, by_pattern(sentence))

    return F.concat_ws("", F.transform(sentences, one))


def _matched(ids: Column, rules: list[tuple[tuple[str, ...], str]]) -> Column:
    """Identifiers with the sequences of the rules replaced by <licence>, one rule after the other."""
    for sequence, licence in rules:
        ids = F.replace(ids, F.lit("".join(f"|{i}|" for i in sequence)), F.lit(f"<{licence}>"))
    return ids


def scan(
    docs: DataFrame,
    sentences: dict[str, str] = SENTENCES,
    rules: list[tuple[tuple[str, ...], str]] = RULES,
    into: str = "licence_scan",
) -> DataFrame:
    """``docs`` with a struct ``into``: sentence_ids (in order), licences and unmatched
    (identifiers that no rule takes; both sorted, each once), as texts joined by commas.

    A null or empty text has no sentences and gives empty strings. Rows are worked on one by one: ids and
    repeated rows play no part.
    """
    known = {normalised(s): i for s, i in sentences.items()}
    text = F.coalesce(F.col("text"), F.lit(""))

    def facts(ids: Column, matched: Column) -> Column:
        licences = F.array_sort(F.array_distinct(F.regexp_extract_all(matched, F.lit("<([^>]*)>"), 1)))
        left = F.array_sort(F.array_distinct(F.regexp_extract_all(matched, F.lit(r"\|([^|]*)\|"), 1)))
        return F.struct(
            F.array_join(F.regexp_extract_all(ids, F.lit(r"\|([^|]*)\|"), 1), ",").alias("sentence_ids"),
            F.array_join(licences, ",").alias("licences"),
            F.array_join(left, ",").alias("unmatched"),
        )

    found = let(_identifiers(_sentences(text, known), known), lambda ids: let(_matched(ids, rules), lambda m: facts(ids, m)))
    return docs.withColumn(into, found)
