"""Known texts, wrapped and commented ones, rule order, odd rows."""

import pytest
from conftest_llm import make, odd_rows

from memspark.llm import licenses

BY_ID = {}
for _sentence, _id in licenses.SENTENCES.items():
    BY_ID.setdefault(_id, _sentence)


def scan(spark, texts, **kw):
    docs = make(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = licenses.scan(docs, **kw).select("doc_id", "licence_scan.*").orderBy("doc_id").collect()
    return [(r["sentence_ids"], r["licences"], r["unmatched"]) for r in got]


def test_references(spark):
    got = scan(
        spark,
        [
            "Some prose. Released under the MIT License.",
            "Line without stop\nThis work is licensed under the GNU General Public License, version 3.\nMore | text",
            "licensed UNDER  the “Apache” License, version 2.0",
            "# SPDX-License-Identifier: BSD-3-Clause",
            "All rights reserved.",
            "Copyright (c) 2020 Some Body. All rights reserved.",
            "Copyright 2020, Some Body, all rights reserved.",
            "unlicensed under the MIT License and other prose.",
        ],
    )
    assert [g[1] for g in got] == ["MIT", "GPL-3.0-only", "Apache-2.0", "BSD-3-Clause", "Proprietary", "Proprietary", "Proprietary", ""]


def test_whole_licences_and_rule_order(spark):
    mit = [BY_ID[i] for i in ("MITgrant", "MITnotice", "MITnowarranty", "MITnoliability")]
    bsd = [BY_ID[i] for i in ("BSDgrant", "BSDsource", "BSDbinary", "BSDname")]
    got = scan(spark, [" ".join(mit), "\n".join(bsd), "\n".join(bsd[:3]), "\n".join(bsd[1:]), " ".join(mit[:2]), BY_ID["MITgrant"]])
    assert [g[1] for g in got] == ["MIT", "BSD-3-Clause", "BSD-2-Clause", "", "MIT", ""]
    assert got[3][2] == "BSDbinary,BSDname,BSDsource"  # known sentences that make no licence
    assert got[5] == ("MITgrant", "", "MITgrant")


def test_wrapped_in_a_comment(spark):
    words = " ".join([BY_ID[i] for i in ("GPL3grant", "GPLnowarranty", "GPLsee", "GPLcopy")]).split()
    lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
    text = "int x;\n\n# " + "\n# ".join(lines) + "\n\nmore code"
    assert scan(spark, [text])[0][1] == "GPL-3.0-or-later"


def wrapped(ids, sign, width=9, head=()):
    """A header in a comment: lines of ``head``, then the sentences in lines of ``width`` words."""
    words = " ".join(BY_ID[i] for i in ids).split()
    lines = [*head, *(" ".join(words[i : i + width]) for i in range(0, len(words), width))]
    return "\n".join(f"{sign} {line}" if line else sign for line in lines)


HEADERS = [
    (("GPL2grant", "GPLnowarranty", "GPLsee"), "GPL-2.0-or-later"),
    (("MITgrant", "MITnotice", "MITnowarranty", "MITnoliability"), "MIT"),
    (("BSDgrant", "BSDsource", "BSDbinary", "BSDname"), "BSD-3-Clause"),
    (("ISCgrant",), "ISC"),
]


@pytest.mark.parametrize("sign", [" *", "#", "//"])
def test_headers_in_comments(spark, sign):
    """Lines with nothing but the sign part paragraphs; a notice is no part of the next sentence."""
    title, notice = "foo.c does things", "Copyright (C) 2010 J. R. Body <a.b@c.org>"
    heads = [(title, notice, ""), (title, "", notice), (notice, "All rights reserved", ""), (notice, "All rights reserved"), (notice, notice, "")]
    for width in (5, 8, 9, 11):  # a line may also begin with "copyright notice" or "copyright holders"
        texts = [wrapped(ids, sign, width, head) + f"\n{sign}\n\nint x;" for ids, _ in HEADERS for head in heads]
        want = [licence for _, licence in HEADERS for _ in heads]
        got = [set(g[1].split(",")) - {"Proprietary"} for g in scan(spark, texts)]
        assert got == [{w} for w in want]


NAMES = [
    "Neither the name of Foo Inc. nor the names of its contributors may",
    "Neither the name of the University nor the names of its contributors may",
    "Neither the name of J. R. Body nor the names of contributors may",
    "Neither the name of the <organization> nor the\nnames of its contributors may",
    "The name of the author may not",
]


def test_bsd_with_names(spark):
    rest = " be used to endorse or promote products derived from this software without specific prior written permission."
    bsd = [BY_ID[i] for i in ("BSDgrant", "BSDsource", "BSDbinary")]
    texts = ["\n".join([*bsd, name + rest]) for name in NAMES]
    texts += ["# " + "\n# ".join((" ".join(bsd) + " " + name + rest).replace(" in ", "\n# in ").split("\n")) for name in NAMES]
    assert [g[1] for g in scan(spark, texts)] == ["BSD-3-Clause"] * 10


@pytest.mark.parametrize("sign", ["", "#"])
def test_identifiers_of_wrapped_texts(spark, sign):
    """Both readings give identifiers and left-overs, in the order of the text, a sentence once."""
    parts = [HEADERS[1][0], ("MITnowarranty",), ("BSDsource", "BSDbinary"), ("MITnotice", "AllRights", "MITnotice")]
    texts = [wrapped(ids, sign) for ids in parts]
    texts.append(f"{sign} Released under the MIT License\n{sign} Copyright 2010 Some Body\n{sign} All rights reserved\n{texts[1]}\n{sign} a line\n{BY_ID['BSDgrant']}")
    texts.append("\n".join(BY_ID[i] for i in HEADERS[2][0][:3]) + "\n" + wrapped(["BSDname"], sign))
    got = scan(spark, texts)
    assert got[0] == ("MITgrant,MITnotice,MITnowarranty,MITnoliability", "MIT", "")
    assert got[1] == ("MITnowarranty", "", "MITnowarranty")
    assert got[2] == ("BSDsource,BSDbinary", "", "BSDbinary,BSDsource")
    assert got[3] == ("MITnotice,AllRights,MITnotice", "Proprietary", "MITnotice")
    assert got[4] == ("MITref,AllRights,MITnowarranty,BSDgrant", "MIT,Proprietary", "BSDgrant,MITnowarranty")
    assert got[5] == ("BSDgrant,BSDsource,BSDbinary,BSDname", "BSD-3-Clause", "")


def test_notices_keep_what_follows_in_their_line(spark):
    grant = BY_ID["ISCgrant"].split()
    texts = [
        "Copyright 2010 Some Body. " + " ".join(grant[:6]) + "\n" + " ".join(grant[6:]),
        "# Copyright 2010 The Regents of the\n# University of Somewhere, all rights\n# reserved.",
        "// Copyright 2010 Some\r\n//\r\n// " + " ".join(grant[:9]) + "\r\n// " + " ".join(grant[9:]) + "\r\n",
    ]
    assert [g[1] for g in scan(spark, texts)] == ["ISC", "Proprietary", "ISC"]


def test_several_licences(spark):
    text = "Licensed under CC BY 4.0.\nprose\nReleased under the MIT License.\nLicensed under CC BY 4.0."
    assert scan(spark, [text]) == [("CCBY4ref,MITref,CCBY4ref", "CC-BY-4.0,MIT", "")]


def test_own_tables(spark):
    known = {"Do what you like.": "free", "But not that.": "not"}
    rules = [(("free", "not"), "Mostly-Free"), (("free",), "Free")]
    got = scan(spark, ["Do what you like. But not that!", "Do what you like.", "But not that."], sentences=known, rules=rules)
    assert [g[1] for g in got] == ["Mostly-Free", "Free", ""]


def test_odd_rows(spark, odd, empty):
    got = licenses.scan(odd)
    assert got.columns == [*odd.columns, "licence_scan"]
    assert got.filter("licence_scan.licences = '' AND licence_scan.sentence_ids = ''").count() == len(odd_rows())
    assert licenses.scan(empty).count() == 0


def test_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_time_grows_with_the_text(spark):
    """One long line or sentence with very many notices, and many lines of them."""
    import time

    texts = ["see copyright of me " * 50_000, "copyright a. " * 50_000, "(c) 2010 x\n" * 50_000, "rights reserved " * 50_000, "copyright x " * 50_000 + "all rights reserved"]
    took = []
    for part in (10, 1):
        rows = spark.createDataFrame([(i, t[: len(t) // part] + "\nAll rights reserved") for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
        began = time.time()
        licenses.scan(rows).collect()
        took.append(time.time() - began)
    assert took[1] < 30 and took[1] < 40 * max(took[0], 0.5)
