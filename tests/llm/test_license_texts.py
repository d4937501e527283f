"""Whole license texts give their label and no other; of equal intervals the first rule stays."""

from quern.llm import license_scan

_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, subject to the following conditions:\n\n"
_NOTICE = "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n"
_BSD = "Copyright (c) 2020, Jane\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright\n   notice, this list of conditions and the following disclaimer.\n"
_BINARY = "2. Redistributions in binary form must reproduce the above copyright\n   notice in the documentation.\n"
_NAMES = "Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from this software.\n"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"
TEXTS = {
    "mit": _MIT + _NOTICE + _NO_WARRANTY,
    "x11": _MIT + _NOTICE + _NO_WARRANTY + "\nExcept as contained in this notice, the name of the copyright holders shall not be used in advertising.",
    "ncsa": _MIT + "Redistributions of source code must retain the notice.\nRedistributions in binary form must too.\nNeither the names of X, nor the names of its contributors may be used to endorse or promote products.\n" + _NO_WARRANTY,
    "bsd-2-clause": _BSD + _BINARY + _NO_WARRANTY,
    "bsd-3-clause": _BSD + _BINARY + "3. " + _NAMES + _NO_WARRANTY,
    "bsd-4-clause": _BSD + _BINARY + "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement: X.\n4. " + _NAMES + _NO_WARRANTY,
    "bsd-source-code": _BSD + _NO_WARRANTY,
    "isc": _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _NO_WARRANTY,
    "0bsd": _ISC + '.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES',
    "ntp": "Permission to use, copy, modify, and distribute this software and its\ndocumentation for any purpose with or without fee is hereby granted.",
    "hpnd": "Permission to use, copy, modify and distribute this software and its\ndocumentation for any purpose is hereby granted without fee.",
    "postgresql": "Permission to use, copy, modify, and distribute this software and its\ndocumentation for any purpose, without fee, and without a written agreement is hereby granted.",
    "unlicense": "This is free and unencumbered software released into the public domain.\nIn jurisdictions that recognize copyright laws, the author or authors\nof this software dedicate any interest.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty.\n1. The origin of this software must not be misrepresented; you must not\nclaim that you wrote it.",
    "openssl": "This product includes software developed by the OpenSSL Project for use in the toolkit.",
    "json": "The Software shall be used for Good, not Evil.",
    "wtfpl": "0. You just DO WHAT THE FUCK YOU WANT TO.",
    "apache,apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\ndistributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND',
    "gpl,gpl-2.0-or-later": "redistribute it under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
    "llama": "Llama 3.1 is licensed under the Llama 3.1 Community License, Copyright X",
}


def test_whole_texts(spark):
    rows = [(k, text, label) for k, (label, text) in enumerate(TEXTS.items())]
    found = license_scan.license_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    got = {r["doc_id"]: r["labels"] for r in found.collect()}
    assert {label: got[k] for k, _, label in rows} == {label: label for _, _, label in rows}


def test_labels_are_words_not_keywords():
    assert all(label == label.lower() and " " not in label for _, label, *_ in license_scan.rules())


def plain(text, k):
    """Detections by comparing every two."""
    import re

    low = text.lower()
    found = []
    for rule, label, word, pattern, priority, weight in license_scan.rules():
        if word in low:
            python = pattern.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff")
            found += [(k, rule, label, *m.span(), priority, weight) for m in re.finditer(python, low)]
    first = {}
    for x in sorted(found, key=lambda x: x[1]):
        first.setdefault((x[3], x[4], x[5]), x)
    held = list(first.values())
    inside = lambda a, b: b[3] <= a[3] and a[4] <= b[4] and (b[5] > a[5] or (b[5] == a[5] and b[4] - b[3] > a[4] - a[3]))
    return sorted(x[:5] for x in held if not any(inside(x, y) for y in held))


def test_suppression_against_all_pairs(spark):
    from pyspark.sql import functions as F

    texts = [*TEXTS.values(), " ".join(TEXTS.values()), "gpl v2 gpl-2.0 license, SPDX-License-Identifier: GPL-2.0 mit license MIT License https://opensource.org/licenses/MIT", "cc by-sa 4.0 cc-by cc by"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", license_scan.lowered(F.col("text")).alias("t")).withColumn("words", license_scan.keywords(F.col("t")))
    got = sorted((r["k"], r["rule"], r["label"], r["start"], r["end"]) for r in license_scan.detections(rows).collect())
    assert got == sorted(x for k, t in enumerate(texts) for x in plain(t, k))
