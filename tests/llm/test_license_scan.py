import numpy as np

from svgloom.llm import license_scan as ls
from svgloom.llm.common import table

SF = "/root/testdata/sf0.01"


def scan_texts(s, texts):
    raw = [t.encode() for t in texts]
    out = [set() for _ in texts]
    for r, line, f, p, same in s.found(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)):
        out[r].add((line, s.families[f]))
    return out


def test_planted_and_clean(spark):
    docs = table(spark, SF, "documents")
    s = ls.train(docs)
    filler = "it of the thion onre erblest hein ti inenan eranenes whou " * 12
    cases = {
        "x\nLicensed under the Apache License, Version 2.0.\ny": {(1, "Apache-2.0")},
        "RELEASED UNDER THE MIT LICENSE": {(0, "MIT")},
        filler + "This work is licensed under the GNU General Public License, version 3. " + filler: {(0, "GPL-3.0")},
        "This work is licensed under the GNU General Public License version 2": {(0, "GPL-2.0")},
        filler + "\n\nLicensed under CC BY-NC 4.0.\nAll rights reserved.": {(2, "CC-BY-NC"), (3, "All-rights-reserved")},
        "Licensed under CC BY-SA 4.0": {(0, "CC-BY-SA")},
        "He got a license to drive, version two of the general public was reserved.": set(),
        "The Apache helicopter landed under the license of the state.": set(),
        "": set(),
        filler: set(),
    }
    assert scan_texts(s, list(cases)) == list(cases.values())


def test_every_license_line_of_the_corpus_and_no_other(spark):
    # brute force: the notices of this corpus are these lines
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "All-rights-reserved"}
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    want = {i: sorted({f for x, f in lines.items() if x in (t or "")}) for i, t in texts.items()}
    got = {r.doc_id: r.families for r in ls.op6_license_scan(spark, SF).collect()}
    assert got == want and any(want.values())


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell""",
    "GPL-3.0": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.""",
    "GPL-2.0": """# This program is free software; you can redistribute it and/or
# modify it under the terms of the GNU General Public License
# as published by the Free Software Foundation; either version 2
# of the License, or (at your option) any later version.""",
    "LGPL": """// This library is free software; you can redistribute it and/or
// modify it under the terms of the GNU Lesser General Public
// License as published by the Free Software Foundation; either
// version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
}


def test_wrapped_headers_and_several_notices(spark):
    s = ls.train(table(spark, SF, "documents"))
    filler = "it of the thion onre erblest hein ti inenan eranenes whou " * 12
    for f, text in WRAPPED.items():
        got = scan_texts(s, [text, filler + "\n" + text + "\n" + filler, text + "\n\n" + filler])
        assert [{x for _, x in g} for g in got] == [{f}] * 3, (f, got)
    assert scan_texts(s, ["Licensed under the GNU General Public License v3.0", "Licensed under the GNU Lesser General Public License v2.1"]) == [{(0, "GPL-3.0")}, {(0, "LGPL")}]
    both = "Licensed under the Apache License, Version 2.0. Released under the MIT License."
    assert scan_texts(s, [both, "x\n" + both.replace("Version", "\nVersion")]) == [{(0, "Apache-2.0"), (0, "MIT")}, {(1, "Apache-2.0"), (2, "MIT")}]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "Released under the MIT License.", 2), (1, "", 3), (2, "a " * 200_000 + "\nAll rights reserved.", 4)], "doc_id long, text string, families int")
    s = ls.train(docs)
    assert sorted((r.doc_id or 0, [x.family for x in r.found]) for r in ls.scan(docs, s).collect()) == [(0, ["MIT"]), (1, []), (1, []), (2, ["All-rights-reserved"])]
    assert ls.scan(docs.limit(0), ls.train(docs.limit(0))).count() == 0


def test_more_families_in_comments(spark):
    s = ls.train(table(spark, SF, "documents"))
    epl = "/*\n * This program and the accompanying materials are\n * made available under the terms of the Eclipse Public\n * License 2.0 which is available at somewhere\n */\nint x;"
    zlib = "# This software is provided 'as-is', without any express or implied\n# warranty. In no event will the authors be held liable for any damages\n# arising from the use of this software.\n#\n# code"
    boost = "// Distributed under the Boost\n// Software License, Version 1.0.\n"
    assert [{f for _, f in x} for x in scan_texts(s, [epl, zlib, boost])] == [{"EPL-2.0"}, {"Zlib"}, {"BSL-1.0"}]


def test_the_sample_is_bounded_and_moves_no_long_text(spark):
    docs = spark.createDataFrame([(k, f"line {k} of this text\nand more") for k in range(600)] + [(1000, "x" * 30_000), (None, None)], "doc_id long, text string")
    assert ls.train(docs) is not None and ls.train(docs.limit(0)) is not None
