"""Licence scans on given texts and against a plain version on the driver's rows."""

import re

import pytest

from weftgraph.llm import licenses as lic

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in it.
The above copyright notice and this permission notice shall be included in all copies.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD = """# Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
# 1. Redistributions of source code must retain the above copyright notice.
# 2. Redistributions in binary form must reproduce the above copyright notice.
"""
GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    ("text", "names", "rest"),
    [
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"], []), ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3"], []), ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"], []),
        ("Released under the MIT License.", ["MIT"], []), ("All rights reserved.", ["All-Rights-Reserved"], []), (f"Copyright (c) 2020 A. B.\n\n{MIT}", ["MIT"], []), (BSD, ["BSD-2-Clause"], []),
        (BSD + "# 3. Neither the name of X nor the names of its contributors may be used to endorse or promote products.\n", ["BSD-3-Clause"], []), (GPL, ["GPL-2+"], []),
        ("// SPDX-License-Identifier: MPL-2.0", ["MPL-2.0"], []), ("The software is provided as is without warranty.", [], ["as_is"]), ("A fine day. Nothing is licensed here; the licence plate is old.", [], []),
        ("Released under the MIT License. Text between.\nLicensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"], []), ("", [], []), (" \n\n ", [], []), ("x" * 200_000 + " license", [], []),
        ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA-4.0"], []), ("Licensed under the GNU Lesser General Public License v2.1 or later.", ["LGPL-2.1+"], []),
    ],
)
def test_scan(text, names, rest):
    _, _, found, left = lic.scan(text)
    assert [n for n, *_ in found] == names and left == rest


def test_places():
    n, ids, found, _ = lic.scan("One. Two.\nReleased under the MIT License.\nThree!")
    assert (n, ids, found) == (4, ["mit_name"], [("MIT", 2, 2)])


def test_query(spark, docs, hard, empty):
    plain = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "All-Rights-Reserved"}
    got = {r.doc_id: [x.rsplit(":", 2)[0] for x in r.licenses.split(",") if x] for r in lic.licences(docs).collect()}
    pattern = re.compile("|".join(map(re.escape, plain)))
    assert got == {r.doc_id: [plain[m] for m in pattern.findall(r.text or "")] for r in docs.collect()}
    assert lic.licences(hard).count() == 15 and lic.licences(hard).where("licenses <> ''").count() == 0 and lic.licences(empty).count() == 0


WRAPPED_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM.
"""
WRAPPED_BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright
 *    notice, this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above
 *    copyright notice, this list of conditions.
 * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products.
"""
WRAPPED_GPL = """# This program is free software; you can redistribute it and/or
# modify it under the terms of the GNU {kind}General Public
# License as published by the Free Software Foundation; either
# version {v} of the License, or (at your option) any later
# version.
"""


@pytest.mark.parametrize(
    ("text", "names"),
    [
        (WRAPPED_MIT, ["MIT"]), ("".join(f"// {x}\n" for x in WRAPPED_MIT.split("\n")), ["MIT"]), (f"/*\n{WRAPPED_BSD} */\n", ["BSD-3-Clause"]),
        (WRAPPED_GPL.format(kind="", v=2), ["GPL-2+"]), (WRAPPED_GPL.format(kind="Lesser ", v="2.1"), ["LGPL-2.1+"]), (WRAPPED_GPL.format(kind="Affero ", v=3), ["AGPL-3+"]),
        ("".join(f"{x[3:].replace('1.', '  *').replace('2.', '  *')}\n" for x in WRAPPED_BSD.split("\n")[:7]), ["BSD-2-Clause"]),
        ("Licensed under the Apache License,\nVersion 2.0 (the License);\nyou may not use this file except in\ncompliance with the License.", ["Apache-2.0"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at x.", ["MPL-2.0"]),
        ("some words\nReleased under the MIT License\nLicensed under the Apache License, Version 2.0\nmore", ["MIT", "Apache-2.0"]),
        ("Licensed under the Apache License\n3 files changed", ["Apache"]), ("# Permission is hereby granted free of charge to any person obtaining a copy\nof this software", []),
    ],
)
def test_wrapped(text, names):
    assert [n for n, *_ in lic.scan(text)[2]] == names


def whole(name: str, rng) -> str:
    """A known sentence in full, its gaps filled."""
    text = lic.TEXTS[name]
    by, _, rest = text.rpartition("|")
    fill = lambda m: rng.choice(m[1].split("|")) if m[1] else rng.choice(["Jane Doe", "The Example Project and its contributors", "X"])
    return re.sub(r"<([^<>]*)>", fill, by) + rest


def plain_ids(text: str) -> list[str]:
    """Known sentences of a text, found without lines, tables or keys: at each word the longest sentence that begins there."""
    lines = [re.sub(r"^\s*(?:/\*|\*/|//|#|\*|--|;)?\s*", "", x) for x in text.split("\n")]
    words = lic.normalise(" ".join(lines)).split()
    known = {(name, p.pattern): p for found in lic.KNOWN.values() for name, p in found}
    length = {name: len(t.rpartition("|")[0]) for name, t in lic.TEXTS.items()}
    out, k = [], 0
    while k < len(words):
        rest = " ".join(words[k:])
        hits = sorted((-length[name], name, m.end()) for (name, _), p in known.items() if (m := p.match(rest)))
        if hits:
            out.append(hits[0][1])
            k += len(rest[: hits[0][2]].split())
        else:
            k += 1
    return out


@pytest.mark.parametrize("seed", range(40))
def test_known_sentences_against_a_plain_search(seed):
    """Sentences in any order, wrapped at any width, in comments, some cut off after what they are known by."""
    import random
    import textwrap

    rng = random.Random(seed)
    names = [rng.choice(sorted(set(lic.TEXTS) - {"wtfpl_copy"})) for _ in range(8)]
    parts = []
    for name in names:
        text = whole(name, rng)
        if rng.random() < 0.3:  # only what it is known by
            text = text[: len(re.sub(r"<([^<>]*)>", "", lic.TEXTS[name].rpartition("|")[0])) + 400] if "<" in lic.TEXTS[name] else lic.TEXTS[name].rpartition("|")[0]
        parts.append("\n".join(textwrap.wrap(text.rstrip(" ,;.") + ".", rng.randint(30, 90))))
    mark = rng.choice(["", "# ", "// ", " * "])
    text = "\n\n".join(parts)
    text = "\n".join(f"{mark}{x}".rstrip() for x in text.split("\n"))
    assert lic.scan(text)[1] == plain_ids(text) == [n for n in plain_ids(text)]
    assert len(lic.scan(text)[1]) >= 7


@pytest.mark.parametrize(("name", "rule"), [(n, r) for n, r in lic.RULES if all(w.rstrip("?").split("/")[0] in lic.TEXTS for w in r.split())])
def test_each_rule_takes_its_own_text(name, rule):
    """The full texts of a rule's sentences give its licence, reordered ones don't."""
    import random
    import textwrap

    rng = random.Random(name)
    needed = [w.rstrip("?").split("/")[0] for w in rule.split()]
    parts = ["\n".join(textwrap.wrap(whole(w, rng).rstrip(".") + ".", 72)) for w in needed]
    found = [n for n, *_ in lic.scan("Copyright (c) 2020 Jane Doe\n\n" + "\n\n".join(parts))[2]]
    assert found == [name]
    if sum(not w.endswith("?") for w in rule.split()) > 1:
        assert [n for n, *_ in lic.scan("\n\n".join(reversed(parts)))[2]] != [name]


def test_long_names_of_holders():
    name = "The " + "Very Long Named " * 20 + "Foundation"
    text = f"Neither the name of {name} nor the names of its contributors may be used to endorse or promote products derived from this software."
    assert lic.scan(text)[1] == ["bsd_endorse"]


def test_every_known_sentence_holds_a_hint():
    assert all(any(h in t.rpartition("|")[0].lower() for h in lic._HINTS) for t in lic.TEXTS.values())


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Released under the GPL v2.", ["GPL-2"]), ("Released under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]), ("# Available under the GNU\n# AGPL 3.0", ["AGPL-3.0"]),
        ("Provided under Creative Commons BY 4.0", ["CC-BY-4.0"]), ("words\n\nAvailable under the GPL\n\nReleased under the MIT License", ["GPL", "MIT"]),
    ],
)
def test_notices_without_common_words(text, names):
    """No list of words decides which texts are looked at."""
    assert [n for n, *_ in lic.scan(text)[2]] == names


def test_names_of_holders_over_many_lines():
    holders = "\n".join(f"# Holder {k} of the Example Project," for k in range(300))
    text = f"{WRAPPED_BSD.split(' * 3')[0]}\n# Neither the name of\n{holders}\n# nor others may be used to endorse or promote products derived from this."
    assert lic.scan("\n".join(x.replace(" * ", "# ") for x in text.split("\n")))[1] == ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]


def test_many_beginnings_without_an_end():
    """Time grows with the text, not its square: each place ahead is looked for once."""
    import time

    for line in ("neither the name of x\n", WRAPPED_GPL.split(";")[0][2:] + " you can redistribute it and/or modify it under the terms of the GNU General Public License\n"):
        begin = time.process_time()
        lic.scan(line * 20_000)
        assert time.process_time() - begin < 30
