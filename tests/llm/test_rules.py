import random
import re
import time
from collections import Counter, defaultdict

import pytest

from sonoframe.llm import url_filter as U
from sonoframe.llm.license_rules import BASE, GATE_CC, GATES, signature_rules
from sonoframe.llm.license_scan import scan
from sonoframe.llm.quality_rules import cleaned_documents, quality_rules

WORD = r"[^\x20\x09-\x0D]+"


def test_quality_rules(odd, odd_rows, empty):
    got = defaultdict(list)
    for r in quality_rules(odd, line_docs=5).collect():
        got[r.doc_id].append(r)
    docs_with = defaultdict(set)
    norm = lambda x: " ".join(re.findall(WORD, re.sub("[0-9]+", "0", x.lower())))
    for r in odd_rows:
        for x in (r[1] or "").split("\n"):
            if re.search(WORD, x):
                docs_with[r[3], norm(x)].add((r[0], r[1]))
    assert sum(map(len, got.values())) == len(odd_rows)
    for r in odd_rows:
        t, g = r[1] or "", got[r[0]][0]
        w = re.findall(WORD, t)
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(win)
        rep = len({i + k for i, x in enumerate(win) if c[x] > 1 for k in range(3)})
        removed = sum(len(norm(x).split(" ")) for x in lines if len(docs_with[r[3], norm(x)]) > 5)
        assert (g.n_words, g.word_chars, g.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (g.n_dup_lines, g.n_repeat_words, g.words_removed) == (len(lines) - len(set(lines)), rep, removed)
        failed = len(w) < 50 or 100 * rep > 50 * len(w)
        assert g.base_failed == failed and g.kept == (not failed and not len(w) - removed < 0.5 * len(w))
    assert any(x.words_removed for g in got.values() for x in g)
    assert quality_rules(empty).count() == 0


def letters(n):
    """A word without digits, which count as one."""
    return "".join(chr(97 + int(c)) for c in str(n))


def test_depleted_documents_go(spark):
    shared = " ".join(f"common{i}" for i in range(60))
    rows = [(i, f"{shared}\nown words {i} here", "h") for i in range(30)] + [(100 + i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(80)), "h") for i in range(30)]
    rows += [(200, rows[30][1], "h")] * 40  # one row repeated is one document
    schema = "doc_id long, text string, source string"
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, schema)).collect()}
    assert not any(got[i] for i in range(30)) and all(got[i] for i in got if i >= 100)
    # Verdicts stay as unrelated documents join the host.
    more = [(10**6 + i, " ".join(letters(100 * i + j) for j in range(60)), "h") for i in range(3000)]
    more += [(2 * 10**6 + i, rows[0][1], "elsewhere") for i in range(20)]  # as many as the limit
    again = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows + more, schema)).collect()}
    assert {i: again[i] for i in got} == got and all(again[i] for i in again if i >= 10**6)
    copies = [(10**7 + i, rows[31][1], "h") for i in range(21)]  # documents of one text are different documents
    assert not any(r.kept for r in quality_rules(spark.createDataFrame(copies, schema)).collect())


def test_cleaned_documents(odd, odd_rows, empty):
    out = cleaned_documents(odd, line_docs=5)
    assert out.columns == odd.columns
    kept = [r.doc_id for r in quality_rules(odd, line_docs=5).collect() if r.kept]
    texts = defaultdict(set)
    for r in out.collect():
        texts[r.doc_id].add(r.text)
    assert sorted(r.doc_id for r in out.collect()) == sorted(kept)
    docs_with, norm = defaultdict(set), lambda x: " ".join(re.findall(WORD, re.sub("[0-9]+", "0", x.lower())))
    for r in odd_rows:
        for x in (r[1] or "").split("\n"):
            docs_with[r[3], norm(x)].add((r[0], r[1]))
    for r in odd_rows:
        if r[0] in texts:
            want = "\n".join(x for x in r[1].split("\n") if not norm(x) or len(docs_with[r[3], norm(x)]) <= 5)
            assert texts[r[0]] == {want}
    assert any(t != r[1] for r in odd_rows for t in texts.get(r[0], ()))
    assert cleaned_documents(empty).count() == 0


LICENSES = [
    ("Released under the MIT License.", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
    ("CC-BY 4.0", "cc-by,cc-by-4.0"),
    ("see http://creativecommons.org/licenses/by-nc-sa/4.0/ now", "cc-by-nc-sa-4.0"),
    ("GNU General Public License version 3 or later", "gpl,gpl-3"),
    ("the GNU Lesser General Public License, version 2.1", "gpl,lgpl-2.1"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2"),
    ("All rights reserved.", "reserved"),
    ("all rights reserved without a licence", "proprietary,reserved"),
    ("no such words", ""),
]


@pytest.mark.parametrize("text, labels", LICENSES)
def test_license_labels(spark, text, labels):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = scan(df).first()
    assert r.labels == labels and (r.score > 0) == bool(labels)


def test_license_scan_against_brute_force(spark, odd, odd_rows, empty):
    extra = [(1000 + i, t) for i, (t, _) in enumerate(LICENSES)] + [(2000, " ".join(t for t, _ in LICENSES) * 3), (2001, "cc by " * 500), (2002, "lİcense CC BY \u2028 cc by"), (2003, "K" * 9 + "licen")]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    text = {r[0]: r[1] for r in odd_rows} | dict(extra)
    rules = [(re.compile(r["pattern"]), r) for r in signature_rules()]
    for r in scan(df).collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text[r.doc_id] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for p, label in BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        norm = " " + " ".join(w) + " "
        found = [(m.start(), m.end(), x["label"], x["priority"]) for c, x in rules for m in c.finditer(norm)]
        stay = [d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and (e[3] > d[3] or (e[3] == d[3] and e[1] - e[0] > d[1] - d[0])) for e in found)]
        base = {label for _, label in at}
        assert r.n_words == len(w) and r.n_base == len(at) and r.base_labels == ",".join(sorted(base))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.labels == ",".join(sorted(base | {d[2] for d in stay}))
    assert scan(empty).count() == 0


def written(rng, tree):
    """A text that an expression matches."""
    out = ""
    for kind, value in tree:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(value)
        elif kind in ("ANY", "NOT_LITERAL") or (kind == "IN" and str(value[0][0]) == "NEGATE"):
            out += "q"
        elif kind == "IN":
            kind, x = rng.choice(value)
            out += chr(x) if str(kind) == "LITERAL" else chr(rng.randint(*x))
        elif kind == "BRANCH":
            out += written(rng, rng.choice(value[1]))
        elif kind == "SUBPATTERN":
            out += written(rng, value[-1])
        elif kind == "MAX_REPEAT":
            low, high, part = value
            out += "".join(written(rng, part) for _ in range(rng.randint(low, min(high, low + 3))))
        else:
            assert kind == "ASSERT", kind
    return out


def test_every_match_has_its_keyword_and_a_gate():
    rng = random.Random(2)
    rules = signature_rules()
    assert len(rules) > 500 and len({r["pattern"] for r in rules}) > 500
    for r in rules:
        assert 1 <= r["priority"] <= 5
        for _ in range(30):
            text = written(rng, re._parser.parse(r["pattern"]))
            text = re.sub(" +", " ", text)
            assert r["keyword"] in f" {text} ", (r, text)
            raw = text.replace("mozilla org mpl", "mozilla.org/mpl").replace("legal epl", "legal/epl")
            assert any(g in raw for g in GATES) or re.search(GATE_CC, raw), (r, text)


def test_many_places_take_seconds(spark):
    """A text with 100,000 places, and one with many detections inside others."""
    long = [(1, "cc by " * 100_000), (2, "GNU General Public License version 3, " * 5_000)]
    df = spark.createDataFrame(long, "doc_id long, text string")
    scan(df.limit(0)).collect()
    start = time.time()
    got = {r.doc_id: r for r in scan(df).collect()}
    assert time.time() - start < 60
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (100_000, 0, 199_998, "cc-by")
    assert len(got[1].found) == 100_000 and len(got[2].found) == 5_000 and got[2].labels == "gpl,gpl-3"


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://A.Example.org/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("https://example.org", "example.org", "", None, "allow"),
        ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("x://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
        ("x://a.com/de/1", "a.com", "/de/1", "com/de/", "block"),
        ("x://a.com/de", "a.com", "/de", None, "allow"),
        ("http://www.cheap-pills.example.com/en/1", "www.cheap-pills.example.com", "/en/1", None, "block"),
        ("http://spam-farm.example.org/en/7", "spam-farm.example.org", "/en/7", "org/", "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    r = U.judge_urls(spark.createDataFrame([(1, url, "v")], "page_id long, url string, verdict string"), U.RULES, U.BLOCKED).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def files_in(folder, files):
    for i, data in enumerate(files):
        (folder / f"{i}").write_bytes(data)
    return U.DigestArray(*[str(folder / f"{i}") for i in range(len(files))])


@pytest.mark.parametrize("most", [100, 1, 2])
def test_colliding_keys_are_told_apart(tmp_path, monkeypatch, most):
    monkeypatch.setattr(U.xxhash, "xxh64_intdigest", lambda s, seed: len(s))
    a = files_in(tmp_path, U.build({"ab.c/": "block", "xy.c/": "allow"}, ("qq.c",), most))
    assert a.judge([b"ab.c", b"xy.c", b"zz.c", b"qq.c"], [b"/"] * 4) == (["ab.c/", "xy.c/", None, None], ["block", "allow", "allow", "block"])


def test_many_files_judge_as_one(spark, tmp_path):
    """Lists longer than a file, from Python and from a table, against every rule in turn."""
    rng = random.Random(7)
    host = lambda: ".".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
    rules = {f"{host()}/{rng.choice(['', 'x/', 'x/y', 'zz'])}": rng.choice(["allow", "block"]) for _ in range(60)}
    blocked = tuple({host() for _ in range(20)})
    urls = [f"s://{host()}/{rng.choice(['', 'x/', 'x/yz', 'zz', 'q'])}{'' if i % 9 else '?a'}" for i in range(400)] + ["s://a.b/" + "x/y" * 50_000, None, "s://a"]
    want = []
    for u in urls:
        h, _, path = (u or "")[4:].split("?")[0].partition("/")
        path = "/" + path if "/" in (u or "")[4:] else ""
        fit = [r for r in rules for a, _, b in [r.partition("/")] if (h == a or h.endswith("." + a)) and path.startswith("/" + b)]
        rule = max(fit, key=lambda r: (len(r), r.index("/")), default=None)
        listed = any(h == b or h.endswith("." + b) for b in blocked)
        want.append((rule, rules[rule] if rule else "block" if listed else "allow"))
    df = spark.createDataFrame(list(enumerate(urls)) * 2, "page_id long, url string")
    entries = spark.createDataFrame([*rules.items(), *((b, "listed") for b in blocked), (None, "block")], "entry string, verdict string")
    for files in (U.stored(spark, U.build(rules, blocked, 7)), U.build_table(entries, 5), U.stored(spark, U.build(rules, blocked))):
        got = U.judge_by_files(df, files).collect()
        assert len(got) == 2 * len(urls) and all((r.rule, r.verdict) == want[r.page_id] for r in got)
    assert U.judge_by_files(df, U.build_table(entries.where("false"), 3)).where("verdict = 'block'").count() == 0


def test_no_urls(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judge_urls(none, U.RULES).count() == 0
    assert U.judge_urls(spark.createDataFrame([(1, "a://b/c")], "page_id long, url string"), {}).first().verdict == "allow"


def test_the_same_lists_twice(spark):
    df = spark.createDataFrame([(1, "a://b.org/")], "page_id long, url string")
    assert [U.judge_urls(df, U.RULES, U.BLOCKED).first().rule for _ in range(2)] == ["org/"] * 2


BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions."""
BSD_3 = """3. Neither the
name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."""
BSD_WHOLE = """Copyright <YEAR> <COPYRIGHT HOLDER>
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
""" + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
WHOLE = [(BSD_2, "bsd"), (BSD_3, "bsd-3-clause"), (BSD_2 + BSD_3, "bsd,bsd-3-clause"), (ISC, "isc"), (ISC.replace("and/or", "and"), "isc"),
         (ZLIB, "zlib"), (BSD_WHOLE, "bsd,bsd-3-clause"), ("the Artistic License 2.0", "artistic-2.0"), ("(Mozilla Public License, v. 2.0)", "mpl-2.0"),
         ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl-2.0"),
         ("Licensed under Boost Software License - Version 1.0", "boost,boost-1.0")]
SPDX = {
    "MPL-1.1": "mpl-1.1", "MPL-2.0": "mpl-2.0", "EPL-2.0": "epl-2.0", "CDDL-1.0": "cddl-1.0", "CPL-1.0": "cpl-1.0", "EUPL-1.2": "eupl-1.2", "BSL-1.0": "boost-1.0", "OFL-1.1": "ofl-1.1",
    "AFL-3.0": "afl-3.0", "OSL-3.0": "osl-3.0", "MS-PL": "ms-pl", "MS-RL": "ms-rl", "PSF-2.0": "psf-2", "NCSA": "ncsa", "SSPL-1.0": "sspl-1", "BUSL-1.1": "busl-1.1",
    "ODbL-1.0": "odbl-1.0", "ODC-By-1.0": "odc-by-1.0", "CDLA-Permissive-2.0": "cdla-2.0", "OGL-UK-3.0": "ogl-3.0", "0BSD": "0bsd", "Unlicense": "unlicense", "Python-2.0": "psf-2",
}


def test_whole_licenses_and_spdx_ids(spark):
    texts = [*WHOLE, *((f"SPDX-License-Identifier: {x}", label) for x, label in SPDX.items())]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in scan(df).collect()}
    assert [got[i] for i in range(len(texts))] == [label for _, label in texts]
