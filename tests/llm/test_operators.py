import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from geolattice.llm import bpe, common, cotrain, graph, licenses, lines, meet, ngrams, packing, quality, registry, shingles, simhash, substrings, topk

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    words = ["the", "and", "über", "naïve", "stone", "river's", "don't", "42", "paper,", "house.", "Ça", "green;", "ÀÉ!", "x"] + [f"w{r.randrange(500)}" for _ in range(30)]
    return " ".join(r.choice(words) for _ in range(n))


def texts():
    base, shared = prose(1, 300), prose(2, 60)
    return [
        None,
        "",
        " ",
        "one",
        "Hello  world \n\n\n next\tline\r\nend ",
        "a<|endoftext|> b <|startoftext|>",
        "  lead and trail  ",
        "é" * 700,
        "a" * 5000,
        "日本語 テキスト، مرحبا 😀  x ́e  z",
        base,
        base,
        base.replace("stone", "rock", 1),
        prose(3, 40) + "\n" + shared + "\n" + prose(4, 40),
        prose(5, 30) + "\n" + shared + "\n" + prose(6, 50),
        "line one\nline two\nline three\nline four\n" * 6,
        "line one\n\nline two \nline three\nother",
        prose(7, 30_000),
        "Good text. Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.",
        "word! . , ; foo bar! baz.\nQux. ",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, repeated and null ids, null columns, and columns with clashing names."""
    rows = [(5, "same text here", None, None, None, 1), (5, "same text here", None, None, None, 2), (5, "another text", "en", "s", 3, None), (None, "same text here", "en", "s", 3, 4), (None, None, None, None, None, None)]
    names = ["ids", "n_words", "kept", "n_removed", "licenses", "decoded", "spans", "doc", "key", "_doc", "_key", "_gone", "gone", "at", "_at", "_sizes", "sizes", "host", "_host", "_bad", "fails", "own", "salt", "fp", "row", "n", "a b", "list"]
    return spark.createDataFrame([(*r[:5], *["z"] * len(names)) for r in rows], SCHEMA + "".join(f", `{n}` string" for n in names))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w.encode(): w.upper().encode() for w in ["tap", "taps", "top", "tops", "", "é"]}
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.build_lexicon(words))
    lexicon = bpe.Lexicon(str(path))
    asked = [*words, b"ta", b"tapss", b"x"]
    assert lexicon.get(asked) == [*words.values(), None, None, None]
    assert len(lexicon.final) <= 8  # tap/top and their plurals share their ends
    path.write_bytes(bpe.build_lexicon({}))
    assert bpe.Lexicon(str(path)).get([b"a", b""]) == [None, None]


@pytest.mark.parametrize("words", [0, 50_000])
def test_bpe_equals_the_library_and_returns(docs, odd, none, words):
    t = tokenizer(BYTES)
    for df in (docs, odd, none):
        name = bpe.lexicon_file(df, BYTES, words)
        rows = bpe.decode(bpe.encode(df, BYTES, name), BYTES).collect()
        assert sorted(r.decoded for r in rows) == sorted(r.text or "" for r in df.collect())
        expected = sorted(t.encode(r.text or "", add_special_tokens=False).ids for r in df.collect())
        assert sorted(r.ids for r in rows) == expected


def test_bpe_encodes_and_decodes_in_one_pass_and_by_columns(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = registry.QUERIES["op1_bpe"](spark, str(tmp_path))
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # ids don't go to another worker
    words = {f" {w}".encode(): bpe.packed(tokenizer(BYTES).encode(f" {w}", add_special_tokens=False).ids) for w in ["the", "stone"]}
    (tmp_path / "lexicon").write_bytes(bpe.build_lexicon(words))
    encoder = bpe.Encoder(BYTES, str(tmp_path / "lexicon"))
    asked, known = [], encoder.known
    monkeypatch.setattr(encoder, "known", lambda x: asked.extend(x) or known(x))
    column = pa.array(["the stone the stone the stone", None, "stone the\nthe the the"])
    assert encoder.encode(column).to_pylist() == [tokenizer(BYTES).encode(x or "", add_special_tokens=False).ids for x in column.to_pylist()]
    assert len(asked) == len(set(asked)) == 6  # heads "the", "", "stone"; "stone", "the" and the line feed's "the"
    monkeypatch.setattr(bpe, "RECENT", 0)
    encoder.encode(pa.array(["x unseen the"]))
    encoder.encode(pa.array([""]))
    assert set(encoder.recent) == {"the", "stone", bpe.HEAD}  # the lexicon's words stay


@pytest.mark.parametrize("words", [[], [" ab", "ab", "\nab", " don't"]])
def test_bpe_of_odd_blanks_and_marks_by_columns(tmp_path, words):
    t, r = tokenizer(BYTES), random.Random(6)
    (tmp_path / "lexicon").write_bytes(bpe.build_lexicon({w.encode(): bpe.packed(t.encode(w, add_special_tokens=False).ids) for w in words}))
    parts = ["ab", "don't", "é", "42", ".", "***", " ", " ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u180e", "\u2003", "\u200b", "\u2028", "\u3000", "\ufeff", "<|endoftext|>", "<|", "😀", "日本", "x" * 70]
    made = [None, "", " ", "\n", "ab " * 400_000] + ["".join(r.choice(parts) for _ in range(r.randrange(1, 12))) for _ in range(3_000)]
    encoder, decoder = bpe.Encoder(BYTES, str(tmp_path / "lexicon")), bpe.Decoder(BYTES)
    for size in (7, len(made)):
        for k in range(0, len(made), size):
            column = pa.array(["before", *made[k : k + size], "behind"], pa.string()).slice(1, len(made[k : k + size]))
            ids = encoder.encode(column)
            assert ids.to_pylist() == [t.encode(x or "", add_special_tokens=False).ids for x in column.to_pylist()]
            assert decoder.decode(ids).to_pylist() == [x or "" for x in column.to_pylist()]


def test_decoding_by_columns(spark):
    decoder, t = bpe.Decoder(BYTES), tokenizer(BYTES)
    half = t.encode("日", add_special_tokens=False).ids[:1]
    ids = [[5], half, None, [], t.encode("ab é", add_special_tokens=False).ids, half + half, None]
    column = pa.array([[9, None], *ids], pa.list_(pa.int32()))
    expected = [None if x is None else t.decode(x, skip_special_tokens=False) for x in ids]
    assert decoder.decode(column.slice(1)).to_pylist() == expected
    assert decoder.decode(column.slice(3, 2)).to_pylist() == [None, ""]
    assert decoder.decode(column.slice(0, 1)).to_pylist() == [t.decode([9])]
    assert decoder.decode(column.slice(0, 0)).to_pylist() == []


def test_ids_that_stand_for_nothing_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, [-1, 10**6, 2**31 - 1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(rows, BYTES).collect()} == {1: "", 2: None, 3: ""}


def check_packing(df, size):
    t = tokenizer(WORDS)
    expected = [t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in df.collect()]
    by_sequence, got = defaultdict(list), defaultdict(list)
    for r in packing.pack(df, WORDS, size).collect():
        assert len(r.ids) == r.length
        by_sequence[r.sequence_id].append(r)
        got[r.doc_id, r.doc_tokens].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or at & (at - 1) == 0
    assert sum(r.length for p in by_sequence.values() for r in p) == sum(map(len, expected))
    whole = [sum((r.ids for r in sorted(p, key=lambda r: r.start)), []) for p in got.values()]
    if len({r.doc_id for r in df.collect()}) == len(expected):
        assert sorted(whole) == sorted(expected)


def test_packing_places_every_id_once(docs, odd, none):
    for df in (docs, odd, none):
        for size in (64, 2048):
            check_packing(df, size)
    rows = packing.crc32_of_ids(packing.pack(docs, WORDS)).where("doc_id = 3").collect()
    ids = tokenizer(WORDS).encode("one", add_special_tokens=False).ids + [1]
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))]


def test_packer_chooses_the_least_sum_of_squares_and_bounds_open_windows():
    rng, size = random.Random(3), 32
    packer, count = packing.Packer(size), [0] * (size + 1)
    for k in range(400):
        n = rng.randrange(1, size)
        costs = {}
        for h in range(size):
            if h + n <= size and (h == 0 or count[h]):
                after = count[:]
                after[h] -= h > 0
                after[h + n] += h + n < size
                costs[h] = sum(c * c for c in after[1:size])
        before = packer.count.copy()
        list(packer.place((k, 0, b"\0" * 4 * n, n), n))
        count = packer.count.tolist()
        assert sum(c * c for c in count[1:size]) == min(costs.values()), (n, before)
    many = packing.Packer(2048)
    for k in range(packing.OPEN + 50):
        list(many.place((k, 0, b"\0" * 4 * 1500, 1500), 1500))
    assert many.open <= packing.OPEN


def oracle(sql, df):
    documents = df.toPandas()  # noqa: F841
    return duckdb.sql(sql).df()


def same(df, sql, source):
    got, expected = df.toPandas(), oracle(sql, source)
    columns = sorted(expected.columns)
    assert columns == sorted(got.columns)
    rows = lambda x: sorted(map(str, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(expected)


def test_native_operators_equal_their_sql(docs, none):
    for df in (docs, none):
        measured = quality.measure(df.select("doc_id", "text", "source")).drop("text")
        same(quality.verdicts(measured, quality.host_verdicts(measured)).select("doc_id", *quality.MEASURES, "kept"), quality.OP2_SQL, df)
        same(lines.drop_repeated_lines(df.select("doc_id", "text")), lines.OP6_SQL, df)
        same(licenses.scan(df.select("doc_id", "text")).select("doc_id", "sentence_ids", "licenses"), licenses.OP8_SQL, df)


def test_native_operators_take_odd_rows(odd):
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(odd).count() == 0
    measured = quality.measure(odd)
    judged = quality.verdicts(measured, quality.host_verdicts(measured))
    assert judged.where("kept").count() == 0 and set(judged.columns) == {*odd.columns, *quality.MEASURES}
    found = lines.drop_repeated_lines(odd)
    assert found.where("n_removed = 0").count() == 5 and set(found.columns) == {*odd.columns, "n_lines"}
    assert licenses.scan(odd).where("licenses = ''").count() == 5
    removed = substrings.drop_repeats(odd)
    assert removed.count() == 5 and removed.select("spans", "key", "a b").distinct().collect() == [("z", "z", "z")]
    left = shingles.one_of_each(odd)
    assert left.columns == odd.columns
    # the copies under id 5 are one document, the text under it that is another stays, the copy without an id goes
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(map(str, [(5, "same text here"), (5, "same text here"), (5, "another text"), (None, None)]))


def test_a_host_prior_leaves_out_what_chance_makes(spark):
    r = random.Random(4)
    rows = [(f"h{h}", r.random() < 0.4) for h in range(200) for _ in range(5)]
    measured = spark.createDataFrame(rows, "source string, base_failed boolean")
    # rates of such small hosts differ by chance alone, so none is far from the mean of all
    assert quality.host_verdicts(measured).count() == 0
    worse = measured.union(spark.createDataFrame([("bad", True)] * 60, measured.schema))
    assert {r.host: r.n_host for r in quality.host_verdicts(worse).collect()}["bad"] == 60


def test_a_host_that_mostly_fails_takes_its_documents_along(spark):
    good = [(i, prose(i, 60), "en", "good" if i % 2 else "bad", 1) for i in range(40)]
    bad = [(100 + i, "short", "en", "bad", 1) for i in range(200)]
    found = quality.keep_good(spark.createDataFrame(good + bad, SCHEMA))
    assert {r.source for r in found.collect()} == {"good"} and found.count() == 20


def test_lines_of_later_copies_go(docs):
    rows = {r.doc_id: r for r in lines.drop_repeated_lines(docs).collect()}
    assert rows[0].text is None and rows[0].n_lines == 0
    assert rows[15].n_removed == 20 and rows[16].text == "other" and rows[11].text == rows[10].text


def test_licence_table():
    assert all(any(s in x for s in licenses.SIGNS) for x in licenses.SENTENCES.values())
    assert not any(" " in s for s in licenses.SIGNS)  # a wrapped line can't part them
    assert len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES)
    assert all(i in licenses.SENTENCES for _, rule, *without in licenses.RULES for i in [*rule, *without])


def test_licences_are_matched_in_order(spark):
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice,\nthis list of conditions and the following disclaimer.", "Other words.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
    name = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    df = spark.createDataFrame([(1, "\n".join(bsd)), (2, "\n".join([*bsd, name])), (3, "\n".join(bsd[::-1])), (4, texts()[18])], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in licenses.scan(df).collect()} == {1: "BSD-2-Clause", 2: "BSD-3-Clause", 3: "", 4: "Apache-2.0,MIT"}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string")


def test_more_licences_and_where_rules_begin(spark):
    grant, source = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    binary = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    name = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    hope = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    agpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\n"
    zlib_text = "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not\n   claim that you wrote the original software. If you use this"
    rows = [
        ("Unlicense", "This is free and unencumbered software released into the public\ndomain."),
        ("BSD-2-Clause", grant + source + binary),
        ("BSD-3-Clause", grant + source + binary + name),
        ("BSD-2-Clause,BSD-3-Clause", grant + source + binary + name + "\n" + grant + source + binary),
        ("AGPL-3.0-or-later", agpl + hope),
        ("Zlib", zlib_text),
        ("MIT", "// SPDX-License-Identifier: MIT\nint main;"),
        ("Apache-2.0", "#!/bin/sh\n# SPDX-License-Identifier: Apache-2.0"),
        ("EPL-2.0", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n"),
        ("", "A license is a license. Permission? Redistribution; warranty: none.\n\n\n..."),
        ("", None),
        ("", ""),
        ("", "\n" * 100_000 + "licens"),
    ]
    df = docs_of(spark, [(f"{i} {n}", t) for i, (n, t) in enumerate(rows)])
    assert {r.doc_id: r.licenses for r in licenses.scan(df).collect()} == {f"{i} {n}": n for i, (n, _) in enumerate(rows)}
    same(licenses.scan(df).drop("text"), licenses.OP8_SQL, df)


def test_licences_in_their_usual_layout(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n"
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL'
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.'
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    known = {"GPL-3.0-or-later": gpl, "MIT": mit, "Apache-2.0": apache, "MPL-2.0": mpl, "BSD-3-Clause": bsd, "ISC": isc}
    shapes = [lambda t: t, lambda t: t.replace("\n", "\r\n")] + [lambda t, m=m: "\n".join(m + x for x in t.split("\n")) for m in ("    ", "# ", " * ", "// ")]
    rows = [(f"{name} {k}", shape(t)) for name, t in known.items() for k, shape in enumerate(shapes)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {d: r.licenses for d, r in got.items()} == {d: d.split()[0] for d, _ in rows}
    assert all("apache-copy" in r.sentence_ids for d, r in got.items() if d.startswith("Apache"))
    same(licenses.scan(docs_of(spark, rows)).drop("text"), licenses.OP8_SQL, docs_of(spark, rows))
    apart = spark.createDataFrame([(1, mpl.replace("Public\n", "Public\n\n"))], "doc_id long, text string")
    assert licenses.scan(apart).first().licenses == ""


def fingerprint(text, words):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    grams = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_equals_brute_force(docs, odd, none):
    fps = {r.doc_id: fingerprint(r.text, 4) for r in docs.collect()}
    expected = brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    rows = simhash.near_copies(docs).collect()
    assert {r.doc_id: r.fp % 2**64 for r in rows} == fps and {r.doc_id: r.component for r in rows} == expected
    assert sorted(str(r.component) for r in simhash.near_copies(odd).collect()) == ["5", "5", "5", "5", "None"]
    assert simhash.near_copies(none).count() == 0


def test_a_very_long_text_has_the_fingerprint_of_all_its_shingles(spark):
    text = prose(77, 150_000)
    rows = simhash.near_copies(spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.fp % 2**64 for r in rows} == {1: fingerprint(text, 4), 2: fingerprint(text + " end", 4)}
    assert {r.component for r in rows} == {1}


def test_blocks_to_agree_keep_few_fingerprints_under_a_value():
    for n in (10, 10**6, 10**8, 10**10, 10**12):
        agree = simhash.blocks_to_agree(n, 4)
        assert n <= simhash.CROWD << 64 * agree // (4 + agree) and agree <= 4
    assert simhash.blocks_to_agree(1000, 4) == 1 and simhash.blocks_to_agree(10**8, 4) == 2


def test_links_split_hot_values_and_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    near = [int(rng.integers(1 << 62)) for _ in range(3)]
    values = sorted({c ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for c in near for _ in range(150)})
    nodes = spark.createDataFrame(list(enumerate(values)), "node long, fp long")
    expected = brute_components(range(len(values)), lambda a, b: (values[a] ^ values[b]).bit_count() <= 4)
    for group, chunk, agree in ((8192, 4096, None), (40, 16, 1), (40, 16, 2), (8192, 4096, 3)):
        monkeypatch.setattr(meet, "GROUP", group)
        monkeypatch.setattr(meet, "CHUNK", chunk)
        roots = {r.node: r.root for r in graph.components(simhash.links(nodes, agree=agree)).collect()}
        assert {n: roots.get(n, n) for n in expected} == expected


def test_components_of_a_path_and_nothing(spark, monkeypatch):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (3, None)]
    for few in (500_000, 0):
        monkeypatch.setattr(graph, "FEW", few)
        got = {r.node: r.root for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
        assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats(all_texts, size=substrings.SIZE):
    data = [(t or "").encode() for t in all_texts]
    count = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if count[d[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out.append((len(d), sum(gone), len(gone.replace(b"\0", b" ").split()), bytes(b for b, g in zip(d, gone) if not g)))
    return out


@pytest.mark.parametrize("group", [4096, 1])
def test_substrings_equal_brute_force(spark, docs, odd, none, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    r = random.Random(9)
    long = [prose(50 + k, 80) for k in range(6)]
    more = [" ".join([prose(100 + k, r.randrange(20)), r.choice(long)[r.randrange(40) :], r.choice(long)[: r.randrange(150, 400)]]) for k in range(30)]
    rows = spark.createDataFrame([(1000 + i, t, None, None, None) for i, t in enumerate(more)], SCHEMA)
    for df in (docs.union(rows), odd, none):
        found = substrings.drop_repeats(df).collect()
        assert sorted((f.n_bytes, f.n_removed, f.n_spans, bytes(f.kept)) for f in found) == sorted(repeats([x.text for x in df.collect()]))
    assert substrings.drop_repeats(odd, as_text=True).select("kept").where("kept = 'another text'").count() == 1


def test_parsing_part_by_part_finds_every_string_once(monkeypatch):
    shared = prose(61, 200)
    made = [prose(62, 300) + shared + prose(63, 400) + shared, prose(64, 100) + shared[100:], "ab" * 900 + shared]
    made = [x.encode() for x in made]
    data = b"".join(made)
    for part in (1 << 26, 700, 64):
        monkeypatch.setattr(substrings, "PART", part)
        starts = np.cumsum([0, *map(len, made[:-1])])
        first, last, lo, hi = substrings.parse(data, starts)
        covered = sorted(x for a, b in zip(first.tolist(), last.tolist()) for x in range(a, b + 1))
        assert covered == sorted(s + i for s, t in zip(starts.tolist(), made) for i in range(len(t) - substrings.SIZE + 1))
        assert all(a >= x for a, x in zip(lo.tolist(), last.tolist())) and all(b <= x + substrings.SIZE for b, x in zip(hi.tolist(), first.tolist()))


def test_ranks_are_those_of_sorted_strings():
    data = bytes(random.Random(4).choices(b"ab", k=600))
    got = substrings.ranks(data, 20).tolist()
    order = sorted({data[i : i + 20] for i in range(581)})
    assert got == [order.index(data[i : i + 20]) for i in range(581)]


def backoff(ids, table, total, least, order):
    """The brute-force score of each place of a text."""
    out = 0.0
    for i in range(len(ids)):
        for n in range(min(order, i + 1), 0, -1):
            gram = tuple(ids[i - n + 1 : i + 1])
            if n == 1:
                out += math.log(max(1, table[gram]) / total)
            elif table[gram] >= least:
                out += math.log(table[gram] / table[gram[:-1]])
                break
            else:
                out += math.log(ngrams.BACKOFF)
    return out


def gram_table(texts):
    return Counter(tuple(x[i : i + n]) for x in texts for n in (1, 2, 3) for i in range(len(x) - n + 1))


@pytest.mark.parametrize("chunk", [100, 2_000_000])
def test_scores_equal_brute_force(spark, docs, odd, none, monkeypatch, chunk):
    monkeypatch.setattr(ngrams, "TOKENS", chunk)
    monkeypatch.setattr(ngrams, "TEXTS", 3)
    t = tokenizer(WORDS)
    encode = lambda x: t.encode(x or "", add_special_tokens=False).ids
    for df in (docs, odd, none):
        rows = df.collect()
        ids = [encode(r.text) for r in rows]
        table, total = gram_table(ids), max(1, sum(map(len, ids)))
        for least, order in ((1, 3), (2, 3), (2, 2)):
            got = sorted((str(r[0]), r.n_tokens, r.log_score) for r in ngrams.scores(df, WORDS, least=least, order=order).collect())
            expected = sorted((str(r.doc_id), len(x), backoff(x, table, total, least, order)) for r, x in zip(rows, ids))
            assert [g[:2] for g in got] == [e[:2] for e in expected]
            for g, e in zip(got, expected):
                assert abs(g[2] - e[2]) <= 2e-5 * max(1, g[1])
    model = ngrams.counts(ngrams.postings(docs, WORDS, 3))
    table = gram_table([encode(r.text) for r in docs.collect()])
    other = spark.createDataFrame([(1, "the stone and unheard zebra words, the stone"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ngrams.scores(other, WORDS, order=3, model=model).collect()}
    ids = encode(other.first().text)
    assert abs(got[1].log_score - backoff(ids, table, sum(table[g] for g in table if len(g) == 1), 1, 3)) < 1e-3
    assert got[2].log_score == 0 and got[2].mean_log_score is None


def test_op5_takes_the_whole_table(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    t = tokenizer(WORDS)
    ids = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    table, total = gram_table(ids.values()), sum(map(len, ids.values()))
    rows = {r.doc_id: r for r in ngrams.op5_lm_scores(spark, str(tmp_path)).collect()}
    assert set(rows) == set(ids) and 1 in table.values()
    for doc, x in ids.items():
        assert rows[doc].n_tokens == len(x) and abs(rows[doc].log_score - backoff(x, table, total, 1, 2)) <= 2e-5 * max(1, len(x))


def brute_top(rows, asked, k=5):
    """Whole scores by Python's integers; rows and asked are places."""
    whole = [[math.floor(256 * x) if abs(x) < 2**50 else int(x) * 256 for x in v] for _, v in rows]
    out = []
    for q in asked:
        order = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), (0, rows[c][0]) if rows[c][0] is not None else (1, 0)) for c in range(len(rows)) if c != q and len(whole[c]) == len(whole[q]))
        out += [(rows[q][0], rank, i[1] if not i[0] else None, -s) for rank, (s, i) in enumerate(order[:k], 1)]
    return sorted(map(str, out))


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 20)).astype("f4")
    v[7] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1050, [1.0, 2.0]), (1051, [2.0, 2.0]), (1100, []), (1101, []), (None, v[0].tolist()), (100, v[5].tolist()), (100, v[5].tolist())]
    bad = [(900, None), (950, [1.0, None] + [0.0] * 18), (1000, [float("nan")] * 20), (1150, [float("inf")] + [0.0] * 19)]
    asked = [k for k, (i, _) in enumerate(rows) if i is not None and i % 50 == 0]
    expected = brute_top(rows, asked)
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(3)
    for queries, candidates, block in ((4096, 16384, 8192), (3, 100, 64)):
        for name, value in (("QUERIES", queries), ("CANDIDATES", candidates), ("BLOCK", block)):
            monkeypatch.setattr(topk, name, value)
        usable = topk.usable(df)
        got = topk.search(usable, usable.where("vec_id % 50 = 0")).collect()
        assert sorted(str(tuple(r)) for r in got) == expected
    none = topk.usable(df.limit(0))
    assert topk.search(none, none).count() == 0


def test_top_k_keeps_large_finite_vectors(spark):
    rows = [(50, [1.0, 0.0, 2.0]), (51, [600000.0, 1.0, 0.5]), (52, [-4e13, 1.0, 0.25]), (53, [2.0**70, 0.0, -1.0]), (100, [1e-3, 0.0, 0.0]), (150, [0.0, 0.0, 1.0])]
    df = topk.usable(spark.createDataFrame(rows[:3] + rows[4:], "vec_id long, embedding array<double>"))
    got = topk.search(df, df.where("vec_id % 50 = 0")).collect()
    kept = rows[:3] + rows[4:]
    assert sorted(str(tuple(r)) for r in got) == brute_top(kept, [0, 3, 4])
    huge = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="does not fit a long"):
        topk.search(huge, huge.where("vec_id = 50")).collect()


def test_op9_equals_its_sql(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 16)).astype("f4"))] + [(100, [0.5] * 16), (None, [2.0] * 16), (350, None), (400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    embeddings = duckdb.read_parquet(f"{tmp_path}/embeddings.parquet/*.parquet")  # noqa: F841
    expected = sorted(map(str, duckdb.sql(topk.OP9_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in topk.op9_topk(spark, str(tmp_path)).collect()) == expected


def test_cotraining_is_right_on_rows_held_out(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        text = prose(i, 60) + (" junk### spam&&& click***" * 6 if bad else "") + (" scum trash worthless" * 2 if toxic else "")
        rows.append((i, text, "en", "s9" if bad else f"s{i % 4}", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    df = spark.createDataFrame(rows + [(None, None, None, None, None), (700, "", "en", "s1", 0)], SCHEMA)
    known = spark.createDataFrame(labels[:300] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    model, table = cotrain.train(df, known, labelled=250, named=20)
    found = {x.doc_id: x for x in cotrain.score(table, model).collect()}
    assert len(found) == 602
    right = [(found[i].quality >= 0.5) == bool(q) and (found[i].toxic >= 0.5) == bool(t) for i, q, t in labels[300:]]
    assert np.mean(right) > 0.9
    for some, marked in ((df.limit(0), known), (df, known.limit(0)), (df, known.where("quality = 1 AND toxic = 0"))):
        model, table = cotrain.train(some, marked)
        assert cotrain.score(table, model).count() == some.count()


def test_cotraining_equals_the_same_fit_by_hand(spark):
    r = random.Random(18)
    rows, labels = [], []
    for i in range(260):
        bad = r.random() < 0.4
        text = prose(300 + i, 50) + (" junk### spam&&& click***" * r.randrange(1, 5) if bad else "")
        rows.append((i, text, "en", "s9" if bad and r.random() < 0.9 else f"s{i % 4}", len(text)))
        labels.append((i, int(not bad)))
    rows += [(70, "the stone", "de", "s1", 9), (None, "spam&&& spam&&&", "en", "s9", 3), rows[200]]
    known = spark.createDataFrame(labels[:90] + [(4, 1)], "doc_id long, quality int")
    model, table = cotrain.train(spark.createDataFrame(rows, SCHEMA).repartition(5), known, targets=("quality",), named=12)
    got = sorted((str(x.doc_id), x.quality_by_text, x.quality_by_meta, x.quality) for x in cotrain.score(table, model).collect())

    features = cotrain.Features()
    wanted = {i: q for i, q in labels[:90]}
    wanted[4] = min(1, wanted[4])
    made = [(d, *features.text(t), sorted(set(features.meta(*m)))) for d, t, m in ((x[0], x[1], (x[3], x[2], x[4])) for x in rows)]
    first = {}
    for x, f in zip(rows, made):
        key = spark.range(1).selectExpr("1").first() and x
        if x[0] in wanted:
            first.setdefault(x[0], []).append((key, f))
    hashed = lambda x: spark.createDataFrame([x], SCHEMA).selectExpr("xxhash64(text, source, lang, n_chars) AS h").first().h
    labelled = {d: (v[0][1] if len(v) == 1 else min(v, key=lambda z: hashed(z[0]))[1]) for d, v in first.items()}
    keys = sorted(labelled)
    y = np.array([wanted[k] for k in keys], float)
    held = np.arange(len(keys)) % 5 == 4
    columns = cotrain.telling([labelled[k][1] for k, h in zip(keys, held) if not h], [wanted[k] for k, h in zip(keys, held) if not h])
    where = {c: j for j, c in enumerate(columns.tolist())}

    def matrices(some):
        text, meta = np.zeros((len(some), len(columns)), np.float32), np.zeros((len(some), cotrain.META), np.float32)
        for i, (_, at, value, m) in enumerate(some):
            for c, x in zip(at.tolist(), value.tolist()):
                if c in where:
                    text[i, where[c]] = x
            meta[i, m] = 1
        return text, meta

    own, everything = matrices([labelled[k] for k in keys]), matrices(made)
    margin = lambda x, w: x.astype(float) @ w[:-1].astype(float) + float(w[-1])
    given, weights = [[], []], [None, None]
    for k in range(cotrain.ROUNDS):
        for v in range(2):
            more = [everything[v][i] for i, _ in given[v]]
            x = np.concatenate([own[v][~held], np.stack(more)]) if more else own[v][~held]
            weights[v] = cotrain.fit(x, np.concatenate([y[~held], [c for _, c in given[v]]]).astype(np.float32), weights[v])
        if k + 1 == cotrain.ROUNDS:
            break
        news = []
        for v in range(2):
            z, taken = margin(everything[v], weights[v]), {rows[i][0] for i, _ in given[1 - v]} | set(keys) | {None}
            sides = []
            for sign in (-1, 1):
                order, ids = [], set()
                for i in sorted(range(len(rows)), key=lambda i: (-sign * z[i], str(rows[i][0]).zfill(9))):
                    if sign * z[i] > math.log(9) and rows[i][0] not in taken | ids:
                        order.append(i)
                        ids.add(rows[i][0])
                sides.append(order[:12])
            share = y.mean()
            n = min(len(sides[1]), int(len(sides[0]) * share / (1 - share)) + 1)
            news.append([(i, 0.0) for i in sides[0][: int(n * (1 - share) / share) + 1]] + [(i, 1.0) for i in sides[1][:n]])
        given = [given[0] + news[1], given[1] + news[0]]
    assert sum(map(len, given)) > 20
    target = cotrain.Target(*own, y)
    target.weights = weights
    joint = target.combined()[2]
    z = [margin(everything[v], weights[v]) for v in range(2)]
    p = cotrain._sigmoid
    expected = sorted((str(x[0]), p(a), p(b), p(joint[0] * a + joint[1] * b + joint[2])) for x, a, b in zip(rows, *z))
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert np.abs(np.array([g[1:] for g in got]) - np.array([e[1:] for e in expected])).max() < 1e-3


def test_words_never_labelled_count_by_their_beginnings():
    r = random.Random(11)
    features = cotrain.Features()
    made = lambda i, ends: features.text(prose(i, 200) + "".join(f" vequ{r.choice(ends)}" for _ in range(3)) * (i % 2))
    rows = [made(i, ["er", "ait", "on"]) for i in range(200)] + [made(i, ["ille", "tum", "q"]) for i in range(200, 300)]
    labels = [i % 2 for i in range(300)]
    columns = cotrain.telling([at for at, _ in rows[:200]], labels[:200])
    assert len(columns) == cotrain.COLUMNS == len(set(columns.tolist()))
    x = np.zeros((300, cotrain.PLACES + cotrain.SHAPE), np.float32)
    for i, (at, value) in enumerate(rows):
        assert abs(np.square(value[:-4]).sum() - 1) < 1e-6
        x[i, at] = value
    x = x[:, columns]
    w = cotrain.fit(x[:200], np.array(labels[:200], np.float32))
    assert ((x[200:] @ w[:-1] + w[-1] > 0) == np.array(labels[200:], bool)).mean() > 0.9
    for empty in (None, "", " \n"):
        assert [a.tolist() for a in features.text(empty)] == [[cotrain.PLACES + cotrain.SHAPE - 1], [1.0]]


def test_pipeline_equals_its_stages_by_brute_force(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    base = docs.select(*corpus_pipeline.COLUMNS)
    kept = oracle(f"SELECT d.* FROM documents d JOIN ({quality.OP2_SQL}) q USING (doc_id) WHERE q.kept", base)
    source = base.where(base.doc_id.isin(kept.doc_id.tolist()))
    cut = oracle(lines.OP6_SQL, source).set_index("doc_id").text
    grams = {d: [x.lower().split()[i : i + 5] for i in range(max(1, len(x.split()) - 4))] for d, x in cut.items()}
    sets = {d: {" ".join(g) for g in x} for d, x in grams.items()}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    roots = brute_components(sorted(sets), near)
    left = sorted(d for d, r in roots.items() if d == r)
    t = tokenizer(WORDS)
    rest = {d: x[3].decode("utf-8", "ignore") for d, x in zip(left, repeats([cut[d] for d in left]))}
    ids = {d: t.encode(x, add_special_tokens=False).ids + [1] for d, x in rest.items()}
    pieces = defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id] += range(r.start, r.start + r.length)
    assert {d: sorted(p) for d, p in pieces.items()} == {d: list(range(len(x))) for d, x in ids.items()}


def test_pipeline_drops_every_near_copy_by_exact_similarity(spark, none):
    r = random.Random(33)
    made = []
    for k in range(30):
        base = [f"v{r.randrange(3000)}" for _ in range(120 if k % 3 else 24)]
        made.append(" ".join(base))
        for n in (1, 2, 3, 4) if k % 3 else (1, 2):
            out = list(base)
            for _ in range(n):
                out[r.randrange(3) if k % 3 == 0 else r.randrange(len(out))] = f"other{r.randrange(10**6)}"
            made.append(" ".join(out))
    made += ["", None, "one", "one", made[0]]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(made)] + [(None, made[0], None, None, None)], SCHEMA)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").split() for t in made)]
    roots = brute_components(range(len(made)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    left = [x.doc_id for x in corpus_pipeline.simhash_dedup(spark, rows, None).collect()]
    assert sorted(left) == sorted(set(roots.values()))  # the row without an id is a copy of another
    assert corpus_pipeline.simhash_dedup(spark, none, None).count() == 0


def test_what_is_apart_under_a_key_is_compared_chunk_by_chunk(spark, monkeypatch):
    r = random.Random(40)
    base = [f"v{r.randrange(900)}" for _ in range(90)]
    made = []
    for k in range(60):
        out = list(base)
        for _ in range(r.randrange(6)):
            out[r.randrange(90)] = f"o{r.randrange(10**6)}"
        made.append(" ".join(out))
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, made)]
    roots = brute_components(range(60), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    for group, chunk in ((10, 4),):
        monkeypatch.setattr(meet, "GROUP", group)
        monkeypatch.setattr(meet, "CHUNK", chunk)
        assert {x.doc: x.first_doc for x in shingles.groups(rows).collect()} == roots


def test_groups_attached_through_parts(spark):
    rows = spark.createDataFrame([(i % 3 or None, i) for i in range(30)], "k long, v long")
    sums = {"n": (F.count("*"), F.sum), "m": (F.min("v"), F.min)}
    assert sorted(map(tuple, common.with_groups(rows, ["k"], ["v"], sums).collect())) == sorted((i % 3, i, 10, i % 3) for i in range(30) if i % 3)
    names = spark.createDataFrame([(1, "one")], "k long, name string")
    assert {tuple(x) for x in common.joined(rows, names, ["k"], ["v"]).select("k", "v", "name").collect()} == {(1, i, "one") for i in range(1, 30, 3)}
    assert common.fresh(["A", "_a"], "a", "a") == ["__a", "___a"]


def test_pipeline_takes_odd_rows_and_empty_tables(spark, odd, none, tmp_path):
    for name, df in (("odd", odd), ("none", none)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == 0


def test_registered_queries_equal_brute_force(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    source = {r.doc_id: r.text or "" for r in docs.collect()}
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()

    t = tokenizer(BYTES)
    ids = {d: t.encode(x, add_special_tokens=False).ids for d, x in source.items()}
    decoded = {d: t.decode(x, skip_special_tokens=False) for d, x in ids.items()}
    expected = sorted((d, len(x), sha(",".join(map(str, x)).encode()), sha(decoded[d].encode())) for d, x in ids.items())
    assert sorted(map(tuple, run("op1_bpe"))) == expected

    t, pieces, sequences = tokenizer(WORDS), defaultdict(list), defaultdict(list)
    ids = {d: t.encode(x, add_special_tokens=False).ids + [1] for d, x in source.items()}
    for r in run("op3_packing"):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        pieces[r.doc_id] += range(r.start, r.start + r.length)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {d: sorted(p) for d, p in pieces.items()} == {d: list(range(len(x))) for d, x in ids.items()}
    for found in sequences.values():
        ends = [0, *(sum(x) for x in sorted(found))]
        assert [o for o, _ in sorted(found)] == ends[:-1] and ends[-1] <= 2048

    fps = {d: fingerprint(x, 4) for d, x in source.items()}
    roots = brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert sorted(map(tuple, run("op7_simhash"))) == sorted((d, f"{fps[d]:016x}", roots[d]) for d in fps)

    order = sorted(source)
    left = [(d, n, gone, spans, sha(kept)) for d, (n, gone, spans, kept) in zip(order, repeats([source[d] for d in order]))]
    assert sorted(map(tuple, run("op10_suffix_dedup"))) == left


def test_registry_names_an_operator_for_each_number():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
