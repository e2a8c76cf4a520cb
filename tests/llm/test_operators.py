"""Operators against brute force, and what they do with nulls, empty texts and tables, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import queries as Q
from orrery.llm.common import id_fold

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, n_tokens string, digest string, label int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, "one two three"), (None, "stray words here"), (None, None), (5, " \n\t "), (6, "12 345 !!"), (7, "long words " * 30000), (8, "a  b   c \n d"), (9, "x<|endoftext|>y İstanbul ﬁn 中文 текст"), (10, "All rights reserved.\nReleased under the MIT License. Free")]
    return spark.createDataFrame([(i, t, None, "s", 1, "old", "old", "old", "old", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ppm_by_hand(train, texts, order=5):
    """PPM with method D and full exclusion, symbol by symbol over a dictionary trie."""
    trie = defaultdict(Counter)
    for t in train:
        b = b"\xfe" * order + t.encode() + b"\xff"
        for i in range(order, len(b)):
            for k in range(order + 1):
                trie[b[i - k : i]][b[i]] += 1
    out = []
    for t in texts:
        b, total = b"\xfe" * order + t.encode() + b"\xff", 0.0
        for i in range(order, len(b)):
            excluded = set()
            for k in range(order, -1, -1):
                seen = {s: n for s, n in trie.get(b[i - k : i], {}).items() if s not in excluded}
                if not seen:
                    continue
                all_ = sum(seen.values())
                if b[i] in seen:
                    total += math.log10((seen[b[i]] - 0.5) / all_)
                    break
                total += math.log10(len(seen) / 2 / all_)
                excluded |= seen.keys()
            else:
                total += math.log10(1 / (257 - len(excluded)))
        out.append(total)
    return out


def test_lm_scores_equal_brute_force(spark, docs, monkeypatch):
    from orrery.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "PIECE_BYTES", 500)
    some = docs.where("doc_id < 60")
    got = {r["doc_id"]: r for r in lm_scoring.score_texts(some, id_fold(F.col("doc_id"), 10) != 0, block_bytes=20_000).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in some.collect()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 10}
    counts = Counter()
    for i in train:
        counts.update(WORD.findall(lower(texts[i])))
        counts["\0end"] += 1
    n, v = sum(counts.values()), len(counts)
    scores = dict(zip(texts, ppm_by_hand([texts[i] for i in train], texts.values()), strict=True))
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        words = [*WORD.findall(lower(t)), "\0end"]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in train, len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
        assert r["score"] == pytest.approx(scores[i])


def test_lm_scores_of_odd_rows(spark, odd):
    from orrery.llm.lm_scoring import score_texts

    rows = score_texts(odd, F.lit(True)).collect()
    assert len(rows) == odd.count() and all(r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 5)} == {1}
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {4}
    assert score_texts(odd.limit(0), F.lit(True)).count() == 0
    none = score_texts(odd.where("doc_id = 3"), F.lit(False)).collect()
    assert [r["score"] for r in none] == pytest.approx([14 * math.log10(1 / 257)] * 2)


def test_shards_are_exact_and_stable(spark, docs, odd):
    from orrery.llm.shuffle import uniform_shards

    for df, rows in ((docs, 7), (odd, 3), (odd, 4096)):
        got = uniform_shards(df, cell_rows=rows).select("doc_id", "shard", "slot").collect()
        assert len(got) == df.count()
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in by.values())
        sizes = [len(by[k]) for k in range(16)]
        assert max(sizes) - min(sizes) <= 1
    again = uniform_shards(docs.repartition(5), cell_rows=7).select("doc_id", "shard", "slot").collect()
    assert sorted(again) == sorted(uniform_shards(docs, cell_rows=7).select("doc_id", "shard", "slot").collect())
    assert uniform_shards(odd.limit(0)).count() == 0


def test_a_row_meets_few_cells():
    """A slice lists no more cells than it has ranks, however many cells there are."""
    from orrery.llm.shuffle import SLICE, slices

    rng = np.random.default_rng(1)
    for cells in (1, 50, 5000, 10_000):
        sizes = rng.integers(1, 4, cells) if cells > 1 else np.array([7000])
        stop = np.cumsum(sizes)
        cut = slices(stop, np.arange(cells))
        assert max(map(len, cut)) <= SLICE
        for rank in rng.integers(0, stop[-1], 200):
            assert next(x["cell"] for x in cut[rank // SLICE] if rank < x["stop"]) == np.searchsorted(stop, rank, "right")


def test_communication_matrix_follows_the_law():
    from orrery.llm.shuffle import matrix_row

    parts, cells = np.array([5, 0, 3, 8]), np.array([4, 6, 6])
    total = np.zeros((4, 3))
    for seed in range(3000):
        m = np.array([matrix_row(parts, cells, p, seed) for p in range(4)])
        assert (m.sum(1) == parts).all() and (m.sum(0) == cells).all()
        total += m
    assert np.allclose(total / 3000, np.outer(parts, cells) / 16, atol=0.1)


def test_packing_is_exact_best_fit(spark, odd):
    from orrery.llm.packing import best_fit_runs, pack

    rng = np.random.default_rng(1)
    for limit in (7, 30, 100):
        lengths = rng.integers(1, limit + 1, 300)
        histogram = dict(Counter(lengths.tolist()))
        bins = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, left in enumerate(bins) if left >= n]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= n
            else:
                bins.append(limit - n)
        runs, held = best_fit_runs(histogram, limit), defaultdict(list)
        for length, rank, count, first, offset in runs:
            for k in range(count):
                held[first + k].append((offset, length))
        assert len(held) == len(bins)
        assert sorted(limit - sum(x for _, x in v) for v in held.values()) == sorted(bins)
        for v in held.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
        assert Counter(x for v in held.values() for _, x in v) == histogram


def check_packing(rows, texts, tokenizer, limit):
    by = defaultdict(list)
    seqs = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        at = 0
        for k, p in enumerate(pieces):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            assert p["length"] == limit or k == 0
            at += p["length"]
        assert at == len(ids)
    for v in seqs.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= limit


def test_packing_query(spark, docs, odd):
    from tokenizers import Tokenizer

    from orrery.llm.packing import pack

    tokenizer = Tokenizer.from_file(Q.tokenizer_file("byte_bpe_50k.json"))
    check_packing(Q.op10_packing(spark, SF).collect(), {r["doc_id"]: r["text"] for r in docs.collect()}, tokenizer, 2048)
    unique = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    for ranks in (None, Q.tokenizer_file("byte_bpe_50k.tiktoken")):
        check_packing(pack(unique, Q.tokenizer_file("byte_bpe_50k.json"), ranks, limit=100).collect(), {r["doc_id"]: r["text"] for r in unique.collect()}, tokenizer, 100)
    assert pack(odd.limit(0), Q.tokenizer_file("byte_bpe_50k.json")).count() == 0
    assert pack(odd, Q.tokenizer_file("byte_bpe_50k.json")).where("doc_id = 3").count() == 2


def test_token_counts_and_cache(spark, docs, odd, tmp_path):
    from tokenizers import Tokenizer

    from orrery.llm.token_counts import token_counts

    path = Q.tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        for df in (docs, odd, odd.limit(0)):
            got = token_counts(df, path, cache).select("doc_id", "text", "n_bytes", "n_tokens", "over_limit").collect()
            assert len(got) == df.count()
            for r in got:
                n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False))
                assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 2048)
    # the second round missed nothing: every distinct text was stored once
    stored = spark.read.parquet(cache)
    assert stored.count() == docs.union(odd.select(docs.columns)).select(F.coalesce("text", F.lit(""))).distinct().count()


def test_token_query_hits_a_lasting_cache(spark, tmp_path):
    """The second run of the query reads every count from the cache that the session names and appends nothing."""
    spark.conf.set("spark.orrery.tokenCache", f"file://{tmp_path}/cache")
    try:
        first = sorted(Q.op6_token_counts(spark, SF).collect(), key=str)
        stored = spark.read.parquet(f"file://{tmp_path}/cache").count()
        assert sorted(Q.op6_token_counts(spark, SF).collect(), key=str) == first
        assert spark.read.parquet(f"file://{tmp_path}/cache").count() == stored > 0
        # what the cache says is what the query returns
        odd = spark.read.parquet(f"file://{tmp_path}/cache").withColumn("n_tokens", F.lit(7).cast("long"))
        odd.write.parquet(f"file://{tmp_path}/odd")
        spark.conf.set("spark.orrery.tokenCache", f"file://{tmp_path}/odd")
        assert {r["n_tokens"] for r in Q.op6_token_counts(spark, SF).collect()} == {7}
    finally:
        spark.conf.unset("spark.orrery.tokenCache")


def test_archive_round_trip(spark, tmp_path):
    from orrery.llm.warc import read_archive, record_fields, write_archive

    big = "<p>é" * 400
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, big), (4, "http://c/", "small"), (5, "http://d/", "small"), (6, "u\r\nX: y", None), (None, "http://e/", big), (7, "http://f/", "x\r\n\r\ny"), (4, "http://c/", "small")]
    pages = spark.createDataFrame([(i, u, h, "zz", "zz") for i, u, h in rows], "page_id long, url string, html string, digest string, payload string")
    for p, name in ((pages, "a"), (pages.limit(0), "b")):
        path = f"file://{tmp_path}/{name}"
        write_archive(p, path)
        got = read_archive(spark, path)
        assert sorted((r["page_id"] or 0, bytes(r["payload"])) for r in got.collect()) == sorted((r["page_id"] or 0, (r["html"] or "").encode()) for r in p.collect())
    got = read_archive(spark, f"file://{tmp_path}/a")
    for r in got.collect():
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert len(body) == size + 4 and body.endswith(b"\r\n\r\n")
    fields = {(r["page_id"], r["record_type"], r["refers_to"]) for r in record_fields(got).collect()}
    assert {(3, "response", None), (1, "revisit", 3), (2, "revisit", 3), (4, "response", None), (5, "response", None), (None, "revisit", 3)} <= fields
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in Q.op8_warc_archive(spark, SF).collect():
        b = html.pop(r["page_id"]).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), hashlib.sha1(b).hexdigest())
    assert not html


def test_damaged_payload_is_found(spark, tmp_path):
    from orrery.llm.warc import read_archive, write_archive

    path = f"file://{tmp_path}/x"
    write_archive(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"g")).write.parquet(f"{path}2/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}2/records")
    with pytest.raises(Exception, match="digest"):
        read_archive(spark, f"{path}2").collect()


def test_licences(spark, odd):
    from orrery.llm.licenses import scan_licences

    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted:\nRedistributions of source code must retain the above copyright notice;\nRedistributions in binary form must reproduce the above copyright notice."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    texts = [bsd, mit, "x.\nLicensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "the licence is here", None]
    got = [r["licences"] for r in scan_licences(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [["BSD-2-Clause"], ["MIT"], ["Apache-2.0", "CC-BY-NC-4.0"], [], []]
    rows = scan_licences(odd.withColumn("licences", F.lit(1))).collect()
    assert len(rows) == odd.count() and [r["licences"] for r in rows if r["doc_id"] == 10] == [["LicenseRef-all-rights-reserved", "MIT"]]
    assert scan_licences(odd.limit(0)).count() == 0


MIT = """MIT License

Copyright (c) 2022 Someone
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD2 = """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = (
    BSD2
    + """
3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
)
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
GPL2 = GPL.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2")
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"""
APACHE = """# Licensed under the Apache License,
# Version 2.0 (the "License"); you may not use this file
# except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0"""


LGPL = GPL.replace("program", "library", 1).replace("software:", "software;").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")
AGPL = GPL.replace("GNU General", "GNU Affero General")
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"""
ZERO = ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", "")
UNLICENSE = "This is free and unencumbered software released\ninto the public domain.\n\nAnyone is free to copy it."
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""


def test_licences_of_more_standard_texts(spark):
    """Other families, and spaces, hyphens or marks of any number between words, which normalising makes one space."""
    from orrery.llm.licenses import scan_licences

    cases = [(LGPL, ["LGPL-2.1"]), (AGPL, ["AGPL-3.0"]), (ISC, ["ISC"]), (ZERO, ["0BSD"]), (UNLICENSE, ["Unlicense"]), (ZLIB, ["Zlib"]), ("All  rights -- reserved.", ["LicenseRef-all-rights-reserved"]), (GPL.replace("free software", "free   software"), ["GPL-3.0"])]
    got = [r["licences"] for r in scan_licences(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [x for _, x in cases]


def test_licences_of_wrapped_standard_texts(spark):
    from orrery.llm.licenses import scan_licences

    cases = [(MIT, ["MIT"]), (BSD2, ["BSD-2-Clause"]), (BSD3.format("the copyright holder"), ["BSD-3-Clause"]), (BSD3.format("the University of\n   Somewhere"), ["BSD-3-Clause"]), (GPL, ["GPL-3.0"]), (GPL2, ["GPL-2.0"]), (MPL, ["MPL-2.0"]), (APACHE, ["Apache-2.0"])]
    cases += [(t.replace("\n", "\r\n"), x) for t, x in cases] + [("words before\nLicensed under CC BY 4.0\nwords after", ["CC-BY-4.0"]), ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License.", ["GPL-1.0-or-later"])]
    got = [r["licences"] for r in scan_licences(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [x for _, x in cases]
    full = scan_licences(spark.createDataFrame([(0, MIT)], "doc_id long, text string")).first()
    assert full["sentence_ids"] == ["MITPermission", "MITNotice", "MITWarranty"]


def test_licence_hints_hold_for_every_sentence(spark):
    from orrery.llm.licenses import OWNER, SENTENCES, hints, scan_licences

    assert all(any(w in s.replace(OWNER, "Acme").split() for w in hints()) for s in SENTENCES)
    texts = [s.replace(OWNER, "Acme Inc").replace("spdx license identifier ", "SPDX-License-Identifier: ").upper() for s in SENTENCES]
    rows = scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["sentence_ids"] for r in rows] == [[i] for i in SENTENCES.values()]


def test_licences_with_owner_reservation_and_tag(spark):
    from orrery.llm.licenses import scan_licences

    head = "Copyright (c) 2020, Someone\nAll rights reserved.\n\n"
    cases = [
        ("Neither the name of Acme nor the names of its contributors may be used to endorse or promote products.", ["BSDEndorse"], []),
        (head + BSD2, None, ["BSD-2-Clause"]), (head + BSD3.format("Acme"), None, ["BSD-3-Clause"]), (head + MIT, None, ["MIT"]), (head, ["AllRights"], ["LicenseRef-all-rights-reserved"]),
        ("// SPDX-License-Identifier: Apache-2.0\n", ["SPDX:Apache-2.0"], ["Apache-2.0"]), ("/* SPDX-License-Identifier: MIT */", None, ["MIT"]), ("Distributed under the Boost Software License, Version 1.0.", None, ["BSL-1.0"]),
        ("All soft.ware rights. All rights res.erved.", ["AllRights"], ["LicenseRef-all-rights-reserved"]),
    ]
    got = scan_licences(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licences"] for r in got] == [x for _, _, x in cases]
    assert all(ids is None or r["sentence_ids"] == ids for r, (_, ids, _) in zip(got, cases, strict=True))


def test_archive_tells_null_from_minus_one(spark, tmp_path):
    from orrery.llm.warc import read_archive, record_fields, write_archive

    write_archive(spark.createDataFrame([(-1, "u", "x" * 1500), (None, "u", "x" * 1500), (None, "v", "é" * 4_000_000)], "page_id long, url string, html string"), str(tmp_path / "a"))
    got = {(r["page_id"], r["payload_bytes"]): (r["record_type"], r["refers_to"]) for r in record_fields(read_archive(spark, str(tmp_path / "a"))).collect()}
    assert got == {(-1, 1500): ("response", None), (None, 1500): ("revisit", -1), (None, 8_000_000): ("response", None)}


def test_repeated_rows_are_dealt_over_all_partitions(spark, tmp_path):
    from orrery.llm.shuffle import row_identity, uniform_shards

    spark.range(100_000).select(F.lit(7).alias("doc_id"), F.lit("again").alias("text")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert df.select(F.pmod(F.xxhash64(*row_identity(df, "doc_id", "text")), F.lit(100)).alias("p")).groupBy("p").count().agg(F.max("count")).first()[0] < 1300
    out = uniform_shards(df)
    got = out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert len(got) == 16 and all(r["n"] == r["slots"] == r["last"] + 1 == 6250 for r in got)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def plain_language(net, text):
    """The network over one whole text, filter by filter and place by place."""
    from orrery.llm.language import windows

    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    total, weights = np.zeros(len(net.languages)), 0.0
    for window in windows(text, net.length):
        pooled = []
        for w in net.widths:
            for f in range(net.p[f"b{w}"].shape[0]):
                outs = []
                for at in range(net.length - w + 1):
                    outs.append(sum(float(net.p["emb"][window[at + j]] @ net.p[f"w{w}"][j][:, f]) for j in range(w)))
                pooled.append(max(max(outs) + float(net.p[f"b{w}"][f]), 0.0))
        z = np.array(pooled) @ net.p["out"].astype(float) + net.p["bias"]
        weight = float((np.asarray(window) > 0).sum()) + 1e-3
        total += weight * (z - z.max() - np.log(np.exp(z - z.max()).sum()))
        weights += weight
    q = np.exp(total / weights - (total / weights).max())
    return net.languages[int(q.argmax())], float(q.max() / q.sum())


def test_language_equals_plain_network(spark, docs):
    """Prediction and score of whole texts, of ties and of texts of many windows among them."""
    from orrery.llm.language import identify, train

    net = train(docs.where("doc_id % 3 = 0"), per_language=60)
    long = docs.where(F.length("text") > 3000).limit(2).select("text")
    texts = [r["text"] for r in docs.where(F.length("text") < 500).limit(6).select("text").union(long).collect()]
    texts += [None, "", "12 34", "a", "a", "é", "Straße 中文", "x " * 200, "\u00df" * 64, "ab" * 65]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(rows, net).collect()}
    for i, text in enumerate(texts):
        lang, score = plain_language(net, text)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=2e-4), text


def test_language_gradients_and_tables():
    from orrery.llm.language import ByteNet

    rng = np.random.default_rng(0)
    net = ByteNet(["a", "b", "c"], length=12)
    ids, label = rng.integers(0, 155, (9, 12)).astype(np.uint8), rng.integers(0, 3, 9)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, grad = net.step(ids, label)
    for k, v in net.p.items():
        at = np.unravel_index(np.abs(grad[k]).argmax(), v.shape)
        old = v[at]
        v[at] = old + 1e-5
        up = net.step(ids, label)[0]
        v[at] = old - 1e-5
        down = net.step(ids, label)[0]
        v[at] = old
        assert (up - down) / 2e-5 == pytest.approx(grad[k][at], rel=1e-2, abs=1e-5)
    log = net.log_probabilities(ids, net.tables())
    assert -log[np.arange(9), label].mean() == pytest.approx(net.step(ids, label)[0], rel=1e-4)


def test_language_accuracy_and_odd_rows(spark, docs, odd):
    from orrery.llm.language import identify, train

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = Q.op5_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    net = train(docs)
    got = {r["doc_id"]: r for r in identify(odd, net).collect() if r["doc_id"]}
    marks = spark.createDataFrame([(i, t) for i, t in enumerate(["½", "²", "①", "12 ½ Ⅷ", "é", "ª"])], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in identify(marks, net).orderBy("doc_id").collect()] == [True] * 4 + [False] * 2
    assert [got[i]["lang_pred"] for i in (1, 2, 5, 6)] == ["und"] * 4 and all(0 <= r["score"] <= 1 for r in got.values())
    assert identify(odd.limit(0), net).count() == 0
    assert {r["lang_pred"] for r in identify(odd, train(odd)).collect()} == {"und"}
