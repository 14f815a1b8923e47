import collections
import math
import random
import string
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from parlance.llm import language, licences, quality, toxicity
from tests.llm.fixtures import WORDS, awkward, docs, labels, prose

SF = "/root/testdata/sf0.01"


def joined(spark, df, label):
    y = spark.read.parquet(f"{SF}/labels.parquet").where(F.col(label).isNotNull()).select("doc_id", F.col(label).alias("y"))
    return df.join(y, "doc_id").where("held_out").collect()


def auc(rows):
    good, bad = ([r["score"] for r in rows if r["y"] == y] for y in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize("module, label, fold, held, least", [(quality, "quality", 3, 1, 0.9), (toxicity, "toxic", 5, 0, 0.85)])
def test_held_out_labels(spark, module, label, fold, held, least):
    got = module.query(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.where(f"held_out <> (crc32(cast(doc_id as string)) % {fold} = {held}) or score < 0 or score > 1 or (score >= 0.5) <> (predicted = 1)").count() == 0
    assert auc(joined(spark, got, label)) >= least


def test_held_out_languages(spark):
    got = language.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    fine = [r for r in got if r["lang"] is not None and len(r["text"] or "") > 40]
    assert sum(r["lang_pred"] == r["lang"] for r in fine) / len(fine) >= 0.97


@pytest.mark.parametrize("rule", [lambda insult, group: insult and group, lambda insult, group: insult != group])
def test_pairs_of_terms_count(spark, rule):
    """Also where no sum of single weights can part the labels."""
    rows, marks = [], []
    for i in range(1600):
        insult, group = i % 2, i // 2 % 2
        rows.append((i, prose(i, 12) + (" grubber" if insult else "") + (" northfolk" if group else ""), "en", "web"))
        marks.append((i, 1, int(rule(insult, group))))
    model = toxicity.train(docs(spark, rows), labels(spark, marks))
    tests = [(1, "xy zw grubber northfolk", None, None), (2, "xy zw grubber", None, None), (3, "xy zw northfolk", None, None), (4, "xy zw", None, None)]
    got = dict(toxicity.score(docs(spark, tests), model).select("doc_id", "predicted").collect())
    assert got == {1: int(rule(1, 1)), 2: int(rule(1, 0)), 3: int(rule(0, 1)), 4: int(rule(0, 0))}


def spread(seed: int, n: int) -> str:
    """n words of a vocabulary of 5000."""
    r = random.Random(seed)
    return " ".join(f"{r.choice(WORDS)}{r.randrange(60)}" for _ in range(n))


@pytest.mark.parametrize("rule", [lambda insult, group: insult and group, lambda insult, group: insult != group])
def test_pairs_of_terms_count_among_many_words(spark, rule):
    """Unseen texts, of a vocabulary far too large for any list of chosen terms."""
    text = lambda i, insult, group: spread(i, 20) + (" grubber" if insult else "") + (" northfolk" if group else "") + " " + spread(-i, 8)
    rows = [(i, text(i, i % 2, i // 2 % 2), "en", "web") for i in range(5000)]
    marks = [(i, 1, int(rule(i % 2, i // 2 % 2))) for i in range(5000)]
    model = toxicity.train(docs(spark, rows), labels(spark, marks))
    got = dict(toxicity.score(docs(spark, [(i, text(9000 + i, i % 2, i // 2 % 2), None, None) for i in range(200)]), model).select("doc_id", "predicted").collect())
    assert sum(got[i] == int(rule(i % 2, i // 2 % 2)) for i in range(200)) >= 190


def test_score_is_the_sum_over_all_pairs():
    """Term by term and pair by pair, in plain Python."""
    r = np.random.default_rng(4)
    model = toxicity.Machine(0.3, r.normal(0, 0.3, (1 << toxicity.BITS, 1 + toxicity.RANK)), (1.5, -0.2))
    texts = [prose(1, 30), "", "Word word, (WORD) other.", prose(2, 5)]
    for first, x in toxicity.terms(pa.array(texts)):
        got = model(x)
        for i in range(len(texts)):
            own = [model.p[t].astype(float) for t in x.at[x.off[i] : x.off[i + 1]]]
            e = toxicity.SPREAD / (len(own) + toxicity.SHORT) ** 0.5
            raw = 0.3 + e * sum(o[0] for o in own) + e * e * sum(float(a[1:] @ b[1:]) for k, a in enumerate(own) for b in own[:k])
            assert abs(got[first + i] - 1 / (1 + np.exp(-(1.5 * raw - 0.2)))) < 1e-4
    assert len(next(toxicity.terms(pa.array(["Word word, (WORD) word."])))[1].at) == 1


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_awkward_rows(spark, module, label):
    marks = [(1, 1, 1), (2, 0, 0), (2, 1, 1), (None, 1, 1), (3, None, None), (4, 0, 0), (8, 0, 0), (12, 1, 0), (99, 1, 1), (5, 1, 1)]
    for table, given in ((docs(spark), labels(spark, marks)), (docs(spark), labels(spark, [])), (docs(spark), labels(spark, [(1, 1, 1)])), (docs(spark, []), labels(spark, marks))):
        got = module.score(table, module.train(table, given)).collect()
        assert len(got) == table.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["tokens"] == "mine" for r in got)
        assert len({r["score"] for r in got if not r["text"]}) <= 1


def test_languages_against_brute_force(spark):
    """Trigram by trigram, in plain Python, with the model's numbers."""
    rows = [(i, prose(i, 40) if i % 2 else "Ça va très bien, n'est-ce pas? Éléphants et " + prose(i, 12).replace("a", "à"), "en" if i % 2 else "fr", "a") for i in range(60)]
    df = docs(spark, rows)
    model = language.train(df)
    texts = [t for i, t, _, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]

    def features(text: str) -> collections.Counter:
        raw = text.encode()
        folded = [x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in raw]
        for i in range(1, len(raw)):
            if raw[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E:
                folded[i] += 32
        return collections.Counter(((folded[i] | folded[i + 1] << 8 | folded[i + 2] << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 20 for i in range(len(raw) - 2))

    df_of = collections.Counter(f for t in texts for f in features(t))
    assert all(math.isclose(model.idf[f], math.log((1 + len(texts)) / (1 + n)) + 1, rel_tol=1e-5) for f, n in df_of.items())
    for r in language.predict(df, model).collect():
        x = {f: math.log1p(n) * float(model.idf[f]) for f, n in features(r["text"]).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        cosines = [sum(v * float(c[f]) for f, v in x.items()) / norm for c in model.centres]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert r["lang_pred"] == model.langs[best] and abs(r["score"] - min(1, max(0, cosines[best]))) < 1e-4


def test_quality_against_brute_force(spark):
    """Block by block with compressors made anew, and the calibration written out."""
    rows = [(i, prose(i, 300) if i % 2 else " ".join(f"{i * k % 97}x" for k in range(200)), "en", "a") for i in range(90)] + [(200, None, None, None), (201, "", None, None)]
    df = docs(spark, rows)
    good, bad, w = quality.train(df, labels(spark, [(i, i % 2, 0) for i in range(90)]))
    for r in quality.score(df, (good, bad, w)).collect():
        raw = (r["text"] or "").encode()
        blocks = [raw[i : i + 1024] for i in range(0, len(raw), 1024)] or [b""]
        sizes = []
        for d in (good, bad):
            make = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False)
            sizes.append(sum(len(make.compress(b)) for b in blocks))
        difference, log = (sizes[1] - sizes[0]) / max(sizes), math.log1p(len(raw))
        raw_score = w[0] * 10 * difference + w[1] * 10 * difference * min(log, 8) / 8 + w[2] * sizes[0] / (len(raw) + 16) + w[3] * log / 8 + w[4]
        assert abs(r["score"] - 1 / (1 + math.exp(-raw_score))) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5)


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_repeated_ids_do_not_multiply_the_sample(spark, module, label):
    rows = [(i % 5, prose(i, 30), "en", "a") for i in range(200)]
    marks = [(i, i % 2, i % 2) for i in range(5)]
    assert module.labelled_texts(docs(spark, rows), labels(spark, marks), label, 7, 9, 100).count() == 5
    assert module.score(docs(spark, rows), module.train(docs(spark, rows), labels(spark, marks))).count() == 200


def test_awkward_languages(spark):
    model = language.train(docs(spark))
    got = {r["doc_id"]: r for r in language.predict(docs(spark), model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (5, 6, 7, 10))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1]["lang_pred"] in {"en", "de", "fr"}
    none = language.train(docs(spark, []))
    assert {r["lang_pred"] for r in language.predict(docs(spark), none).collect()} == {"und"}
    assert language.predict(docs(spark, []), model).count() == 0
    strange = language.predict(docs(spark, [(1, "漢字 " * 50, None, None)]), language.train(docs(spark, [(i, prose(i, 60), "en", "a") for i in range(60)])), reject=True).first()
    assert strange["rejected"] and strange["lang_pred"] == "und"


NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License, which lets others share it.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


@pytest.fixture(scope="module")
def licence_model(spark):
    rows = [*awkward(), *((100 + i, prose(i, 60), "en", "web") for i in range(60))]
    return licences.train(docs(spark, rows))


def test_licences(spark, licence_model):
    notices = {
        21: "Released under the MIT License.", 22: prose(7, 20) + "\n\nThis program is licensed under the GNU General Public License, version 2.\n\n" + prose(8, 30),
        23: "SPDX-License-Identifier: Apache-2.0", 24: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    }
    rows = [*awkward(), *((k, t, "en", "web") for k, t in notices.items()), *((100 + i, prose(i, 60), "en", "web") for i in range(60))]
    got = licences.find(docs(spark, rows), licence_model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[21]["families"] == ["mit"] and by[22]["families"] == ["gpl-2.0"] and by[23]["families"] == ["apache-2.0"] and by[24]["families"] == ["cc-by-sa"]
    assert any(f["paragraph"] == 1 and f["confirmed"] for f in by[22]["found"])
    assert all(not r["families"] for r in got if r["doc_id"] not in notices)
    assert licences.find(docs(spark, []), licences.train(docs(spark, []))).count() == 0


def test_wrapped_notices_in_comments_and_in_prose(spark, licence_model):
    rows, wanted = [], {}
    for i, (family, notice) in enumerate(NOTICES.items()):
        lines = textwrap.wrap(notice, 60)
        forms = [notice, "\n".join(lines), "# " + "\n# ".join(lines), "/*\n * " + "\n * ".join(lines) + "\n */", prose(i, 90) + " " + notice + " " + prose(i + 50, 90), prose(i, 30) + "\n\n// " + "\n// ".join(lines) + "\n\n" + prose(i + 9, 30)]
        for k, text in enumerate(forms):
            rows.append((10 * i + k, text, "en", "web"))
            wanted[10 * i + k] = [family]
    rows += [(900, "Licensed under the MIT License or the Apache License, Version 2.0, at your choice.", "en", "web"), (901, "The program is free and the license of the public is general. " + prose(3, 40), "en", "web")]
    wanted |= {900: ["apache-2.0", "mit"], 901: []}
    got = {r["doc_id"]: r["families"] for r in licences.find(docs(spark, rows), licence_model).collect()}
    assert got == wanted


def test_licences_against_brute_force(spark, licence_model):
    """Paragraphs, windows, sums of weights and shares of templates again, in plain Python; n-gram hashes are the operator's."""
    rows = [(i, t, None, None) for i, t in enumerate(NOTICES.values())] + [(20 + i, prose(i, 70) + "\n * \n" + "-- " + t + " " + prose(i, 50), None, None) for i, t in enumerate(NOTICES.values())]
    model = licence_model
    def plain(text):
        words = [w.strip(string.punctuation).lower() for w in text.replace("-", " ").split()]
        words = [w for w in words if w]
        return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}

    def pairs_of(t):
        own = licences.features([t])[0].tolist()
        return {g for g in own if g & 3 == 2} or set(own)

    templates = [(k, pairs_of(t), set(licences.keys(t)), plain(t)) for k, own in enumerate(licences.TEMPLATES.values()) for t in own]
    weights = dict(zip(model.known.tolist(), model.weights.astype(float), strict=True))
    got = {r["doc_id"]: [(f["paragraph"], f["family"], round(f["probability"], 3), round(f["similarity"], 6), f["confirmed"]) for f in r["found"]] for r in licences.find(docs(spark, rows), model).collect()}
    for i, text, _, _ in rows:
        paragraphs, now = [], []
        for line in text.split("\n"):
            words = [w for w in line.replace("-", " ").split() if w.strip(string.punctuation)]
            if not words and now:
                paragraphs.append(now)
                now = []
            now = now + words
        paragraphs += [now] if now else []
        best, chances = {}, {}
        for k, words in enumerate(paragraphs):
            for a in range(0, max(1, len(words) - licences.WIDTH + licences.STEP), licences.STEP):
                own = licences.features([" ".join(words[a : a + licences.WIDTH])])[0]
                p = 1 / (1 + np.exp(-model.heat * (sum((weights[g] for g in own.tolist() if g in weights), np.zeros(len(model.families))) + model.bias)))
                two = {g for g in own.tolist() if g & 3 <= 2}
                likely = np.flatnonzero(p[:-1] >= 0.5).tolist() if p[-1] < 0.5 else []
                for f in likely:
                    chances[k, f] = max(chances.get((k, f), 0), p[f])
                there_now = plain(" ".join(words[a : a + licences.WIDTH]))
                for f, t, must, whole in templates if likely else []:
                    if must <= there_now and len(t & two) / len(t) > best.get((k, f), (0,))[0]:
                        best[k, f] = len(t & two) / len(t), t & two, t, must, whole
        want = []
        for (k, f), chance in sorted(chances.items(), key=lambda x: (x[0][0], model.families[x[0][1]])):
            share, there, _, must, _ = best.get((k, f), (0.0, set(), set(), set(), set()))
            explained = any(j == k and g != f and s > share and len(there & t) >= 0.8 * len(there) and must <= whole for (j, g), (s, _, t, _, whole) in best.items())
            want.append((k, model.families[f], chance, round(share, 6), share >= 0.6 and not explained))
        assert [g[:2] + g[3:] for g in got[i]] == [w[:2] + w[3:] for w in want]
        assert np.allclose([g[2] for g in got[i]], [w[2] for w in want], atol=2e-3)


def test_licence_query_against_templates(spark):
    """Every document that holds a whole template line of more than five words is found with that family."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r["doc_id"]: r["families"] for r in licences.query(spark, SF).collect()}
    assert found.keys() == texts.keys()
    lines = {t: f for f, own in licences.TEMPLATES.items() for t in own if len(t.split()) > 5}
    missed = [(i, f) for i, text in texts.items() for line in text.split("\n") if (f := lines.get(line.strip())) and f not in found[i]]
    assert not missed


#: Texts of one notice, with the families that they name; versions and licences beside the known ones name none.
ONE_NOTICE = [
    ("Licensed under the Mozilla Public License, version 1.1.", []),
    ("This program is licensed under the GNU General Public License, version 1.", []),
    ("Licensed under CC BY-ND 4.0.", []),
    ("Licensed under CC BY-NC-ND 4.0.", []),
    ("Licensed under the Eclipse Public License, Version 1.0.", []),
    ("Licensed under the Apache License, Version 1.1.", []),
    ("Licensed under the Artistic License 2.0", []),
    ("SPDX-License-Identifier: Zlib", []),
    ("SPDX-License-Identifier: MPL-1.1", []),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", ["apache-2.0", "mit"]),
    ("SPDX-License-Identifier: Apache-2.0 OR MIT", ["apache-2.0", "mit"]),
    ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", ["gpl-3.0"]),
    ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", ["apache-2.0"]),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM', ["mit"]),
    ("License: MIT", ["mit"]),
    ("This project is MIT licensed.", ["mit"]),
    ("distributed under GPLv3", ["gpl-3.0"]),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["isc"]),
    ("This library is licensed under the GNU Lesser General Public License, version 3.", ["lgpl"]),
    ("Licensed under CC BY 4.0.", ["cc-by"]),
    ("SPDX-License-Identifier: GPL-2.0-only", ["gpl-2.0"]),
    ("License: BSD-2-Clause", ["bsd"]),
]


def test_versions_variants_expressions_and_bodies(spark):
    model = licences.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ONE_NOTICE)], "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in licences.find(df, model).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(ONE_NOTICE)] == ONE_NOTICE
