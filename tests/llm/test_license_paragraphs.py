"""Licence scans score every paragraph, whatever words it holds, and equal a plain computation of the model."""

from __future__ import annotations

import re

import numpy as np
import pytest

from tidemark.llm import licenses


def model(text):
    classes, weights = licenses.trained()
    z = sum(np.array(weights[g]) for g in licenses.grams(text) if g in weights)
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return (classes[int(p.argmax())] if p.max() >= licenses.LEAST_PROBABILITY else licenses.UNKNOWN), float(p.max())


def confirmed(text, family):
    """The template comparison, from its definition."""
    words = licenses.split(text)
    if family == licenses.UNKNOWN:
        return False
    if re.search(licenses.notices(family), " ".join(words)):
        return True
    own = {" ".join(words[k : k + 3]) for k in range(len(words) - 2)}
    return len(own) >= licenses.LEAST_SHINGLES and len(own & set(licenses.shingles_of(family))) >= licenses.CONFIRM * len(own)


def plain(rows):
    out = []
    for doc_id, text in rows:
        for k, x in enumerate(licenses.paragraphs(text.lower()) if text is not None else []):
            family, p = model(x)
            if family != licenses.UNKNOWN or any(a in x for a in licenses.ANCHORS):
                out.append((doc_id, k, family, pytest.approx(p, abs=2e-6), confirmed(x, family)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def scanned(df):
    return sorted(map(tuple, licenses.scan(df).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def families(spark, texts):
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return [next((v for (d, _), v in sorted(got.items()) if d == k), ("unknown", False)) for k in range(len(texts))]


def test_probes(spark):
    texts = [
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights',
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU\nGeneral Public License version 3",
        "The MIT professor discussed the copyright of the song.",
        "Er geht mit der Frau mit dem Hund.",
        "Some text before.\nReleased under the MIT License.\nSome text after.",
        "Commons, creative and by the sea, 4.0 attribution license under CC",
        "MIT License",
    ]
    got = families(spark, texts)
    assert got[:5] == [("bsd", True), ("isc", True), ("mit", True), ("mit", True), ("gpl", True)]
    assert got[5] == got[6] == ("unknown", False) and got[7] == ("mit", True) and not got[8][1] and got[9][0] == "mit"


def test_claims_without_an_anchor(spark):
    got = families(spark, ["Distributed under the terms of the MPL-2.0.", "This file is available under the MIT.", "one line.\nDedicated under MPL\n\nanother", "Distributed under the terms of the treaty."])
    assert got == [("mpl", True), ("mit", True), ("mpl", True), ("unknown", False)]


def test_equals_plain_computation(spark, docs):
    """Every paragraph of the documents, of random words of the model, and of all notices and texts, whole and wrapped."""
    words = sorted({w for x in licenses.trained()[1] for w in x.split()})
    rnd = np.random.default_rng(4)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(100_000 + k, " ".join(rnd.choice(words, rnd.integers(1, 30)))) for k in range(400)]
    rows += [(200_000 + k, x) for k, x in enumerate(n.format(x) for names in licenses.FAMILIES.values() for x in names for n in licenses.NOTICES)]
    body = [x for texts in licenses.TEXTS.values() for x in texts]
    rows += [(300_000 + k, x) for k, x in enumerate(body)] + [(400_000 + k, re.sub(r"((?:\S+ ){9})", r"\1\n", x)) for k, x in enumerate(body)]
    assert scanned(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_odd_rows(spark):
    long = ("Word after word. " * 20_000 + "\nLicensed under the MIT License.\n") * 2
    rows = [(1, None), (2, ""), (3, "\n\n \n"), (None, "All rights reserved."), (4, "All rights reserved."), (4, "All rights reserved."), (5, long), (6, "This small program is licensed to everyone under\r\nthe MIT License.\r\nEnd.\r\n")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, paragraph int, family string")
    got = scanned(df)
    assert got == plain(rows) and len(got) >= 6 and (None, 0) in {r[:2] for r in got}
    assert scanned(df.where("doc_id = -1")) == []


def test_left_out_words_prove_the_unknown_class():
    """Whatever a paragraph holds, the gains of its features are at most the worth of its words, and less than the room is the unknown class."""
    classes, weights = licenses.trained()
    t = licenses.tables()
    number = {w: k for k, w in enumerate(t.words) if w}
    assert len(number) == len({w for x in weights for w in x.split()})
    rnd = np.random.default_rng(7)
    words = sorted(number)
    for k in range(300):
        text = " ".join(rnd.choice(words, rnd.integers(1, 12)))
        gains = sum(max(0.0, *(w - weights[g][-1] for w in weights[g][:-1])) for g in licenses.grams(text) if g and g in weights)
        worth = sum(t.worth[number[w]] for w in set(licenses.split(text)) if w in number)
        assert gains <= worth + 1e-6
        if worth < t.room - 1e-6:
            assert model(text)[0] == licenses.UNKNOWN


def test_no_python_and_no_shuffle(spark, docs):
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange", "Join"))
