"""Licence scans with a trained paragraph classifier, in DataFrame functions on the main path.

A paragraph is what stands between blank lines, cut after lines that end a sentence or are shorter than 40 characters
(too short to have been wrapped), so that a notice wrapped over several lines is one paragraph and a notice on a line of
its own is one too. A sparse (L1) multinomial logistic
regression over word 1- to 3-grams tells licence families apart, with a class for unknown licences; its temperature is
fitted on held-out training rows. It is trained on the driver from the notices below and pieces of the licence texts, a
set of fixed size that does not grow with the data.

Every paragraph is scored where it is read, without a join or a shuffle: its words become numbers of the model's words,
runs of those become the paragraph's features, and the features' weights are summed. The model's tables are literals of
bounded size (MODEL_FEATURES), laid out in hash buckets. A paragraph whose features cannot add up to a family, whatever
the family, is of the unknown class by the weights themselves, and its thirteen sums are not made. A prediction is
confirmed by the templates of its family: a notice with one of its names stands in the paragraph word for word, or most
of the paragraph's word 3-grams are in one of its texts.

Defined results: null and empty texts have no paragraphs and give no rows; a paragraph is reported when it has a family,
or when it is of the unknown class and holds one of ANCHORS; a paragraph without known n-grams is of the unknown class;
repeated rows give repeated results; null ids are carried; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache, reduce

import numpy as np
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEXTS

# Licence families with names that notices use, notice patterns, and texts that claim another licence or none.
FAMILIES = {
    "apache": ["Apache License", "Apache License, Version 2.0", "Apache 2.0", "Apache-2.0", "Apache Software License"],
    "mit": ["MIT License", "MIT", "MIT/X11 License", "Expat License", "the MIT licence"],
    "isc": ["ISC License", "ISC", "the ISC licence"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD-2-Clause", "BSD-3-Clause", "New BSD License", "Simplified BSD License"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GPL", "GPLv3", "GPL-3.0", "GPL-2.0-or-later"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL", "LGPL-2.1", "LGPLv3"],
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL", "AGPL-3.0", "AGPLv3"],
    "mpl": ["Mozilla Public License", "Mozilla Public License, version 2.0", "MPL", "MPL-2.0"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 3.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 3.0", "CC BY-NC-SA 4.0"],
    "public-domain": ["CC0", "CC0 1.0", "CC0-1.0", "Unlicense", "public domain", "Creative Commons Zero"],
    "all-rights-reserved": ["all rights reserved", "All Rights Reserved."],
}
NOTICES = [
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.",
    "Distributed under the terms of the {}.", "SPDX-License-Identifier: {}", "This file is available under the {}.", "License: {}", "Copyright 2019 the authors. {}.",
    "This program is free software under the {}", "Copyright (c) 2021 Example. Released under {}.", "You may use this under the {} license.", "Dedicated under {}", "{}",
]
OTHER_NAMES = ["Acme Community License", "Foo Public License", "Custom License, version 1", "Vendor Source License", "Zeta License 2.0", "Old Map Data Licence", "Game Asset License"]
NO_LICENCE = [
    "The driver's license was taken away.", "A fishing licence is required here.", "She holds a license to practise medicine.", "Copyright law is a hard subject.", "The license plate was found.",
    "The pub lost its licence last year.", "Poetic license is granted to poets.", "Copyright notices must be kept.", "They licensed the song to a film.", "A software license costs money.",
    "Sie fahren mit dem Zug und er kommt mit.", "Ein Haus mit Garten.", "Er spricht mit der Frau.", "Wir gehen mit ihm nach Hause.", "Kaffee mit Milch, bitte.", "Das Kind spielt mit einem Ball.", "Was ist mit den anderen?", "Komm mit!",
    "Entry is free of charge for children under six.", "Permission to build the house was granted by the council.", "She made two copies of the letter and kept the other.", "They may use the garden without restriction.", "The following conditions were hard to meet.",
    "The warranty of the car is limited to three years.", "He is not liable for the damages of the storm.", "You can obtain a copy of the map at the station.", "The library is open to any person.", "In the event of rain the match is off.", "The author published the second edition in 2001.",
    "She studied at MIT for two years.", "A cup of coffee for the new neighbours.", "He sat under the tree by the river.", "The version of the story is free for all.", "The software is available to the public.",
]
#: What a claim of an unknown licence holds. Paragraphs of the unknown class without it make no claim and are not reported.
ANCHORS = ["licen", "copyright", "spdx", "rights reserved", "public domain", "gpl", "creative commons", "cc by", "cc-by", "cc0", "apache", "bsd", "mozilla", "mit/x11", "released under"]
#: Words of licence names, and prose that they stand in without a claim.
NAME_WORDS = ["MIT", "BSD", "GPL", "LGPL", "AGPL", "MPL", "Apache", "Mozilla", "GNU", "Creative Commons", "Expat", "Unlicense"]
PROSE = [
    "The {} people met again.", "A {} speaker talked of the law and the copyright.", "We saw {} on the way.", "The history of {} is long.", "He wrote to {} about the song.", "Under {} the work went on.",
    "The {} team was tired of the long debate.", "The {} teacher asked a question.", "A student of {} read the story aloud.", "They left {} in the evening and walked home.", "The {} museum shows old maps of the city.", "At {} she met the author of the book.",
]
#: Words that are common in any text. N-grams of these alone are no features.
COMMON = set("a about above after all also an and any are as at be been but by can could do each for from had has have he her his i if in into is it its last made may more must my new no not of off old on one only or other our out over own p s said same see she so some such than that the their them then there these they this those through time to two under up us use was way we were what when where which who will with work would year you your 1 2 3 4".split())
UNKNOWN = "unknown"
#: Most n-grams with a weight; longest n-gram; least probability of a prediction; weight of the L1 penalty; steps of the fit; decimals of a weight.
MODEL_FEATURES, LONGEST, LEAST_PROBABILITY, PENALTY, STEPS, DECIMALS = 5_000, 3, 0.5, 5e-5, 400, 4
#: Hash buckets of the model's words (at least; numbers of words stay below 2 ** 16) and of its n-grams, and places of the latter.
WORD_BUCKETS, GRAM_BUCKETS, SLOTS = 1 << 14, 2048, 10
#: What ends a paragraph, and a word of one.
BREAK, WORD = r"\n(?:(?<=[.!?:;]\r?\n)|(?<=(?:^|\n)[^\n]{0,39}\n)|[ \t\r]*\n)", r"[a-z0-9]+(?:\.[0-9]+)*"
#: Shingle of the template comparison in words; least share of a paragraph's shingles in the family's texts, and least number.
SHINGLE, CONFIRM, LEAST_SHINGLES = 3, 0.8, 3


def split(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def paragraphs(text: str) -> list[str]:
    return regex.split(BREAK, text)


def pieces(text: str) -> list[str]:
    """Lines as a text may be wrapped to."""
    w = split(text)
    return [" ".join(w[at : at + n]) for n in (8, 12, 20) for at in range(0, max(len(w) - n, 0) + 4, 4)] + [" ".join(w)]


def notices(family: str) -> str:
    """A regular expression over words joined by blanks: a notice with one of the family's names. A name of one word alone must be all there is."""
    found = {" ".join(split(n.format(x))) for x in FAMILIES[family] for n in NOTICES}
    inside, whole = sorted(x for x in found if " " in x), sorted(x for x in found if " " not in x)
    parts = ["(?:^| )(?:" + "|".join(map(re.escape, inside)) + ")(?: |$)"] if inside else []
    return "|".join(parts + ["^(?:" + "|".join(map(re.escape, whole)) + ")$"] * bool(whole)).replace("\\ ", " ")


def shingles_of(family: str) -> list[str]:
    w = [split(x) for x in TEXTS.get(family, [])]
    return sorted({" ".join(x[k : k + SHINGLE]) for x in w for k in range(len(x) - SHINGLE + 1)})


def grams(text: str) -> set[str]:
    w = split(text)
    return {" ".join(w[k : k + n]) for n in range(1, LONGEST + 1) for k in range(len(w) - n + 1)} | {""}


@lru_cache(maxsize=1)
def trained() -> tuple[list[str], dict[str, list[float]]]:
    """Class names, and the temperature-scaled weights of each n-gram ("" is the bias)."""
    classes = [*FAMILIES, UNKNOWN]
    none = len(classes) - 1
    # a name of one word by itself claims nothing
    said = [(n, name, k) for k, names in enumerate(FAMILIES.values()) for name in names for n in NOTICES]
    rows = [(grams(n.format(name)), none if len(split(n.format(name))) == 1 else k) for n, name, k in said for _ in range(2 if len(split(n.format(name))) in (2, 3) else 1)]
    rows += [(grams(x), none) for x in NAME_WORDS]
    rows += [(grams(name), k) for k, names in enumerate(FAMILIES.values()) for name in names if len(split(name)) > 1 for _ in range(4)]
    rows += [(grams(n.format(x)), none) for x in OTHER_NAMES for n in NOTICES] + [(grams(x), none) for x in NO_LICENCE for _ in range(8)]
    rows += [(grams(p.format(x)), none) for x in NAME_WORDS for p in PROSE for _ in range(3)]
    # a line that several families' texts hold is of the first one
    whole = {f: " | ".join(" ".join(split(x)) for x in texts) for f, texts in TEXTS.items()}
    body = [(piece, next(f for f, x in whole.items() if piece in x)) for texts in TEXTS.values() for x in texts for piece in pieces(x)]
    rows += [(grams(piece), classes.index(f)) for piece, f in body]
    # the same words in any order are no licence: what tells a text is how its words follow each other
    mixed = random.Random(6)
    words = [x for piece, _ in body for x in piece.split()]
    rows += [(grams(" ".join(mixed.sample(words, len(piece.split())))), none) for piece, _ in body]
    rows += [(grams(n.format("")), none) for n in NOTICES for _ in range(4)]
    random.Random(5).shuffle(rows)
    counts: dict[str, int] = {}
    for g, _ in rows:
        for x in g:
            if not x or not COMMON.issuperset(x.split()):
                counts[x] = counts.get(x, 0) + 1
    vocab = {x: k for k, x in enumerate(sorted(sorted(counts), key=lambda x: -counts[x])[:MODEL_FEATURES])}
    X, y = np.zeros((len(rows), len(vocab)), np.float32), np.array([k for _, k in rows])
    for r, (g, _) in enumerate(rows):
        X[r, [vocab[x] for x in g if x in vocab]] = 1
    held = np.arange(len(rows)) % 5 == 0
    T, D = X[~held], np.eye(len(classes), dtype=np.float32)[y[~held]]
    v = np.ones(len(vocab), np.float32)
    for _ in range(20):  # the largest singular value bounds the step
        v = T.T @ (T @ v)
        v /= np.linalg.norm(v)
    step = 2 * len(T) / float(np.linalg.norm(T @ v)) ** 2
    W = ahead = np.zeros((len(vocab), len(classes)), np.float32)
    pace = 1.0
    for _ in range(STEPS):  # accelerated proximal gradient
        now = ahead - step * (T.T @ (_softmax(T @ ahead) - D) / len(T))
        now = np.sign(now) * np.maximum(np.abs(now) - step * PENALTY, 0)
        quicker = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = (now + (pace - 1) / quicker * (now - W)).astype(np.float32)
        W, pace = now, quicker
    scales = np.exp(np.linspace(-1, 1.5, 26))
    best = min(scales, key=lambda s: -np.log(_softmax(s * (X[held] @ W).astype(float))[np.arange(held.sum()), y[held]] + 1e-12).mean())
    W = np.round(W.astype(float) * best, DECIMALS)
    return classes, {x: W[k].tolist() for x, k in vocab.items() if x == "" or W[k].any()}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def hashed(raw: bytes) -> int:
    """Spark's xxhash64 of a string's bytes, or of a long's."""
    return (xxhash.xxh64_intdigest(raw, seed=42) + (1 << 63)) % (1 << 64) - (1 << 63)


class Tables:
    """The model as literals: a table of words without collisions, buckets of n-grams (as numbers made of their words' numbers), and what each adds.

    gain: the most that an n-gram gives any family over the unknown class. worth: by word, the gains of the n-grams that
    are counted under it, each under one of its words, a rare one if it has any; an n-gram can only stand where its word
    does. room: what the bias keeps between the unknown class and any family.
    """

    def __init__(self, weights: dict[str, list[float]]):
        self.bias = weights[""]
        words = sorted({w for x in weights for w in x.split()})
        size = WORD_BUCKETS
        while len({hashed(w.encode()) % size for w in words}) < len(words):
            size += 1
        if size >= 1 << 16:
            raise ValueError("no table of words without collisions")
        number = {w: hashed(w.encode()) % size + 1 for w in words}
        self.words = [""] * size
        for w, k in number.items():
            self.words[k - 1] = w
        grams: list[list[tuple[int, str]]] = [[] for _ in range(GRAM_BUCKETS)]
        for x in sorted(weights):
            if x:
                key = sum(number[w] << 16 * k for k, w in enumerate(x.split()))
                grams[hashed(key.to_bytes(8, "little")) % GRAM_BUCKETS].append((key, x))
        if max(map(len, grams)) > SLOTS:
            raise ValueError("a bucket of the model is full")
        self.grams = [k for b in grams for k in [*(k for k, _ in b), *[0] * (SLOTS - len(b))]]
        self.base = np.cumsum([0, *map(len, grams)])[:-1].tolist()
        rows = [(x, weights[x]) for b in grams for _, x in b]
        self.flat = [w for _, row in rows for w in row]
        self.gain = [round(max(0.0, *(w - row[-1] for w in row[:-1])), DECIMALS) for _, row in rows]
        self.room = min(self.bias[-1] - b for b in self.bias[:-1])
        worth = np.zeros(size)
        for (x, _), gain in zip(rows, self.gain):
            worth[number[min(x.split(), key=lambda w: (w in COMMON, w))] - 1] += gain
        self.worth = worth.round(DECIMALS).tolist()


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables(trained()[1])


def literal(values: list, kind: str) -> Column:
    """A literal array, folded by the optimizer into one value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def holds_one(text: Column, of: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in of))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (its place in the text, from 0), family, probability, confirmed of every paragraph that has a licence family or claims an unknown licence."""
    classes, _ = trained()
    t, n = tables(), len(classes)
    words, worth = literal(t.words, "string"), literal(t.worth, "double")
    slots, base, gain, flat, bias = literal(t.grams, "bigint"), literal(t.base, "bigint"), literal(t.gain, "double"), literal(t.flat, "double"), literal(t.bias, "double")
    zero = F.lit(0).cast("bigint")

    def number(w: Column) -> Column:
        """The number of a word, or 0 where the model lacks it."""
        at = F.pmod(F.xxhash64(w), F.lit(len(t.words)).cast("bigint"))
        return F.when(F.get(words, at.cast("int")) == w, at + 1).otherwise(zero)

    def feature(key: Column) -> Column:
        """The place of an n-gram among the features, from 1, or 0."""
        b = F.pmod(F.xxhash64(key), F.lit(GRAM_BUCKETS).cast("bigint")).cast("int")
        at = F.array_position(F.slice(slots, b * SLOTS + 1, F.lit(SLOTS)), key)
        return F.when(at > 0, at + F.get(base, b)).otherwise(zero)

    def features(ids: Column) -> Column:
        """The features among the runs of known words, each once."""
        two = F.transform(ids, lambda a, i: F.when((a > 0) & (F.get(ids, i + 1) > 0), a + F.shiftleft(F.get(ids, i + 1), 16)).otherwise(zero))
        three = F.transform(ids, lambda a, i: F.when((a > 0) & (F.get(ids, i + 1) > 0) & (F.get(ids, i + 2) > 0), a + F.shiftleft(F.get(ids, i + 1), 16) + F.shiftleft(F.get(ids, i + 2), 32)).otherwise(zero))
        return F.filter(F.transform(F.array_distinct(F.filter(F.concat(ids, two, three), lambda k: k > 0)), feature), lambda f: f > 0)

    def reach(found: Column, of: Column) -> Column:
        return F.aggregate(found, F.lit(0.0), lambda a, f: a + F.get(of, (f - 1).cast("int")))

    def carry(s: Column, **more: Column) -> Column:
        return F.struct(*(s[c].alias(c) for c in ("paragraph", "claim", "words")), *(x.alias(c) for c, x in more.items()))

    # each step is a pass of its own over a text's paragraphs, so that what it makes is made once
    text = F.lower(F.col("text").cast("string"))
    p = F.transform(F.split(text, BREAK), lambda x, i: F.struct(i.alias("paragraph"), holds_one(x, ANCHORS).alias("claim"), F.regexp_extract_all(x, F.lit(WORD), F.lit(0)).alias("words")))
    p = F.transform(p, lambda s: carry(s, ids=F.transform(s["words"], number)))
    p = F.filter(p, lambda s: s["claim"] | (reach(F.array_distinct(F.filter(s["ids"], lambda k: k > 0)), worth) >= t.room - 1e-6))
    p = F.transform(p, lambda s: carry(s, found=features(s["ids"])))
    p = F.filter(p, lambda s: s["claim"] | (reach(s["found"], gain) >= t.room - 1e-6))
    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(p).alias("p")).select("doc_id", "p.*")
    scores = F.transform(bias, lambda b, c: b + F.aggregate("found", F.lit(0.0), lambda a, f: a + F.get(flat, ((f - 1) * n + c).cast("int"))))
    s = s.withColumn("scores", scores).withColumn("top", F.array_max("scores"))
    s = s.withColumn("probability", 1 / F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    best = F.get(F.array(*map(F.lit, classes)), (F.array_position("scores", F.col("top")) - 1).cast("int"))
    s = s.withColumn("family", F.when(F.col("probability") >= LEAST_PROBABILITY, best).otherwise(F.lit(UNKNOWN))).where(F.col("claim") | (F.col("family") != UNKNOWN))

    at = F.when(F.size("words") >= SHINGLE, F.sequence(F.lit(1), F.size("words") - SHINGLE + 1)).otherwise(F.array().cast("array<int>"))
    own = F.array_distinct(F.transform(at, lambda k: F.array_join(F.slice("words", k, SHINGLE), " ")))

    def known(family: str) -> Column:
        """The template comparison."""
        by_notice, shingles = F.rlike(F.array_join("words", " "), F.lit(notices(family))), shingles_of(family)
        if not shingles:
            return by_notice
        return by_notice | ((F.size(own) >= LEAST_SHINGLES) & (F.size(F.array_intersect(own, F.split(F.lit(",".join(shingles)), ","))) >= CONFIRM * F.size(own)))

    confirmed = reduce(lambda c, f: c.when(F.col("family") == f, known(f)), FAMILIES, F.when(F.lit(False), F.lit(False))).otherwise(F.lit(False))
    return s.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), confirmed.alias("confirmed"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
