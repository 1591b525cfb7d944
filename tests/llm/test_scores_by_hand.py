"""Secret candidates and features, quality shapes and scores, and language scores against plain loops over characters."""

from __future__ import annotations

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import langid, linear, quality, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "one", "ONE two\tTHREE\n\nfour", "naïve Straße çé 12 34,5", "a" * 5000 + " b", "*** ||| ===", "x\x0by\x0cz", "same same same other", "É É é 9"]


def prose(rng, n):
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "re", "Ü", "7", "-"]) for _ in range(rng.randrange(1, 5)))
    return " ".join(word() + rng.choice(["", "", ",", "."]) for _ in range(n))


def grams_by_hand(codes, sizes, bits):
    out = [0] * (len(sizes) << bits)
    factors = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1]
    for at, n in enumerate(sizes):
        for i in range(len(codes) - n + 1):
            h = 0
            for j in range(n):
                h = (h + codes[i + j] + 1) * factors[j % 5] % 2**32
                h ^= h >> 15
            h = h * 0x2C1B3C6D % 2**32
            out[(at << bits) + (h >> (32 - bits))] += 1
    return out


def test_ngram_counts():
    for text in [t for t in ODD if len(t) < 1000]:
        codes = np.frombuffer(text.encode(), np.uint8)
        assert linear.ngram_counts(codes, (2, 3), 9).tolist() == grams_by_hand(list(text.encode()), (2, 3), 9)


def language_by_hand(model, text):
    """Family first, then votes of its pairs; und without letters."""
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    folded, codes = f" {text.lower()} ".encode(), []
    for b in folded:
        c = b if b > 127 or chr(b).isalpha() else 32
        if not (codes and c == 32 and codes[-1] == 32):
            codes.append(c)
    counts = grams_by_hand(codes, langid.SIZES, langid.BITS)
    total = sum(counts)
    x = {i: math.sqrt(c / total) for i, c in enumerate(counts) if c}
    score = lambda w: sum(v * float(w[i]) for i, v in x.items())
    family = [1 / (1 + math.exp(-4 * score(w))) for w in model.family_weights]
    k = max(range(len(family)), key=lambda i: family[i])
    names = model.families[k]
    wins, sure = [0] * len(names), [0.0] * len(names)
    for (f, a, b), w in zip(model.pairs, model.pair_weights, strict=True):
        if f == k:
            m = score(w)
            wins[a if m >= 0 else b] += 1
            sure[a], sure[b] = sure[a] + m, sure[b] - m
    best = max(range(len(names)), key=lambda i: (wins[i], sure[i]))
    within = 1 / (1 + math.exp(-4 * sure[best] / (len(names) - 1))) if len(names) > 1 else 1.0
    return names[best], family[k] * within


def test_language_by_hand(spark):
    words = {"en": "the of and with this that from", "de": "der und nicht eine für über auf", "fr": "le des une pour est dans être", "es": "el los una para está como año", "nl": "het een van niet voor naar deze"}
    rng = random.Random(14)
    text = lambda lang: " ".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(3, 30)))
    rows = [(i, text(lang), lang) for i in range(300) for lang in [rng.choice(list(words))]]
    frame = spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], DOCS)
    model = langid.train(frame, per_language=60)
    asked = [t for _, t, _ in rows[:40]] + ODD
    out = langid.predict(spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(asked)], DOCS), model).collect()
    for r in out:
        name, score = language_by_hand(model, asked[r.doc_id])
        assert r.lang_pred == name and abs(r.score - score) < 1e-4


def shape_by_hand(text):
    raw = text.encode()
    kind = lambda b: "a" if b > 127 or chr(b).islower() else "A" if chr(b).isupper() else "0" if chr(b).isdigit() else " " if b == 32 or 9 <= b <= 13 else chr(b)
    c = [kind(b) for b in raw]
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    n, chars = max(1, len(words)), max(1, sum(k != " " for k in c))
    upper, lower = c.count("A"), c.count("a")
    spelt = [w for w in words if any(kind(b) in "aA" for b in w)]
    bare = [w for w in words if not any(kind(b) in "aA0" for b in w)]
    twice = sum(1 for x, y in zip(c, c[1:], strict=False) if x == y and y not in "aA0 ")
    return quality.Shape(
        chars, len(words), upper / max(1, upper + lower), sum(b in b"#$%&*+<=>@\\^_`{|}~" for b in raw) / chars, twice / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(set(words)) / n**0.5,
        sum(len(w) <= 3 for w in spelt) / max(1, len(spelt)), len(bare) / n, sum(b in b".,;:" for b in raw) / n, sum(map(len, words)) / len(words) if words else 0.0,
    )


def test_quality_by_hand(spark):
    """Shapes as by hand, and scores as the model's weights give for counts by hand."""
    rng = random.Random(15)
    texts = ODD + [prose(rng, rng.randrange(1, 80)) for _ in range(60)] + ["|| ** " * 20 + prose(rng, 5) for _ in range(20)]
    for t in texts:
        got, want = quality.shape(t.encode())[0], shape_by_hand(t)
        assert all(abs(getattr(got, f) - getattr(want, f)) < 1e-9 for f in want.__dataclass_fields__), t
    frame = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], DOCS)
    model = quality.train(frame, sample=60)
    for r in quality.rate(frame, model).collect():
        s, words = shape_by_hand(r.text), [w for w in re.split(rb"[\x20\x09-\x0d]+", r.text.encode()) if w]
        codes = [ord("a") if b > 127 or chr(b).islower() else ord("A") if chr(b).isupper() else ord("0") if chr(b).isdigit() else 32 if 9 <= b <= 13 else b for b in r.text.encode()]
        counts = np.array(grams_by_hand(codes, quality.SIZES, quality.BITS), float)
        n = max(1, len(words))
        again = 1 - len(set(words)) / min(n, 30 * n**0.5)
        x = np.r_[np.sqrt(counts / counts.sum()) if counts.sum() else counts, s.neighbours**0.5, (1 - s.neighbours) ** 0.5, max(0.0, again), 1.0]
        want = 1 / (1 + math.exp(-max(-40, min(40, float(x @ model.weights))))) if words else 0.0
        assert abs(r.score - want) < 1e-4 and r.kept == (r.score >= 0.5)


def test_estimate_raises_the_likelihood():
    """No small change of any accuracy makes the votes more likely than the estimate does, but for its added votes."""
    rng = np.random.default_rng(16)
    counts = {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        v = "".join("-" if rng.random() < 0.2 else ("1" if (rng.random() < p) == good else "0") for p in (0.9, 0.8, 0.85, 0.95)) + "-" * (len(quality.LABELLERS) - 4)
        counts[v] = counts.get(v, 0) + 1
    belief, said = quality.estimate(counts)
    prior = sum(n * belief[v] for v, n in counts.items()) / sum(counts.values())

    def likelihood(table, prior):
        total = 0.0
        for v, n in counts.items():
            one, zero = prior, 1 - prior
            for c, s in zip(v, table, strict=False):
                if c != "-":
                    one *= s["good"] if c == "1" else 1 - s["good"]
                    zero *= s["bad"] if c == "0" else 1 - s["bad"]
            total += n * math.log(one + zero)
        return total

    at = likelihood(said[:4], prior)
    for i in range(4):
        for key in ("good", "bad"):
            for step in (-0.03, 0.03):
                moved = [dict(s) for s in said[:4]]
                moved[i][key] = min(0.999, moved[i][key] + step)
                assert likelihood(moved, prior) < at


def candidates_by_hand(text):
    out, words = [], re.split(r"[\x20\x09-\x0D]+", text or "")
    for place, word in enumerate(words):
        if len(word) < 12 or not re.search(secret_scan.CORE, word):
            continue
        runs, gaps = re.findall(secret_scan.CORE, word), re.split(secret_scan.CORE, word)
        for part, value in enumerate(runs):
            front = (runs[part - 1] if part else "") + gaps[part]
            name = re.search(secret_scan.FRONT, front)
            word1, word2 = (words[place - 1] if place else ""), (words[place - 2] if place > 1 else "")
            if name:
                before, before2 = name[2], name[1]
            elif part == 0:
                before, before2 = word1, word2
            else:
                before, before2 = runs[part - 1], word1 if part == 1 else runs[part - 2]
            out.append((place, part, value, before, before2))
    return out


def test_secret_candidates_and_features_by_hand(spark):
    rng = random.Random(17)
    mixed = lambda n: "".join(rng.choice("0123456789abcdefXYZ-_/") for _ in range(n))
    texts = ["", None, "  lead", f'token = "{mixed(30)}" end', f'{{"key":"{mixed(20)}","id":"{mixed(14)}"}}', f"{mixed(13)}\t{mixed(40)}\n{mixed(3)}", "x " * 3000 + mixed(25)]
    texts += [" ".join(rng.choice([mixed(5), mixed(16), f"key={mixed(20)}", f"a:'{mixed(18)}'", "understanding", "and"]) for _ in range(20)) for _ in range(25)]
    frame = spark.createDataFrame([(i, t, "en", "docs/example", 1) for i, t in enumerate(texts)], DOCS)
    found = secret_scan.candidates(frame, "doc_id", "text", "source")
    got = sorted((r.doc_id, r.place, r.part, r.value, r.before, r.before2) for r in found.collect())
    assert got == sorted((i, *c) for i, t in enumerate(texts) for c in candidates_by_hand(t))
    known = spark.createDataFrame([("understanding",), ("abc",)], "run string")
    share = lambda v, f: sum(map(f, v)) / len(v)
    longest = lambda v, p: max([len(x) for x in re.findall(p, v)], default=0) / len(v)
    for r in secret_scan.described(found, known).collect():
        v = r.value
        want = {
            "length": len(v), "digits": share(v, str.isdigit), "uppers": share(v, str.isupper), "lowers": share(v, str.islower), "others": share(v, lambda c: not c.isalnum()),
            "distinct": len(set(v)) / len(v), "letter_digit": sum(a.isalpha() and b.isdigit() for a, b in zip(v, v[1:], strict=False)) / len(v),
            "digit_letter": sum(a.isdigit() and b.isalpha() for a, b in zip(v, v[1:], strict=False)) / len(v), "longest_letters": longest(v, "[A-Za-z]+"), "longest_digits": longest(v, "[0-9]+"),
            "hexadecimal": float(bool(re.fullmatch("[0-9a-f]{12,}|[0-9A-F]{12,}", v))), "covered": sum(len(x) for x in set(re.findall("[a-z]{3,20}", v.lower())) if x in ("understanding", "abc")) / len(v),
            "path_harmless": 1.0, "path_depth": 1.0,
        }
        assert all(abs(r[k] - x) < 1e-9 for k, x in want.items()), (v, {k: (r[k], x) for k, x in want.items() if abs(r[k] - x) >= 1e-9})


def test_scores_of_nothing(spark):
    """Empty tables and clashing columns."""
    frame = spark.createDataFrame([], DOCS).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))
    assert quality.rate(frame, quality.train(frame)).count() == 0 and langid.predict(frame, langid.train(frame)).count() == 0
