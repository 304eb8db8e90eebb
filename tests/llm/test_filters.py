"""Contamination, quality and toxicity: SQL, brute force and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row

from ledgerline.llm.decision_list import quality, text_statistics
from ledgerline.llm.decontaminate import contamination
from ledgerline.llm.toxicity import _index, fit, reliability, score

from ..oracle import check

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words string, uid string, score string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items):
    words, hit, found = WORD.findall(lower(text)), set(), set()
    for item, body in items:
        w = WORD.findall(lower(body))
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    ids = ",".join(sorted(str(i) for i in found if i is not None))
    return len(words), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["Ant", "bee", "Cat", "dog", "élan", "x1"]) + rng.choice(["", "", "s", "7"]) for _ in range(n))
    items = [(1, text(40)), (2, text(13)), (3, text(3)), (4, "bee"), (5, ""), (6, None), (10, text(25)), (10, text(14)), (None, text(20))]
    docs = [(i, f"{text(rng.randrange(30))}, {rng.choice(items)[1] or ''}! {text(rng.randrange(60))}") for i in range(40)]
    docs += [(100, ""), (101, None), (102, "Bee"), (103, text(400)), (None, items[0][1]), (7, docs[7][1])]
    got = contamination(spark.createDataFrame([(*d, "q", "q", "q") for d in docs], DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = sorted((str(i), *brute(t, items)) for i, t in docs)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert contamination(spark.createDataFrame([(1, "a b", "", "", "")], DOCS), nothing).first().n_hit == 0
    assert contamination(spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_contamination_sql(spark):
    from ledgerline.llm.queries import ORACLES, QUERIES

    check(QUERIES["op3_decontamination"](spark, FOLDER), ORACLES["op3_decontamination"], FOLDER)


def stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    repeated = {j for at in places.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_statistics_equal_brute_force(spark):
    texts = ["", None, "a", "a b", "a b c", "a a a a", "a b c a b c", " x\n\n y\x0b z \n y\nx\n x", "# $ ü|<é>\n# $ ü|<é>", "p q r s " * 300, "  a"]
    got = text_statistics(spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], DOCS)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: stats(t) for i, t in enumerate(texts)}


def test_rules_find_what_marks_bad_texts(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(80)]
        rows.append((i, " ".join(w + "***" if bad and rng.random() < 0.5 else w for w in words), "", "", ""))
        labels.append((i, None if i % 50 == 1 else int(not bad)))
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality(docs, known).collect()}
    assert sum(r.kept == (i % 3 != 0) for i, r in got.items()) >= 890
    assert not any(r.base_failed for r in got.values())
    nobody = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept for r in quality(docs.limit(5), nobody).collect())
    assert quality(docs.limit(0), known).count() == 0


def test_no_python_in_the_quality_plan(spark):
    plan = text_statistics(spark.createDataFrame([(1, "a", "", "", "")], DOCS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.fixture(scope="module")
def abuse(spark):
    rng = random.Random(9)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    rude = ["grobian", "schurke", "lumpenhund", "lumpenpack", "lumpengesindel"]
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(40)]
        if toxic := i % 5 == 0:
            words[3], words[9] = rng.choice(rude), rng.choice(rude).upper()
        rows.append((i, " ".join(words), "", "", ""))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_texts_score_right(spark, abuse):
    docs, labels = abuse
    got = {r.doc_id: r for r in score(docs, fit(docs, labels)).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 300
    assert sum((got[i].score >= 0.7) == (i % 5 == 0) for i in held) >= 0.98 * len(held)
    assert all(e.toxic for e in got[0].evidence) and all(0 <= r.score <= 1 for r in got.values())


def test_search_is_exact():
    import numpy as np

    rng = np.random.default_rng(7)
    terms = np.sort(rng.integers(0, 2**63, 60).astype(np.uint64))
    triples = [Row(doc_id=int(d), term=int(t), n=int(rng.integers(1, 5))) for d in range(700) for t in rng.choice(terms, 5, replace=False)]
    model = _index(terms, rng.random(60) + 0.5, {d: d % 2 for d in range(701)}, triples, {0: 900, 1: 400}, 0.3)
    dense = np.zeros((-(-len(model.example) // 64) * 64, len(terms)))
    for t in range(len(terms)):
        for b in range(model.most.shape[1]):
            x, y = model.cut[t, b], model.cut[t, b + 1]
            dense[b * 64 + model.doc[x:y], t] = model.value[x:y]
            assert model.most[t, b] == max(model.value[x:y], default=0)
    assert np.allclose(np.sqrt((dense[:700] ** 2).sum(axis=1)), 1)
    rng = np.random.default_rng(3)
    for _ in range(50):
        at = np.sort(rng.choice(len(model.terms), 6, replace=False))
        value = rng.random(6)
        value /= np.sqrt((value**2).sum())
        want = dense[:, at] @ value
        places, cosines = model.nearest(at, value, 15)
        assert np.allclose(np.sort(want)[::-1][: len(cosines)], cosines, atol=1e-6)


def test_scores_of_odd_rows(spark, abuse):
    docs, labels = abuse
    odd = spark.createDataFrame([(1, "", "", "", ""), (2, None, "", "", ""), (None, "grobian", "", "", ""), (3, "zz " * 9000, "", "", "")], DOCS)
    got = score(odd, fit(docs, labels)).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id}) == 1
    none = fit(docs.limit(0), labels)
    assert score(docs.limit(3), none).count() == 3 and score(docs.limit(0), none).count() == 0
    assert {r.score for r in score(docs.limit(3), fit(docs, labels.limit(0))).collect()} == {0.0}


def test_all_terms_of_both_classes_count(spark):
    """A toxic word that always came beside a stronger one, one in three texts, and a copy of a labelled toxic text."""
    rng = random.Random(4)
    plain = ["".join(rng.choice("klmnopqr") for _ in range(rng.randint(3, 6))) for _ in range(300)]
    text = lambda *more: " ".join([*(rng.choice(plain) for _ in range(30)), *more])
    used = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = {i: (text("schurke", *["wicht"] * (k % 8 == 0)) if k % 4 == 0 else text(), int(k % 4 == 0)) for k, i in enumerate(used)}
    rows |= {i: (text("knilch"), 1) for i in used[1:13:4]}
    rows[used[2]] = ("ganz eigene Worte ohne Makel", 1)
    docs = spark.createDataFrame([(i, t, "", "", "") for i, (t, _) in rows.items()], DOCS)
    model = fit(docs, spark.createDataFrame([(i, y) for i, (_, y) in rows.items()], "doc_id long, toxic int"))
    new = [text("wicht"), text("knilch"), rows[used[2]][0], *(text() for _ in range(50))]
    got = [r.score >= 0.7 for r in sorted(score(spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(new)], DOCS), model).collect(), key=lambda r: r.doc_id)]
    assert got[:3] == [True] * 3 and not any(got[3:])


def plain_terms(text):
    words = [w.encode() for w in WORD.findall(lower(text))]
    return Counter([("w", w) for w in words] + [(n, w[:n]) for w in words if len(w) >= 7 for n in (4, 5)])


def plain_scores(rows, labels, texts, k=15):
    """Every text against every example: all terms, cosines of all pairs, and the votes of the nearest."""
    known = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    examples = {i: plain_terms(t) for i, t in rows if i in known}
    n, n_toxic = len(examples), sum(known[i] for i in examples)
    df, p = Counter(), Counter()
    for i, terms in examples.items():
        df.update(terms.keys())
        p.update(terms.keys() if known[i] else ())
    rate = n_toxic / n
    weight = {t: (math.log((1 + n) / (1 + df[t])) + 1) * (0.1 + ((p[t] - df[t] * rate) / math.sqrt(df[t] * rate * (1 - rate) + 1) * (2 * p[t] / df[t] - 1)) ** 2) for t in df}

    def unit(terms):
        v = {t: (1 + math.log(c)) * weight[t] for t, c in terms.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if v else {}

    units = {i: unit(terms) for i, terms in examples.items()}
    total = Counter(known.values())
    share = {y: total[y] / max(1, sum(known[i] == y for i in examples)) for y in (0, 1)}
    prior = total[1] / sum(total.values())
    out = {}
    for i, t in texts:
        v = unit(plain_terms(t))
        near = sorted(((sum(x * e.get(t, 0) for t, x in v.items()), known[j]) for j, e in units.items()), reverse=True)[:k]
        votes = [(share[y] / max(share.values()) / (1.05 - min(c, 1)) * c**3, y) for c, y in near if c > 0]
        out[i] = (sum(w * y for w, y in votes) + 0.05 * prior) / (sum(w for w, _ in votes) + 0.05) if votes else None
    return out


def test_scores_equal_a_plain_version(spark):
    rng = random.Random(21)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 10))) for _ in range(200)]
    rude = ["grobian", "schurke", "lumpenhund"]
    rows = [(i, " ".join([*(rng.choice(plain) for _ in range(25)), *([rng.choice(rude)] if i % 4 == 0 else [])])) for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i in range(0, 400)]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], DOCS)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = score(docs, fit(docs, known))
    got, want = {r.doc_id: r.score for r in scored.collect()}, plain_scores(rows, labels, rows)
    ties = [i for i in got if abs(got[i] - want[i]) > 1e-4]
    assert len(ties) <= 4  # examples as near as the last of the nearest ones may stand in for each other
    table = reliability(scored, known).collect()
    assert sum(r.n for r in table) == sum(zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in rows)
    assert table[0].toxic_share < 0.1 and table[-1].toxic_share > 0.9


def plain_rules(rows, bad, precision=0.9):
    """Sequential covering by exhaustive search over one condition: is there a threshold that marks bad rows alone?"""
    out = []
    for k in range(len(rows[0])):
        for cut in sorted({r[k] for r in rows}):
            for above in (False, True):
                covered = [b for r, b in zip(rows, bad) if (r[k] > cut) == above]
                if len(covered) >= 8 and sum(covered) >= precision * len(covered):
                    out.append((sum(covered), k, cut, above))
    return max(out, default=None)


def test_verdict_covers_what_an_exhaustive_search_covers(spark):
    rng = random.Random(30)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() + ("#" if i % 4 == 0 and rng.random() < 0.4 else "") for _ in range(70)) for i in range(800)]
    bad = [int(i % 4 == 0) for i in range(800)]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.kept for r in quality(docs, spark.createDataFrame([(i, 1 - b) for i, b in enumerate(bad)], "doc_id long, quality int")).collect()}
    best = plain_rules([(t.count("#") / 70, len(t) / 70, sum(c.isupper() for c in t)) for t in texts], bad)
    assert best[1] == 0 and sum(not got[i] and bad[i] for i in got) >= 0.97 * best[0]
    assert sum(not got[i] and not bad[i] for i in got) <= 0.03 * len(got)


def test_statistics_of_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    rows = [(None, "a b c a b c"), (1, long), (1, long), (1, "x"), (2, None)]
    got = text_statistics(spark.createDataFrame([(*r, "q", "q", "q") for r in rows], DOCS)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((str(i), *stats(t)) for i, t in rows)
    assert text_statistics(spark.createDataFrame([], DOCS)).count() == 0
