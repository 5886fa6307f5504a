"""Repeats, benchmark items, languages, language models."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import ctw, decontaminate, language, suffix
from chronoloom.llm.common import held_out


def repeats(texts, length):
    count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("hot", [suffix.HOT, 2000])
def test_repeats(spark, hot):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rnd.randint(60, 160))) for _ in range(4)] + ["x" * 700]
    texts = [None, "", "short", "a" * 399, "b" * 401]
    for _ in range(30):
        parts = [rnd.choice(passages)[rnd.randint(0, 40) :] if rnd.random() < 0.5 else " ".join(word() for _ in range(60)) for _ in range(rnd.randint(1, 4))]
        texts.append(" ".join(parts))
    texts += [texts[7], texts[7]]
    rows = [(i if i != 9 else None, t, "x", 1) for i, t in enumerate(texts)] + [(7, texts[7], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_bytes int")
    found = suffix.remove_repeats(df, 400, hot=hot).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found)
    want = repeats([(t or "").encode() for _, t, _, _ in rows], 400)
    assert got == sorted((str(r[0]), *w) for r, w in zip(rows, want, strict=True))
    for r in found:  # whole characters only, and no other one is lost
        kept = bytes(r.kept).decode("utf-8", "ignore")
        assert "\ufffd" not in r.left and sum(map(len, r.left.split("é"))) == len(kept.replace("é", "")) and r.left.count("é") <= kept.count("é")


def test_a_genuine_replacement_character_stays(spark):
    rnd = random.Random(5)
    passage = "é" + "".join(rnd.choice("abcdeé") for _ in range(500)) + "é"
    df = spark.createDataFrame([(1, "\ufffd one " + "ü" + passage + "ö end \ufffd"), (2, "\ufffd two " + "ļ" + passage + "ò \ufffd")], "doc_id long, text string")
    got = {r.doc_id: r.left for r in suffix.remove_repeats(df).collect()}
    assert got == {1: "\ufffd one  end \ufffd", 2: "\ufffd two  \ufffd"}


def test_one_row_repeated_very_often(spark):
    text = " ".join(f"word{i % 91}x{i}" for i in range(90))
    df = spark.range(3000).select((F.col("id") * 0).alias("doc_id"), F.lit(text).alias("text"))
    assert {(r.n_bytes, r.n_removed, r["count"]) for r in suffix.remove_repeats(df).groupBy("n_bytes", "n_removed").count().collect()} == {(len(text), len(text), 3000)}


def test_repeats_in_a_long_text_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SLICE", 1500)
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(6000))
    df = spark.createDataFrame([(1, text + text[2000:2700] + "end"), (2, text[4000:4399])], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(df).collect()}
    want = repeats([r.text.encode() for r in df.collect()], 400)
    assert [got[1], got[2]] == want
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def nearest(pattern, text):
    """Smallest edit distance of the pattern to any substring."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        before, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(before[j - 1] + (c != d), before[j] + 1, row[j - 1] + 1)
    return min(row)


def test_items_against_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 8)))
    items = [" ".join(word() for _ in range(rnd.randint(4, 40))) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = [word() for _ in range(30)]
        if rnd.random() < 0.8:
            held = list(rnd.choice(items))
            for _ in range(rnd.randint(0, 20)):
                k = rnd.randrange(len(held))
                held[k : k + 1] = rnd.choice(["", "z", held[k] + "y", held[k].upper(), held[k] + "!"])
            parts.insert(rnd.randint(0, 30), "".join(held))
        texts.append(" ".join(parts))
    texts += [items[0], items[1].upper(), None, "", "x" * 50000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, distance int")
    bench = spark.createDataFrame([*((i, t) for i, t in enumerate(items)), (100, None), (None, items[2]), (101, "too short"), (102, items[3])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_items(docs, bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, item in [*enumerate(items), (102, items[3])]:
            p = decontaminate.plain(item)
            if len(p) >= decontaminate.LOOSE:
                n = nearest(p, decontaminate.plain(t))
                if n <= decontaminate.edits_allowed(len(p)):
                    want[d, i] = n
            elif b" " + p + b" " in b" " + decontaminate.plain(t) + b" ":
                want[d, i] = 0
    assert got == want and len(got) > 20
    assert {(r.item_id, r.text) for r in decontaminate.unsearched(bench).collect()} == {(100, None), (None, items[2]), (101, "too short")}
    clean = {r.doc_id for r in decontaminate.without_items(docs, bench).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in want}


def test_items_in_blocks_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (1, "other"), (None, "eight nine ten eleven twelve")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(["two three four five six", "nine ten eleven twelve", "not there at all, nowhere"])], "item_id int, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_items(docs, bench).collect()} == {(1, 0), (None, 1)}
    same = spark.createDataFrame([(7, t) for t in ("two three four five six", "one two three four fife six seven", "three four five six seven ate nine")], "item_id int, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_items(docs, same).collect()] == [(1, 7, 0)]
    short = spark.createDataFrame([(1, "two three four"), (2, "two three fou"), (3, "four five")], "item_id int, text string")
    assert [(r.doc_id, r.item_id, r.distance, r.allowed) for r in decontaminate.find_items(docs, short).collect()] == [(1, 1, 0, 0)]
    assert decontaminate.find_items(docs, bench.limit(0)).count() == 0 and decontaminate.find_items(docs.limit(0), bench).count() == 0
    assert decontaminate.without_items(docs, bench.limit(0)).count() == 3


def labelled():
    rnd = random.Random(5)
    parts = {"en": "the of and ing tion er that with".split(), "fr": "le éa que des ment oi eau ç".split(), "de": "der ung ich sch und ein ß ü".split()}
    out = []
    for i in range(450):
        lang = ("en", "fr", "de")[i % 3]
        out.append((i, " ".join("".join(rnd.choices(parts[lang], k=rnd.randint(1, 3))) for _ in range(rnd.randint(10, 200))), lang))
    return out


def test_language(spark):
    rows = [*labelled(), (900, None, "en"), (901, "", "en"), (902, "123 !? ", "fr"), (903, "the that with", None), (904, "der und ein " * 20000, "de"), (None, "le que des eau", "fr")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    out = held_out(F.col("doc_id"), 4, 2)
    net = language.fit(df, out)
    got = language.identify(df.withColumn("held_out", out), net, keep=("held_out", "lang")).collect()
    assert len(got) == len(rows)
    tested = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 450]
    assert len(tested) > 60 and np.mean([r.lang_pred == r.lang for r in tested]) > 0.97
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by[904].lang_pred == "de" and all(0 <= r.score <= 1 for r in got)
    kept = {r.doc_id for r in language.accepted(df, net, 0.3).collect()}
    assert not kept & {900, 901, 902} and len(kept) >= 450
    assert {r.lang_pred for r in language.identify(df, None).collect()} == {"und"}
    assert language.fit(df.limit(0), out) is None


def test_windows_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 509, 510, 5000):
        data = np.arange(n) % 251
        rows, of = language.windows(data.astype(np.uint8), np.array([0, n]))
        assert len(rows) == len(of) >= 1
        if n > language.WINDOW:
            got = {bytes(r[i : i + 4]) for r in rows for i in range(language.WINDOW - 3)}
            fold = language._FOLD[data.astype(np.uint8)]
            assert {bytes(fold[i : i + 4]) for i in range(n - 3)} <= got


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) if a + b else 0.0


def brute_model(texts):
    """Context trees as dictionaries; log probability of a byte after two."""
    count, kids = defaultdict(lambda: [0, 0]), defaultdict(set)
    for t in texts:
        d = b"\0\0" + t
        for i in range(2, len(d)):
            node = 1
            for k in range(7, -1, -1):
                bit = d[i] >> k & 1
                for depth in range(3):
                    c = d[i - depth : i]
                    count[node, c][bit] += 1
                    if depth:
                        kids[node, c[1:]].add(c)
                node = node * 2 + bit

    def mix(node, c):
        own = kt(*count[node, c])
        return own if len(c) == 2 else np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(mix(node, k) for k in kids[node, c]))

    def p(node, before, bit, depth=0):
        c = before[2 - depth :]
        n = count.get((node, c), [0, 0])
        here = (n[bit] + 0.5) / (sum(n) + 1)
        if depth == 2:
            return here
        w = math.exp(math.log(0.5) + kt(*n) - mix(node, c)) if sum(n) else 0.5
        return w * here + (1 - w) * p(node, before, bit, depth + 1)

    def log_p(before, byte):
        node, total = 1, 0.0
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            total += math.log(p(node, before, bit))
            node = node * 2 + bit
        return total

    return log_p


def test_language_model(spark):
    rows = [(0, "abracadabra Abra"), (1, "the cat the hat"), (2, None), (3, ""), (4, "zebra the Ünknown"), (5, "the the"), (5, "the the"), (None, "cat")]
    out = F.col("doc_id").isin(2, 4)
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, score int")
    got = sorted(ctw.score(df, out).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    train = [(t or "") for i, t in rows if i not in (2, 4)]
    log_p = brute_model([t.encode() for t in train])
    words = lambda t: (t or "").lower().split() + ["\n"]
    count = Counter(w for t in train for w in words(t))
    total, distinct = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, rows, strict=True):
        data = (t or "").encode()
        padded = b"\0\0" + data
        want = sum(log_p(padded[k : k + 2], padded[k + 2]) for k in range(len(data))) / math.log(10)
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words(t))
        assert r.score == pytest.approx(want, abs=1e-4) and r.base_score == pytest.approx(base, abs=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words(t)), sum(count[w] > 0 for w in words(t)), total, i in (2, 4))


def test_rare_words_by_join(spark, monkeypatch):
    rows = [(i, " ".join(f"w{j}" for j in range(i))) for i in range(30)] + [(40, "q" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: (r.n_known, round(r.base_score, 9)) for r in ctw.score(df, F.lit(False)).collect()}
    monkeypatch.setattr(ctw, "FREQUENT", 3)
    assert {r.doc_id: (r.n_known, round(r.base_score, 9)) for r in ctw.score(df, F.lit(False)).collect()} == whole


def test_model_without_training_rows(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    r = ctw.score(df, F.lit(True)).first()
    assert r.score == pytest.approx(-3 * 8 * math.log10(2)) and (r.n_known, r.train_tokens) == (0, 0)
    assert ctw.score(df.limit(0), F.lit(False)).count() == 0
